"""The pipeline stage by stage against plain Python, on the smallest tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from lemniscate.llm import simhash
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"documents": {r["doc_id"]: r for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, lines, near, private = (seen[n] for n, _ in corpus_pipeline.STAGES[:-1])
    assert not any(brute.quality(r["text"])["base_failed"] for r in good.values())
    assert set(lines) == set(good)
    ids = sorted(lines)
    first = brute.linked([brute.simhash(lines[i]["text"]) for i in ids])
    assert sorted(near) == sorted({ids[f] for f in first})
    assert set(private) == set(near) and not any(brute.base_spans(r["text"]) for r in private.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(private)


def test_run_equals_stages(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    sizes = {}
    for r in out:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert max(sizes.values()) <= 1024 and sorted(sizes) == list(range(len(sizes)))
    assert simhash.TAU == 3


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"word{i}" for i in range(70))


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_run_on_awkward_tables(kind, spark, tmp_path):
    """Nulls, empty and long texts, ties and repeated rows go through all stages; so does an empty table."""
    data = [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, " \n\t", "en", None, 3),
        (4, f"{WORDS}\nmail a.b@c.org", "en", None, 500),
        (4, f"{WORDS}\nmail a.b@c.org", "en", None, 500),
        (None, f"{WORDS} once more {WORDS[::-1]}", None, None, None),
        (6, " ".join(f"w{i}" for i in range(200_000)), "en", "b", 1),
        (7, f"{WORDS[::-1]}\n+1 212 555 0123", "en", "b", 1),
        (8, f"{WORDS[::-1]}\n+1 212 555 0123", "en", "b", 1),
    ]
    df = spark.createDataFrame(data if kind == "awkward" else [], SCHEMA)
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
    left = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    if kind == "awkward":
        assert [i for i, _ in left] == [4, 6, 7, None]
        assert left[0][1] == f"{WORDS}\nmail [EMAIL]" and left[2][1] == f"{WORDS[::-1]}\n[PHONE]"
    else:
        assert left == []
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {i for i, _ in left}
    for i in {i for i, _ in left}:
        pieces = [r for r in out if r["doc_id"] == i]
        assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"]


def test_other_columns_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "doc_id AS row", "text AS words", "1 AS n", "source AS host", "2 AS kept")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.filter("row <> doc_id OR n <> 1 OR kept <> 2 OR NOT (host <=> source)").count() == 0, name
