"""The index of segments: changes, versions, merging, fresh answers; pruned search against full scoring."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lemniscate.operators import evaluate, search, segments
from lemniscate.operators.segments import SegmentedIndex, best, fingerprint

RND = random.Random(12)
WORDS = [f"w{i}" for i in range(60)]
TEXTS = {i: " ".join(RND.choices(WORDS, [1 / (k + 1) for k in range(60)], k=RND.randrange(3, 40))) for i in range(400)}
QUERIES = {q: " ".join(RND.choices(WORDS, k=5)) for q in range(12)} | {90: "unknown", 91: ""}


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 8)
    monkeypatch.setattr(segments, "FIRST", 2)


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def queries(spark):
    return spark.createDataFrame(list(QUERIES.items()), "query_id int, query string")


def ranked(scored, k=10):
    return sorted(map(tuple, search.top_k(scored.withColumn("score", F.round("score", 6)), k, per="query_id").select("query_id", "rank", "doc_id", "score").collect()))


def full(spark, texts, k=10):
    return ranked(search.bm25(frame(spark, texts), queries(spark)), k)


def same(spark, index, texts):
    """Pruned and full search over the index equal full scoring of the texts; so do counts and phrases."""
    want = full(spark, texts)
    assert ranked(best(index, queries(spark), 10).scored) == want
    assert ranked(search.bm25(index.index(), queries(spark))) == want
    assert (index.manifest.n, index.manifest.words) == (len(texts), sum(len((t or "").split()) for t in texts.values()))


def same_phrases(spark, index, texts):
    two = spark.createDataFrame([(1, "w0 w1"), (2, "w1 w0 w0")], "query_id int, query string")
    assert ranked(search.phrases(index.index(), two), 99) == ranked(search.phrases(frame(spark, texts), two), 99)


def test_changes(spark, tmp_path, small_blocks):
    index = SegmentedIndex(spark, f"{tmp_path}/index")
    now = {i: t for i, t in TEXTS.items() if i < 250}
    index.put(frame(spark, now))
    new = {i: (t if i % 3 else t + " w59 w59") for i, t in TEXTS.items() if i >= 200}
    now |= new
    index.put(frame(spark, new))
    gone = [i for i in now if i % 5 == 0] + [99_999]
    now = {i: t for i, t in now.items() if i % 5}
    index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    same(spark, index, now)
    # A deleted document comes back, another one changes twice.
    for change in ({0: "w7 w8", 1: "w9"}, {1: "w10 w9"}):
        now |= change
        index.put(frame(spark, change))
    before = index.manifest.version
    index.merge()
    assert len(index.manifest.segments) == 1 and not index.manifest.graves
    same(spark, index, now)
    # The version before can be read until it is cleared away; then only the new one is left.
    same_phrases(spark, SegmentedIndex(spark, f"{tmp_path}/index", version=before), now)
    index.vacuum()
    reopened = SegmentedIndex(spark, f"{tmp_path}/index")
    assert reopened.versions() == [index.manifest.version]
    same_phrases(spark, reopened, now)


def test_sync_works_on_what_changed_alone(spark, tmp_path, small_blocks):
    index = SegmentedIndex(spark, f"{tmp_path}/index").put(frame(spark, TEXTS), "first")
    now = {i: t for i, t in TEXTS.items() if i != 3} | {5: "w1 w2 w3", 1000: "w4"}
    index.sync(frame(spark, now), "second")
    assert index.manifest.source == "second"
    assert index._read("docs", [index.manifest.version], segments.DOCS).count() == 2
    same(spark, index, now)
    version = index.manifest.segments
    index.sync(frame(spark, now), "third")
    assert index.manifest.segments == version


def test_awkward_changes(spark, tmp_path):
    index = SegmentedIndex(spark, f"{tmp_path}/index")
    assert best(index, queries(spark), 10).scored.count() == 0
    index.merge().delete(spark.createDataFrame([(1,)], "doc_id long"))
    rows = [(1, None, "x"), (None, "w1", "x"), (2, "w1", "x"), (2, "w1 w2", "x"), (3, "", "x")]
    index.put(spark.createDataFrame(rows, "doc_id long, text string, term string"))
    assert (index.manifest.n, index.manifest.words) == (3, 2)
    same(spark, index, {1: "", 2: "w1 w2", 3: ""})
    index.delete(index.docs().select("doc_id"))
    assert index.manifest.n == 0 and index.frequencies().count() == 0
    index.put(spark.createDataFrame([], "doc_id long, text string"))
    assert best(index, queries(spark), 10).scored.count() == 0


def test_unfinished_version_is_not_seen(spark, tmp_path):
    index = SegmentedIndex(spark, f"{tmp_path}/index").put(frame(spark, {1: "w1"}))
    (tmp_path / "index/versions/0000000002").mkdir()
    assert SegmentedIndex(spark, f"{tmp_path}/index").manifest.version == 1
    with pytest.raises(Exception, match="(?i)exist"):
        index.put(frame(spark, {2: "w2"}))  # another writer took the number
    assert SegmentedIndex(spark, f"{tmp_path}/index").manifest.n == 1


def test_frontier_is_an_upper_bound_and_blocks_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 16)
    monkeypatch.setattr(segments, "FIRST", 3)
    # Themes of their own words, as documents of several languages have.
    themes = {i: " ".join(f"t{i % 20}x{RND.randrange(30)}" for _ in range(20)) for i in range(600)}
    index = SegmentedIndex(spark, f"{tmp_path}/index").put(frame(spark, themes))
    asked = spark.createDataFrame([(q, f"t{q}x1 t{q}x2 t{q}x3 t{(q + 1) % 20}x4") for q in range(20)], "query_id int, query string")
    w = segments.weights(index, asked)
    top = segments.scored(index, w, segments.bounds(index, w)).join(index.docs(), "doc_id").groupBy("query_id", "segment", "block").agg(F.max("score").alias("m"))
    wrong = top.join(segments.bounds(index, w), ["query_id", "segment", "block"]).filter("m > bound + 1e-9")
    assert top.count() > 0 and wrong.count() == 0
    found = best(index, asked, 5)
    assert ranked(found.scored, 5) == ranked(search.bm25(frame(spark, themes), asked), 5)
    blocks, read = found.work.agg(F.sum("blocks"), F.sum("read")).first()
    assert read < 0.8 * blocks
    assert found.work.filter("read > blocks").count() == 0
    # Long queries of common and rare words: few of the documents that hold one of their words are scored.
    common = {i: t + " " + " ".join(f"c{(i * 7 + k) % 40}" for k in range(15)) for i, t in themes.items()}
    index.put(frame(spark, common))
    asked = spark.createDataFrame([(q, " ".join(f"c{k}" for k in range(25)) + f" t{q}x1 t{q}x2 t{q}x3 t{q}x4 t{q}x5") for q in range(20)], "query_id int, query string")
    found = best(index, asked, 5)
    every = search.bm25(frame(spark, common), asked)
    assert ranked(found.scored, 5) == ranked(every, 5)
    assert found.scored.count() == found.work.agg(F.sum("documents")).first()[0] < 0.5 * every.count()


def test_queries_follow_the_table(spark, tmp_path):
    """A table that is written again at the same path gets fresh answers from every query that reads the index."""
    from lemniscate.plans import registry

    sf = "/root/testdata/sf0.001"
    for name in ("benchmark", "embeddings", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ("bm25_multi_query", "bm25_pruned", "phrase_match_whole", "fusion_max")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = {n: registry.QUERIES[n](spark, str(tmp_path)).select("doc_id").distinct().count() for n in names}
    assert before["bm25_multi_query"] > 20
    kept = [r["doc_id"] for r in docs.filter("length(text) > 300").select("doc_id").orderBy("doc_id").limit(5).collect()]
    docs.filter(F.col("doc_id").isin(kept)).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    for n in names[:3]:
        assert {r["doc_id"] for r in registry.QUERIES[n](spark, str(tmp_path)).select("doc_id").collect()} <= set(kept), n
    assert registry.QUERIES["bm25_multi_query"](spark, str(tmp_path)).count() > 0


def test_fingerprint(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/a")
    first = fingerprint(spark, f"{tmp_path}/a")
    assert first == fingerprint(spark, f"{tmp_path}/a")
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/a")
    assert fingerprint(spark, f"{tmp_path}/a") != first


def test_rows_of_words_and_held_parts(spark):
    texts = ["a b a b a", "b a", "x a b c d e f y", "a b c d e z", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, ["a"]), (2, ["b", "a"]), (3, ["a", "b", "c", "d", "e", "f"]), (4, [])], "query_id int, row array<string>")
    got = search.in_a_row(docs.select("doc_id", F.split("text", " ").alias("words")), asked).groupBy("query_id", "doc_id").count().collect()
    assert {tuple(r) for r in got} == {(1, 0, 3), (1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 0, 2), (2, 1, 1), (3, 2, 1)}
    parts = ["a b a", "b", " a b c d e ", "a b a b a", "c d e f", "A b", "zzz"]
    held = evaluate.holding(docs, spark.createDataFrame(list(enumerate(parts)), "query_id int, part string"))
    assert sorted(map(tuple, held.collect())) == sorted((q, d) for q, p in enumerate(parts) for d, t in enumerate(texts) if t and p in t)
