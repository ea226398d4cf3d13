"""Record files in many byte ranges, and the scans that join the ranges' records."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lemniscate.operators import scans
from lemniscate.sources import readers, records


@pytest.fixture()
def tiny_splits(spark):
    """Ranges of 64 bytes: most records lie in two of them."""
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return f"file://{path}"


def test_latex_collection_in_many_tasks(spark, tmp_path, tiny_splits):
    rnd = random.Random(3)
    texts = []
    for n in range(3):
        lines = []
        for i in range(120):
            kind = rnd.randrange(6)
            lines.append(["\\frac{%d}{%d}$$f%d" % (i, n, i), "x +", "a $ b$$$f%d" % i, "<p>prose $$ 1", "y$$z$$f%d" % i, "USD"][kind])
        if n:
            lines.insert(90, "")
        texts.append(("\n" if n == 2 else "") + ("\r\n" if n == 1 else "\n").join(lines) + ("\n" if n else "\nunfinished\n\\alpha"))
    paths = [put(tmp_path / f"{n}.txt", t) for n, t in enumerate(texts)]
    assert records.text_lines(spark, paths).rdd.getNumPartitions() > 30
    got = {}
    for r in records.latex_records(spark, paths).collect():
        got.setdefault(r["file"][-5], []).append((r["ord"], r["formula_id"], r["formula"]))
    whole = spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "n string, value string")
    half = lambda k: F.element_at(F.split("record", r"\$\$"), k)
    rows = whole.select("n", F.posexplode(readers.latex_lines(F.col("value"))).alias("ord", "record")).select("n", "ord", half(-1).alias("i"), half(1).alias("f"))
    want = {}
    for r in rows.collect():
        want.setdefault(r["n"], []).append((r["ord"], r["i"].strip(), r["f"].replace("\n", " ").strip()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(len(v) > 20 for v in want.values())
    assert records.latex_records(spark, put(tmp_path / "none.txt", "")).count() == 0
    assert records.latex_records(spark, put(tmp_path / "last.txt", "a\nb$$1")).select("formula", "formula_id").collect() == [("a b", "1")]


def test_latex_triples_in_many_tasks(spark, tmp_path, tiny_splits):
    rnd = random.Random(4)
    for n in range(6):
        text = "".join(rnd.choice(["$$", "$$", "$", "\n", " word ", "formula\nof lines "]) for _ in range(200))
        path = put(tmp_path / f"t{n}.txt", text)
        got = sorted((r["ord"], r["formula"], r["formula_id"]) for r in records.latex_triples(spark, path).collect())
        parts = text.split("$$")
        # Regular expressions and str.split cut runs of marks alike, from the left.
        want = [(i, parts[3 * i + 1].strip(" "), parts[3 * i + 2].strip(" ")) for i in range((len(parts) - 1) // 3)]
        ended = lambda x: x[:-1] if x.endswith("\n") else x  # noqa: E731  a line feed at the very end of a file ends its last line
        assert got == want or got[:-1] == want[:-1] and got[-1][2] == ended(want[-1][2])


def test_engine_results_of_one_file_in_many_tasks(spark, tmp_path, tiny_splits):
    rnd = random.Random(5)
    lines, want, q, e = [], [], None, None
    for i in range(400):
        kind = rnd.choice("QERRRRI")
        if kind == "Q":
            q = f"q{i}"
            lines.append(f"Q\t{q}")
        elif kind == "E":
            e = f"e{i}"
            lines.append(f"E\t{e}")
        elif kind == "R":
            want.append((q, e, f"d{i}", float(i)))
            lines.append(f"R\td{i}\t[0]\tx\t{i}")
        else:
            lines.append("I\tqt\t1")
    path = put(tmp_path / "results.tsv", "\n".join(lines))
    given = records.text_lines(spark, path)
    assert given.rdd.getNumPartitions() > 30
    got = [(r["query"], r["query_expression"], r["doc_id"], r["score"]) for r in readers.engine_results(given).collect()]
    assert sorted(got, key=lambda x: x[3]) == want
    keyword = put(tmp_path / "words.tsv", "\n".join(x.replace("R\t", "M\t", 1) for x in lines))
    hits = readers.keyword_results(records.text_lines(spark, keyword).withColumn("value", F.regexp_replace("value", "\t\\[0\\]\tx", ""))).collect()
    assert sorted((r["query"] or "", r["doc_id"], r["score"]) for r in hits) == sorted((a or "", c, d) for a, _, c, d in want)


@pytest.mark.parametrize("groups", [1, 4])
def test_scans_by_plain_python(spark, groups):
    rnd = random.Random(groups)
    rows = [(None if rnd.randrange(groups) == 0 else "g", i, rnd.choice([None, None, i]), rnd.choice([None, 1, 5])) for i in range(700)]
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "g string, i int, v int, n int").repartition(5)
    got = {r["i"]: r for r in scans.carried(df, ["i"], ["g"], {"last": F.col("v")}).collect()}
    sums = {r["i"]: r["s"] for r in scans.running(df, ["i"], ["g"], {"s": F.col("n")}).collect()}
    last, total = {}, {}
    for g, i, v, n in rows:
        last[g] = i if v is not None else last.get(g)
        assert got[i]["last"] == last[g] and sums[i] == total.get(g, 0)
        total[g] = total.get(g, 0) + (n or 0)
    assert scans.carried(df.filter("false"), ["i"], ["g"], {"last": F.col("v")}).count() == 0
