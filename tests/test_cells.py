"""The index of vectors in cells: exact search against every score, candidates, awkward rows, saving."""

from __future__ import annotations

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lemniscate.operators import cells, search
from lemniscate.operators.cells import Layout
from lemniscate.plans import api

DIMS = 16


def vectors(spark, given, name="id"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in given], f"{name} long, vector array<double>")


def clustered(n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, DIMS))
    return [(i, centres[i % 12] + 0.2 * rng.normal(size=DIMS)) for i in range(n)]


def nearest_brute(rows, asked, k):
    """Every query's k best by cosine over all rows, ties by id."""
    unit = lambda v: np.asarray(v, float) / np.linalg.norm(v)
    out = {}
    for q, v in asked:
        scored = sorted((-round(float(unit(v) @ unit(w)), 9), i) for i, w in rows)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def by_query(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
    return out


def built(spark, given, layout=Layout(cells=8, part=50)):
    return cells.build(vectors(spark, given), tempfile.mkdtemp(prefix="cells-") + "/index", DIMS, layout)


@pytest.mark.parametrize("layout", [Layout(cells=8, part=50), Layout(cells=3, ring=4.0, part=7), Layout(cells=40, sample=100, ring=0.02)])
def test_exact(spark, layout):
    rows = clustered(600)
    asked = [(i, v) for i, v in rows if i % 50 == 0] + [(1000, -rows[0][1]), (1001, np.ones(DIMS))]
    index = built(spark, rows, layout)
    found = cells.nearest(index, vectors(spark, asked, "query_id"), 10, rescale=False)
    assert by_query(found.hits) == nearest_brute(rows, asked, 10)
    work = {r["query_id"]: r for r in found.work.collect()}
    assert set(work) == {q for q, _ in asked} and all(10 <= r["rows_read"] <= r["rows"] == 600 for r in work.values())


def test_cells_are_left_out_and_hits_equal_knn(spark):
    rows = clustered(1200)
    asked = vectors(spark, rows[::50], "query_id")
    found = cells.nearest(built(spark, rows), asked, 5)
    assert sorted(map(tuple, found.hits.select("query_id", "id", "rank", F.round("score", 9)).collect())) == sorted(
        map(tuple, search.knn(vectors(spark, rows), asked, 5).select("query_id", "id", "rank", F.round("score", 9)).collect())
    )
    # Twelve clusters: a query's cell and few others are read.
    assert found.work.agg(F.avg(F.col("rows_read") / F.col("rows"))).first()[0] < 0.5


def test_equal_vectors_are_split_and_ties_go_by_id(spark):
    rows = [(i, np.ones(DIMS)) for i in range(300)] + [(i, v) for i, v in clustered(900) if i >= 300]
    index = built(spark, rows)
    assert index.rows.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 150
    assert index.rings.agg(F.max("parts")).first()[0] > 1
    asked = [(7, np.ones(DIMS)), (8, 2 * np.ones(DIMS))]
    hits = by_query(cells.nearest(index, vectors(spark, asked, "query_id"), 20).hits)
    assert hits == {q: [(i, 1.0) for i in range(20)] for q in (7, 8)}


def test_awkward_rows(spark):
    rows = clustered(40)
    odd = [(100, None), (101, np.zeros(DIMS)), (102, np.ones(DIMS - 1)), (103, [np.nan] * DIMS), (104, [np.inf] * DIMS), (5, rows[5][1])]
    index = built(spark, rows + odd)
    assert index.left_out == 5 and index.rows.count() == 41
    asked = [(1, rows[5][1]), (2, None), (3, np.zeros(DIMS)), (4, np.ones(3))]
    hits = by_query(cells.nearest(index, vectors(spark, asked, "query_id"), 100, rescale=False).hits)
    assert set(hits) == {1} and len(hits[1]) == 41 and [i for i, _ in hits[1][:2]] == [5, 5]


@pytest.mark.parametrize("given", [[], [(1, np.ones(DIMS))], [(1, np.ones(DIMS)), (2, -np.ones(DIMS))]])
def test_few_rows(spark, given):
    hits = by_query(cells.nearest(built(spark, given), vectors(spark, [(9, np.ones(DIMS))], "query_id"), 3, rescale=False).hits)
    assert hits == ({9: [(i, round(float(v @ np.ones(DIMS)) / DIMS, 9)) for i, v in given]} if given else {})


def test_candidates_and_reload(spark):
    rows = clustered(1200)
    path = tempfile.mkdtemp(prefix="cells-") + "/index"
    cells.build(vectors(spark, rows), path, DIMS, Layout(cells=12))
    index, asked = cells.load(spark, path), vectors(spark, rows[::50], "query_id")
    exact, some = cells.nearest(index, asked, 10), cells.nearest(index, asked, 10, num_candidates=300)
    assert cells.recall(exact.hits, some.hits).agg(F.avg("recall")).first()[0] >= 0.9
    assert some.work.agg(F.max("rows_read")).first()[0] < 1200
    all_rows = cells.nearest(index, asked, 10, num_candidates=1200)
    assert cells.recall(exact.hits, all_rows.hits).agg(F.min("recall")).first()[0] == 1.0


def test_no_nested_loop(spark):
    index = built(spark, clustered(100))
    plan = cells.nearest(index, vectors(spark, clustered(3), "query_id"), 5).hits._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(cells, "QUERIES", 5)
    rows = clustered(300)
    named = [(f"q{i}", [float(x) for x in v]) for i, v in rows[::20]]
    asked = spark.createDataFrame(named, "query_id string, vector array<double>").select(F.struct("query_id").alias("query_id"), "vector")
    hits = cells.nearest(built(spark, rows), asked, 4, rescale=False).hits.select("query_id.query_id", "id", "score", "rank")
    assert by_query(hits) == nearest_brute(rows, named, 4)


def test_formula_search_reads_cells(spark):
    rows = clustered(200)
    table = vectors(spark, rows, "formula_id").select("formula_id", (F.col("formula_id") % 9).alias("post_id"), F.col("vector").alias("slt_vector"))
    asked = vectors(spark, rows[::40], "query_id")
    near = api.formula_cells(table, tempfile.mkdtemp(prefix="cells-") + "/index", DIMS, "slt_vector", Layout(cells=6))
    key = lambda df: sorted(map(tuple, df.select("query_id", "rank", "formula_id", "post_id", F.round("score", 9)).collect()))
    assert key(api.search_formula_vector(table, asked, "slt_vector", 5, near)) == key(api.search_formula_vector(table, asked, "slt_vector", 5))
    with pytest.raises(ValueError):
        api.search_formula_vector(table, asked, "slt_vector", 5, num_candidates=10)
