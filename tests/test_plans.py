"""Physical plans: what is read, pushed down and joined how."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from lemniscate.operators import formulas, search
from lemniscate.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_columns_are_pruned(spark):
    text = plan(registry.QUERIES["bm25_match"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "lang" not in "".join(x for x in text.splitlines() if "ReadSchema" in x)


def test_filters_are_pushed(spark):
    text = plan(registry.QUERIES["posts_semi"](spark, SF))
    assert "EqualTo(o_orderstatus,F)" in text and "LeftSemi" in text


@pytest.mark.parametrize("name", ["bm25_match", "phrase_match", "fusion_max", "upsert_partial", "sanitize_anti", "encoder_map", "union_keep_last"])
def test_no_cartesian_products(name, spark):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["bm25_match", "phrase_match", "fusion_mean", "clean_text", "vec_sum_combine", "latex_clean_dots", "sanitize_stats"])
def test_no_python(name, spark):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_tuples_need_no_shuffle(spark):
    nodes = formulas.parsed(spark.createDataFrame([(1, "<math><mi>x</mi></math>")], "k int, formula string"))
    assert "Exchange" not in plan(formulas.tuples(nodes, "k"))


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_ROWS", 5)
    assert "broadcast" not in search.small(spark.range(10))._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in search.small(spark.range(5))._jdf.queryExecution().logical().toString().lower()


def test_unique_and_error_trees(spark):
    rows = [(1, "<math><mi>x</mi></math>"), (2, "<math><mi>x</mi></math>"), (3, "<math><merror>m</merror></math>"), (4, "<zz/>")]
    parsed = formulas.parsed(spark.createDataFrame(rows, "k int, formula string"))
    assert {(r["tree"], r["n"], r["first"]) for r in formulas.unique_trees(parsed, "k").collect()} == {("[V!x]", 2, 1), ("[E!m]", 1, 3)}
    assert tuple(formulas.error_trees(parsed).first()) == (1, 1)
    assert parsed.filter(F.col("error").isNotNull()).count() == 1


@pytest.mark.parametrize("name", ["eval_rank_stats", "eval_hit_at_k_whole", "expected_whole", "bm25_pruned"])
def test_no_nested_loops_in_searches(name, spark):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_equal_formulas_are_searched_once(spark, monkeypatch):
    seen = []
    knn = search.knn
    monkeypatch.setattr(search, "knn", lambda rows, asked, *how: seen.append(asked.count()) or knn(rows, asked, *how))
    registry.QUERIES["matched_positions"](spark, SF)
    assert seen == [10]
