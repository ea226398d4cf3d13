"""Fusion of text and formula scores, and of several formulas of one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = BETA = 0.5


def keep_last(*arms: DataFrame) -> DataFrame:
    """Union of arms (query_id, doc_id, score) in which the later arm's score of a document counts."""
    out = None
    for n, arm in enumerate(arms):
        arm = arm.select("query_id", "doc_id", "score", F.lit(n).alias("arm"))
        out = arm if out is None else out.unionByName(arm)
    return out.groupBy("query_id", "doc_id").agg(F.max_by("score", "arm").alias("score"))


def by_document(formula_hits: DataFrame, how: str = "max", weighted: bool = False) -> DataFrame:
    """Formula hits (query_id, doc_id, score, weight) to one score per document: floored maximum or mean."""
    score = F.col("score") * F.col("weight") if weighted else F.col("score")
    total = F.greatest(F.max(score), F.lit(0.0)) if how == "max" else F.avg(score)
    return formula_hits.groupBy("query_id", "doc_id").agg(total.alias("score"))


def fused(text: DataFrame, formula: DataFrame, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """Full outer join of two arms; a missing score is zero."""
    t = text.select("query_id", "doc_id", F.col("score").alias("text_score"))
    f = formula.select("query_id", "doc_id", F.col("score").alias("formula_score"))
    return t.join(f, ["query_id", "doc_id"], "full_outer").select(
        "query_id",
        "doc_id",
        F.coalesce("text_score", F.lit(0.0)).alias("text_score"),
        F.coalesce("formula_score", F.lit(0.0)).alias("formula_score"),
        (alpha * F.coalesce("text_score", F.lit(0.0)) + beta * F.coalesce("formula_score", F.lit(0.0))).alias("score"),
    )


def best_per_expression(matches: DataFrame) -> DataFrame:
    """Best match of every (query_id, doc_id, expression): the greatest score list."""
    return matches.groupBy("query_id", "doc_id", "expression").agg(
        F.max("scores").alias("scores"), F.max_by("location", "scores").alias("location")
    )


def expression_weights(expressions: DataFrame, uniform: bool = False) -> DataFrame:
    """Share of each expression in its query, by tree size (opening brackets) or uniform."""
    size = F.lit(1) if uniform else F.length("tree") - F.length(F.replace("tree", F.lit("[")))
    per = Window.partitionBy("query_id")
    sized = expressions.withColumn("size", size.cast("double"))
    return sized.select("query_id", "expression", (F.col("size") / F.sum("size").over(per)).alias("weight"))


def multi_formula(matches: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum of the best scores over a query's expressions, as a score list per document."""
    parts = best_per_expression(matches).join(weights, ["query_id", "expression"])
    rows = parts.select("query_id", "doc_id", "weight", F.posexplode("scores").alias("pos", "x"))
    summed = rows.groupBy("query_id", "doc_id", "pos").agg(F.sum(F.col("x") * F.col("weight")).alias("x"))
    return summed.groupBy("query_id", "doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("scores")
    )


def math_share(n_formulas: Column, n_keywords: Column, fixed: float | None = None) -> Column:
    """Weight of the formula part: fixed, or the formulas' share of the query's parts."""
    return F.lit(fixed) if fixed is not None else F.coalesce(F.try_divide(n_formulas, n_formulas + n_keywords), F.lit(0.0))


def math_and_text(math: DataFrame, text: DataFrame, share: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """m * math + (1 - m) * text with each query's m in ``share`` (query_id, m).

    ``met``: the rows of ``text`` that ``math`` can meet.  With it ``math`` and
    ``share``, which have to be small, go to where ``text`` lies.
    """
    if met is None:
        both = fused(text, math, 1.0, 1.0).join(share, "query_id")
    else:
        f = math.select("query_id", "doc_id", F.col("score").alias("formula_score"))
        t = text.select("query_id", "doc_id", F.col("score").alias("text_score")).join(F.broadcast(f), ["query_id", "doc_id"], "left")
        alone = f.join(met, ["query_id", "doc_id"], "left_anti").withColumn("text_score", F.lit(0.0))
        both = t.na.fill(0.0, ["formula_score"]).unionByName(alone).join(F.broadcast(share), "query_id")
    return both.select(
        "query_id", "doc_id", (F.col("m") * F.col("formula_score") + (1 - F.col("m")) * F.col("text_score")).alias("score")
    )


def matched_positions(matches: DataFrame) -> DataFrame:
    """Locations of the best match of each expression, by document."""
    best = best_per_expression(matches)
    return best.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_set("location")).alias("positions"))


def cycled(ranked: DataFrame, k: int) -> DataFrame:
    """Ranked rows (query_id, rank, doc_id) repeated from the top until there are k of each query."""
    n = ranked.groupBy("query_id").agg(F.max("rank").alias("n"))
    slots = n.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("place"), "n")
    slots = slots.withColumn("rank", (F.pmod(F.col("place") - 1, F.col("n")) + 1).cast("int"))
    return slots.join(ranked, ["query_id", "rank"]).select("query_id", "place", "doc_id")
