"""Evaluation of rankings against expected documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemniscate.functions.text import tokens
from lemniscate.operators import reading, search

#: Words of a part by which documents that may hold it are looked up.
LOOKED_UP = 3


def found_at(expected: DataFrame, ranking: DataFrame) -> DataFrame:
    """``expected`` (case_id, query_id, doc_id, …) with ``position``, the first rank of the expected document, or null."""
    first = ranking.groupBy("query_id", "doc_id").agg(F.min("rank").alias("position"))
    return expected.join(first, ["query_id", "doc_id"], "left")


def holding(docs: DataFrame, parts: DataFrame, analyser: search.Analyser = tokens) -> DataFrame:
    """query_id, doc_id of the documents (doc_id, text) whose text has the string ``part`` of (query_id, part) in it.

    Words inside a part, cut off at neither end, stand in a row in every such
    document: those documents alone are compared.  Parts without such a word,
    where there are any, are compared with all documents.
    """
    words = analyser(F.col("part"))
    inner = F.when(F.size(words) > 2, F.slice(words, 2, F.least(F.size(words) - 2, F.lit(LOOKED_UP))))
    asked = parts.select("query_id", "part", inner.alias("row"))
    out = reading.held_parts(docs, asked.filter("row IS NOT NULL"), analyser)
    if out is None:
        rows = docs.select("doc_id", "text", analyser(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("_n"))
        met = search.in_a_row(rows, asked.filter("row IS NOT NULL")).filter(F.contains("text", "part"))
        out = met.select("query_id", "doc_id", "_n").distinct().drop("_n")
    short = asked.filter("row IS NULL").select("query_id", "part")
    return out if short.isEmpty() else out.unionByName(docs.join(short, F.contains("text", "part")).select("query_id", "doc_id"))


def hits_at(cases: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """k, hits, total: how many of all cases have a position of at most k; only counts are shuffled."""
    counted = cases.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("position") <= k).alias(f"hits_{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hits_{k}").alias("hits")) for k in ks])
    return counted.select(F.explode(rows).alias("x"), "total").select("x.k", "x.hits", "total")


def metrics(cases: DataFrame, *group: str) -> DataFrame:
    """Per group: cases, hits, hit rate in percent, mean and exact median position, all positions."""
    return cases.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"),
        F.count("position").alias("hits"),
        F.round(100 * F.count("position") / F.count(F.lit(1)), 2).alias("hit_rate"),
        F.round(F.avg("position"), 2).alias("mean_position"),
        F.median("position").alias("median_position"),
        F.array_sort(F.collect_list("position")).alias("positions"),
    )


def hit_at(k: int, positions: Column) -> Column:
    """How many positions are at most k."""
    return F.size(F.filter(positions, lambda p: p <= k))


def padded(positions: Column, total: Column) -> Column:
    """One entry per test: the positions, then zeros for misses."""
    return F.concat(positions, F.array_repeat(F.lit(0), F.greatest(total - F.size(positions), F.lit(0)).cast("int")))


def full_against_truncated(results: DataFrame, *group: str) -> DataFrame:
    """Self-join of results (…, query_type, position) on their base type: full and truncated positions side by side."""
    base = results.withColumn("base", F.regexp_replace("query_type", "_truncated_50$", ""))
    full = base.filter(F.col("query_type") == F.col("base")).withColumnRenamed("position", "full_position")
    cut = base.filter(F.col("query_type") != F.col("base")).withColumnRenamed("position", "truncated_position")
    keys = [*group, "base"]
    return full.select(*keys, "full_position").join(cut.select(*keys, "truncated_position"), keys)


def request_metrics(requests: DataFrame, *group: str) -> DataFrame:
    """Per group of requests (…, ok, seconds, position): all, answered, their share in percent, found, mean seconds of answered ones."""
    percent = lambda x: F.round(100 * x / F.count(F.lit(1)), 2)
    return requests.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("ok").alias("successful"),
        percent(F.count_if("ok")).alias("success_rate"),
        F.count("position").alias("found"),
        percent(F.count("position")).alias("hit_rate"),
        F.round(F.avg(F.when(F.col("ok"), F.col("seconds"))), 3).alias("mean_seconds"),
    )


def flattened(summary: Column) -> Column:
    """A JSON summary {algorithm: {query type: {metric: value}}} as an array of rows (algorithm, query_type, base, truncated, metrics)."""
    parsed = F.from_json(summary, "map<string,map<string,map<string,string>>>")
    per_type = lambda a: F.transform(
        F.map_entries(a["value"]),
        lambda t: F.struct(
            a["key"].alias("algorithm"),
            t["key"].alias("query_type"),
            F.regexp_replace(t["key"], "_truncated_50$", "").alias("base"),
            t["key"].contains("truncated").alias("truncated"),
            t["value"].alias("metrics"),
        ),
    )
    return F.flatten(F.transform(F.map_entries(parsed), per_type))


def place_in(name: Column, order: list[str]) -> Column:
    """A category's place in its given order, from 0; null for names that aren't in it."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), name)
    return F.when(at > 0, (at - 1).cast("int"))
