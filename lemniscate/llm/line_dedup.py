"""Line dedup by site-relative frequency.

Documents are grouped by host.  For each line the pages of the host that
contain it are divided by the host's pages; lines above the boilerplate ratio
go.  Pages of one host with the same text count as one page, so a document
that was merely copied doesn't turn into boilerplate.

Cases: lines are compared without the white space at their ends; lines
without a word are never counted nor dropped; a null text stays null and
holds no lines; a null host is a host of its own; repeated rows are one page;
an empty table gives an empty result; other columns are passed through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemniscate.llm.common import join_counted, packed, stored, unpacked

#: Characters that are cut from both ends of a line before lines are compared.
SPACE = " \t\x0b\x0c\r"


@dataclass(frozen=True)
class LineRules:
    #: A line is boilerplate on more than this share of its host's pages.
    max_ratio: float = 0.1
    #: On fewer pages than this nothing is boilerplate.
    min_pages: int = 5
    #: A table of boilerplate lines up to this size is broadcast; of a larger one the hot hosts are, and the others are joined.
    broadcast_bytes: int = 8 << 20


def _trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACE))


def boilerplate(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per host that has boilerplate: ``host``, ``keys`` (digests of the trimmed lines), ``n_pages``, ``n_rows``."""
    pages = docs.select(
        F.col("source").alias("host"),
        F.xxhash64("text").alias("page"),
        F.array_distinct(F.filter(F.transform(F.split("text", "\n", -1), _trimmed), lambda x: x != "")).alias("lines"),
    )
    totals = stored(pages.groupBy("host").agg(F.count_distinct("page").alias("n_pages"), F.count(F.lit(1)).alias("n_rows")), "host_totals", lasting=True)
    n_rows = totals.agg(F.sum("n_rows")).first()[0] or 0
    keyed = pages.select("host", "page", F.explode("lines").alias("line")).select(
        "host", "page", F.unhex(F.md5("line")).alias("key")
    )
    seen = keyed.distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= rules.min_pages)
    common = (
        join_counted(seen, totals.withColumnRenamed("host", "h"), "host", "h", "n_rows", n_rows)
        .filter(F.col("n") > rules.max_ratio * F.col("n_pages"))
        .select("host", "key", "n_pages", "n_rows")
    )
    # A host has at most (lines per page) / max_ratio such lines, so the array is short.
    return common.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("keys"), F.max("n_pages").alias("n_pages"), F.max("n_rows").alias("n_rows"))


def _cleaned(docs: DataFrame, rules: LineRules, columns: list[Column]) -> DataFrame:
    found = stored(boilerplate(docs, rules), "boilerplate").select(F.col("host").alias("_host"), "keys", "n_rows")
    size = found.agg(F.sum(F.size("keys") * 16 + F.coalesce(F.length("_host"), F.lit(0)) + 64)).first()[0] or 0
    rows = packed(docs).select("row", F.col("row.source").alias("host"))
    if size <= rules.broadcast_bytes:
        joined = rows.join(F.broadcast(found), F.col("host").eqNullSafe(F.col("_host")), "left")
    else:
        joined = join_counted(rows, found, "host", "_host", "n_rows", docs.count(), "left")
    lines = F.split("row.text", "\n", -1)
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("keys"), F.unhex(F.md5(_trimmed(x)))))
    joined = joined.withColumn("_kept", F.when(F.col("keys").isNotNull(), kept))
    return joined.select(
        "row",
        F.when(F.col("_kept").isNull(), F.col("row.text")).otherwise(F.array_join("_kept", "\n")).alias("clean"),
        F.when(F.col("_kept").isNull(), 0).otherwise(F.size(lines) - F.size("_kept")).cast("long").alias("n_dropped"),
        *columns,
    )


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text`` and ``n_chars`` counted anew; every row and column stays."""
    df = _cleaned(docs, rules, [])
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(df, docs.columns, changed)


def line_report(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Per document: ``doc_id``, ``text`` without boilerplate lines, ``n_dropped`` lines."""
    docs = docs.select("doc_id", "text", "source")
    return _cleaned(docs, rules, []).select(F.col("row.doc_id").alias("doc_id"), F.col("clean").alias("text"), "n_dropped")
