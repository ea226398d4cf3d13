"""Keeping the collections consistent: upserts, deletions, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Whole rows of ``new`` in place of those of ``old`` with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def updated(old: DataFrame, new: DataFrame, key: str, insert: bool = False) -> DataFrame:
    """Columns that ``new`` has and that aren't null there replace the old ones; rows without an update stay."""
    changed = [c for c in new.columns if c != key]
    n = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in changed])
    both = old.join(n, F.col(key) == F.col("_key"), "full_outer" if insert else "left")
    columns = [
        F.coalesce(key, "_key").alias(key) if c == key else F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c)
        for c in old.columns
    ]
    return both.select(*columns)


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return rows.withColumn("_n", newest).filter("_n = 1").drop("_n")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def those_of(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    return rows.join(kept.select(key).distinct(), key, "left_semi")


def formula_keys(formulas: DataFrame) -> DataFrame:
    """``_id``: the formula's id, else its post's id and its number within the post."""
    n = F.row_number().over(Window.partitionBy("post_id").orderBy("ord")) - 1
    return formulas.withColumn("_id", F.coalesce("formula_id", F.concat_ws("_", F.col("post_id").cast("string"), n.cast("string"))))


def complete(*vectors: str) -> Column:
    """Whether all the vectors are there and not empty."""
    out = F.lit(True)
    for v in vectors:
        out = out & F.coalesce(F.size(v) > 0, F.lit(False)) & F.col(v).isNotNull()
    return out


def audit(posts: DataFrame, formulas: DataFrame) -> DataFrame:
    """Per post with formulas: expected and found formulas, how many are complete, and whether to delete it.

    ``posts`` (post_id, formulas_count), ``formulas`` (post_id, complete).
    """
    found = formulas.groupBy("post_id").agg(F.count(F.lit(1)).alias("found"), F.count_if("complete").alias("n_complete"))
    joined = posts.filter("formulas_count > 0").join(found, "post_id", "left").na.fill(0, ["found", "n_complete"])
    return joined.withColumn("delete", (F.col("found") < F.col("formulas_count")) | (F.col("n_complete") < F.col("found")))


def audit_stats(audited: DataFrame) -> DataFrame:
    return audited.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(~F.col("delete")).alias("ok"),
        F.count_if("delete").alias("delete_posts"),
        F.coalesce(F.sum(F.when(F.col("delete"), F.col("found"))), F.lit(0)).alias("delete_formulas"),
    )


def pruned(posts: DataFrame, formulas: DataFrame, audited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both collections without the posts to delete."""
    gone = audited.filter("delete").select("post_id")
    return without(posts, gone, "post_id"), without(formulas, gone, "post_id")
