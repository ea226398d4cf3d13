"""Sinks: run files, JSON and CSV reports, one text file per formula, keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_lines(ranked: DataFrame, run_id: str) -> DataFrame:
    """Ranked rows (query_id, id, rank, score) as lines ``query xxx id rank score Run_<id>``."""
    return ranked.select(F.concat_ws(" ", "query_id", F.lit("xxx"), "id", "rank", "score", F.lit(f"Run_{run_id}")).alias("line"))


def write_run(ranked: DataFrame, path: str, run_id: str) -> None:
    """A run as text files, each holding whole queries in rank order."""
    dealt = ranked.repartition("query_id").sortWithinPartitions("query_id", "rank")
    run_lines(dealt, run_id).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_tuples(tuples: DataFrame, path: str, named: bool = False) -> None:
    """Tuples (dir, formula_id, s1, s2, rel_path, loc) as tab-separated lines, one folder per ``dir``.

    ``named`` puts the formula's id before each line, so that a folder can hold
    any number of formulas and need not be made for each.
    """
    ids = [F.coalesce(F.col("formula_id").cast("string"), F.lit(""))] if named else []
    line = F.concat_ws("\t", *ids, "s1", "s2", "rel_path", "loc").alias("value")
    tuples.select("dir", line).write.mode("overwrite").partitionBy("dir").text(path)


def composite_lines(places: DataFrame) -> DataFrame:
    """Ranked places (query_id, place, doc_id, positions, keywords) of multi-formula queries as lines.

    Formula positions stand between ``*M*`` marks, keywords between ``*W*`` marks.
    """
    marked = lambda mark, c: F.concat(F.lit(mark), F.array_join(c, ","), F.lit(mark))
    parts = ["query_id", "place", "doc_id", marked("*M*", F.col("positions").cast("array<string>")), marked("*W*", F.col("keywords"))]
    return places.select(F.concat_ws("\t", *parts).alias("line"))


def write_map(pairs: DataFrame, path: str) -> None:
    """An encoder map (kind, symbol, id) as tab-separated text."""
    pairs.select("kind", "symbol", "id").write.mode("overwrite").option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def create_table(df: DataFrame, name: str, replace: bool = False) -> None:
    """Save as a table; an existing one is replaced only on request."""
    df.write.mode("overwrite" if replace else "errorifexists").saveAsTable(name)
