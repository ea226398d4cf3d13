"""Record files read by many tasks, however large one file is.

Spark cuts a file of lines into byte ranges.  A line's place is its range's
start and its row in the range; scans over places recover records that began in
an earlier range.

Cases: an empty file has no lines; a file's last line may lack its line feed;
``\\r\\n`` ends a line as ``\\n`` does; a record that is never finished is left
out; files of equal content are files of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemniscate.functions.text import stripped
from lemniscate.operators.scans import running
from lemniscate.session import stored

#: What ends a LaTeX record: its id after the last mark of a line.
ENDS = r"\$\$[^$]*$"
#: Lines of prose, which are skipped.
PROSE = "USD|<p|<blockquote"


def text_lines(spark: SparkSession, path: str | list[str], whole: bool = False) -> DataFrame:
    """file, line (its place; sorts as lines stand in the file), value."""
    lines = spark.read.option("wholetext", whole).text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return lines.select(F.col("_metadata.file_path").alias("file"), place.alias("line"), "value")


def _kept(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines above a file's first blank line (which its first line isn't), prose left out."""
    lines = stored(text_lines(spark, path), "lines")
    first = lines.groupBy("file").agg(F.min("line").alias("first"))
    blank = lines.filter("value = ''").join(first, "file").filter("line > first").groupBy("file").agg(F.min("line").alias("blank"))
    return lines.join(blank, "file", "left").filter(F.col("blank").isNull() | (F.col("line") < F.col("blank"))).filter(~F.col("value").rlike(PROSE)).drop("blank")


def latex_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, ord, formula_id, formula of LaTeX collections: records ``latex$$id`` that may run over lines."""
    ends = F.col("value").rlike(ENDS)
    lines = running(_kept(spark, path), ["line"], ["file"], {"ord": ends.cast("long")})
    total = lines.filter(ends).groupBy("file").agg(F.max("ord").alias("most"))
    # What follows the last end is no record and may be long.
    records = lines.join(total, "file").filter("ord <= most").groupBy("file", "ord").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("l"))
    record = F.array_join(F.transform("l", lambda x: x["value"]), "\n")
    half = lambda n: stripped(F.element_at(F.split(record, r"\$\$"), n))
    return records.select("file", F.col("ord").cast("int").alias("ord"), half(-1).alias("formula_id"), F.regexp_replace(half(1), "\n", " ").alias("formula"))


def latex_triples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, ord, formula_id, formula: every third part of a file split at its marks, and the part after it."""
    marks = (F.size(F.split("value", r"\$\$")) - 1).cast("long")
    lines = running(text_lines(spark, path), ["line"], ["file"], {"before": marks})
    total = lines.groupBy("file").agg(F.sum(marks).alias("marks"))
    parts = lines.select("file", "line", "before", F.posexplode(F.split("value", r"\$\$")).alias("n", "piece")).withColumn("part", F.col("before") + F.col("n"))
    wanted = parts.join(total, "file").filter((F.col("part") % 3 != 0) & (F.floor(F.col("part") / 3) < F.floor(F.col("marks") / 3)))
    joined = wanted.groupBy("file", "part").agg(F.array_sort(F.collect_list(F.struct("line", "n", "piece"))).alias("l"))
    text = F.trim(F.array_join(F.transform("l", lambda x: x["piece"]), "\n"))
    both = joined.groupBy("file", F.floor(F.col("part") / 3).cast("int").alias("ord")).agg(
        F.max(F.when(F.col("part") % 3 == 1, text)).alias("formula"), F.max(F.when(F.col("part") % 3 == 2, text)).alias("formula_id")
    )
    return both.select("file", "ord", "formula_id", "formula")
