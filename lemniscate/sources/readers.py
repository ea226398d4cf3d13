"""Sources: posts in XML, formula tables, formula collections in files, result and control files."""

from __future__ import annotations

import glob
import os
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemniscate.functions.html import formulas_count, html_text, html_text_with_latex, html_text_without_formulas, title_and_body
from lemniscate.functions.text import ascii_id, stripped
from lemniscate.operators.ranking import numbered
from lemniscate.operators.scans import carried
from lemniscate.sources.records import latex_records

#: Posts taken by one ingest.
INGEST_CAP = 15_000
QUESTION = "1"


class Reader(Protocol):
    """A formula collection and its queries, as DataFrames (formula_id, formula, ord)."""

    def collection(self, spark: SparkSession) -> DataFrame: ...

    def queries(self, spark: SparkSession) -> DataFrame: ...


def posts_xml(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a posts dump: post_id, post_type, title, body (entities resolved)."""
    rows = spark.read.format("xml").option("rowTag", "row").option("inferSchema", False).schema("_Id string, _PostTypeId string, _Title string, _Body string").load(path)
    return rows.select(F.col("_Id").cast("long").alias("post_id"), F.col("_PostTypeId").alias("post_type"), F.col("_Title").alias("title"), F.col("_Body").alias("body"))


def new_questions(posts: DataFrame, after: int = -1, cap: int | None = INGEST_CAP) -> DataFrame:
    """Questions with an id above ``after``, at most ``cap`` of them, smallest ids first."""
    found = posts.filter((F.col("post_type") == QUESTION) & (F.col("post_id") > after))
    return found if cap is None else found.orderBy("post_id").limit(cap)


def post_documents(posts: DataFrame) -> DataFrame:
    """Posts with the texts that are searched: whole, with LaTeX, and without formulas."""
    html = title_and_body(F.col("title"), F.col("body"))
    return posts.withColumn("text", html).select(
        F.col("post_id").cast("string").alias("post_id"),
        "text",
        html_text("text").alias("text_without_html"),
        html_text_with_latex("text").alias("text_latex_search"),
        html_text_without_formulas("text").alias("text_without_formula"),
        formulas_count(F.col("text")).alias("formulas_count"),
    )


def formula_files(folder: str) -> list[str]:
    return sorted(glob.glob(os.path.join(folder, "*.tsv")))


def formula_tsv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Formula tables with a header, of any field size: all columns as strings."""
    return spark.read.option("sep", "\t").option("header", True).option("maxCharsPerColumn", -1).option("quote", '"').csv(paths)


def usable_formulas(formulas: DataFrame, posts: DataFrame) -> DataFrame:
    """Formulas of questions that have an id, a formula and a post that exists."""
    there = [F.coalesce(F.trim(c), F.lit("")) != "" for c in ("id", "formula", "post_id")]
    kept = formulas.filter(there[0] & there[1] & there[2] & (F.col("type") == "question"))
    return kept.join(posts.select(F.col("post_id").cast("string").alias("post_id")), "post_id", "left_semi")


def tokenised_collection(spark: SparkSession, path: str) -> DataFrame:
    """Formulas already cut into tuples, one tuple a line and one formula a file: formula_id, tuples."""
    files = _whole_files(spark, path)
    lines = F.filter(F.split("content", "\r?\n"), lambda x: F.trim(x) != "")
    return files.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("formula_id"), lines.alias("tuples"))


def holding(docs: DataFrame, *parts: str, column: str = "content") -> DataFrame:
    """Documents whose text has any of the given parts."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(column, F.lit(p))
    return docs.filter(out)


# Fixed value: a math element, with or without a namespace prefix.
MATH = r"(?s)<(?:\w+:)?math\b.*?</(?:\w+:)?math>"


def math_tokens(content: Column) -> Column:
    """Math elements of a page without namespace prefixes, those of ``mws:qvar`` excepted."""
    found = F.regexp_extract_all(content, F.lit(MATH), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, r"(</?)(?!mws:qvar)\w+:(?=[\w])", "$1"))


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(path, wholetext=True).select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file"), F.col("value").alias("content"))


def wiki_collection(spark: SparkSession, root: str) -> DataFrame:
    """Formulas of ``<root>/<dir>/Articles/*.html``: formula_id ``<ASCII file name>:<n>``, formula, ord."""
    pages = _whole_files(spark, f"{root}/*/Articles/*.html")
    stem = ascii_id(F.regexp_replace("file", r"\.html$", ""))
    rows = pages.select(stem.alias("name"), F.posexplode(math_tokens(F.col("content"))).alias("ord", "formula"))
    return rows.select(F.concat_ws(":", "name", F.col("ord").cast("string")).alias("formula_id"), "formula", "ord")


def wiki_queries(spark: SparkSession, folder: str, n: int = 20) -> DataFrame:
    """Queries 1..n, one file each; a file's last formula counts."""
    pages = _whole_files(spark, f"{folder}/*.html").withColumn("query_id", F.regexp_extract("file", r"^(\d+)\.html$", 1).try_cast("int"))
    last = F.element_at(math_tokens(F.col("content")), -1)
    return pages.filter(F.col("query_id").between(1, n) & (F.size(math_tokens(F.col("content"))) > 0)).select("query_id", last.alias("formula"))


def latex_lines(content: Column) -> Column:
    """Records ``latex$$id`` of a file, which may run over lines; stops at the first blank line, skips prose lines."""
    before = F.substring_index(F.regexp_replace(content, "\r\n", "\n"), "\n\n", 1)
    lines = F.filter(F.split(before, "\n"), lambda x: ~x.rlike("USD|<p|<blockquote"))
    return F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(r"(?s)(.*?)\$\$([^\n$]*)(?:\n|$)"), F.lit(0))


def latex_collection(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """formula_id, formula, ord of a LaTeX collection; a large file is read by many tasks."""
    return latex_records(spark, path).select("formula_id", "formula", "ord")


def latex_triples(content: Column) -> Column:
    """A file split at ``$$``: every third part from the second is a formula, the one after it its id."""
    parts = F.split(content, r"\$\$")
    n = F.floor((F.size(parts) - 1) / 3).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.trim(F.get(parts, 3 * i + 1)).alias("formula"), F.trim(F.get(parts, 3 * i + 2)).alias("formula_id")))


def document(file: Column) -> Column:
    """Extension of a file name."""
    return F.lower(F.regexp_extract(file, r"\.([^./]+)$", 1))


def document_list(docs: DataFrame, chunk: int) -> DataFrame:
    """Documents (path) numbered from 0 with their chunk and place in it."""
    return numbered(docs, ["path"], name="doc_id").withColumn("chunk", F.floor(F.col("doc_id") / chunk)).withColumn("place", F.col("doc_id") % chunk)


def nth_formula(content: Column, n: Column) -> Column:
    return F.get(math_tokens(content), n)


def formula_xml_id(formula: Column) -> Column:
    return F.regexp_extract(formula, r'\bid="([^"]*)"', 1)


def route(extension: Column) -> Column:
    """How a file is parsed: tex, xml, or null for files that aren't."""
    return F.when(extension == "tex", "tex").when(extension.isin("xhtml", "mathml", "mml", "html"), "xml")


def encoder_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("quote", "").schema("kind string, symbol string, id int").csv(path).na.fill("", ["symbol"])


def config(spark: SparkSession, path: str, sep: str = ",") -> dict[str, str | int]:
    """Key, value lines; values of digits are numbers.  A training configuration or control file has a few dozen."""
    rows = spark.read.text(path).select(F.split("value", sep, 2).alias("kv")).filter(F.size("kv") == 2).collect()
    pairs = ((r["kv"][0].strip(), r["kv"][1].strip()) for r in rows)
    return {k: int(v) if v.lstrip("-").isdigit() else v for k, v in pairs}


def control(spark: SparkSession, path: str) -> dict[str, str | int]:
    return config(spark, path, "\t")


def config_grid(**choices: list) -> list[dict]:
    """All combinations of parameter choices."""
    out: list[dict] = [{}]
    for k, values in choices.items():
        out = [c | {k: v} for c in out for v in values]
    return out


def engine_results(lines: DataFrame) -> DataFrame:
    """Result rows of a record stream (file, line, value): Q opens a query, E an expression, R a result.

    Each record gets the query and expression that were last opened above it,
    carried forward range by range, so one file may take any number of tasks.
    """
    parts = F.split("value", "\t")
    rows = lines.select("file", "line", F.get(parts, F.lit(0)).alias("kind"), parts.alias("p"))
    opened = lambda kind: F.when(F.col("kind") == kind, F.get("p", F.lit(1)))
    rows = carried(rows, ["line"], ["file"], {"query": opened("Q"), "query_expression": opened("E")})
    field = lambda n: F.get("p", F.lit(n))
    return rows.filter("kind = 'R'").select(
        "query", "query_expression", field(1).alias("doc_id"), field(2).alias("location"), field(3).alias("expression"), field(4).cast("double").alias("score")
    )


def keyword_results(lines: DataFrame) -> DataFrame:
    """As :func:`engine_results`, of a text engine: Q, P (keyword) and M (doc_id, score) records."""
    parts = F.split("value", "\t")
    rows = lines.select("file", "line", F.get(parts, F.lit(0)).alias("kind"), parts.alias("p"))
    rows = carried(rows, ["line"], ["file"], {"query": F.when(F.col("kind") == "Q", F.get("p", F.lit(1)))})
    return rows.filter("kind = 'M'").select("query", F.get("p", F.lit(1)).alias("doc_id"), F.get("p", F.lit(2)).cast("double").alias("score"))
