"""Maintenance, filters, evaluation tables and readers over the relational tables.

Orders stand for posts and order lines for their formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemniscate.functions.text import int_list
from lemniscate.operators import evaluate, fusion, maintain
from lemniscate.plans.catalog import Catalog
from lemniscate.session import table
from lemniscate.sources.readers import engine_results, new_questions

C = Catalog()


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("post_id"), (F.col("o_orderkey") % 7).cast("int").alias("formulas_count"), "o_orderstatus", "o_totalprice")


def _formulas(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("l_returnflag") != "R", F.array("l_tax", "l_discount"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("post_id"), F.col("l_linenumber").alias("ord"), "l_partkey", "l_suppkey", v.alias("slt_vector"), F.array("l_quantity").alias("opt_vector"))


@C.add("SELECT l_orderkey AS post_id, l_linenumber AS ord, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def posts_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas whose post exists."""
    return maintain.those_of(_formulas(spark, sf), _posts(spark, sf).filter("o_orderstatus = 'F'"), "post_id").select("post_id", "ord", "l_partkey")


AUDIT_SQL = """WITH f AS (SELECT l_orderkey AS post_id, count(*) AS found, count_if(l_returnflag <> 'R') AS n_complete FROM lineitem GROUP BY 1),
a AS (SELECT o_orderkey AS post_id, o_orderkey % 7 AS expected, coalesce(found, 0) AS found, coalesce(n_complete, 0) AS n_complete FROM orders LEFT JOIN f ON o_orderkey = post_id WHERE o_orderkey % 7 > 0),
d AS (SELECT *, found < expected OR n_complete < found AS del FROM a) """


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    marked = _formulas(spark, sf).select("post_id", maintain.complete("slt_vector", "opt_vector").alias("complete"))
    return maintain.audit(_posts(spark, sf), marked)


@C.add(AUDIT_SQL + "SELECT count(*) AS processed, count_if(NOT del) AS ok, count_if(del) AS delete_posts, coalesce(sum(CASE WHEN del THEN found END), 0)::BIGINT AS delete_formulas FROM d")
def sanitize_stats(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.audit_stats(_audited(spark, sf))


@C.add(AUDIT_SQL + "SELECT l_orderkey AS post_id, l_linenumber AS ord, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT post_id FROM d WHERE del)")
def sanitize_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas that are left when posts without all vectors are deleted."""
    return maintain.pruned(_posts(spark, sf), _formulas(spark, sf), _audited(spark, sf))[1].select("post_id", "ord", "l_partkey")


@C.add("SELECT d.doc_id, d.lang, coalesce(l.quality::VARCHAR, d.source) AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def upsert_partial(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of an update replace the old ones where the update has them."""
    old = table(spark, sf, "documents").select("doc_id", "lang", "source")
    new = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("source"))
    return maintain.updated(old, new, "doc_id")


@C.add(
    "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) "
    "UNION ALL SELECT doc_id, 'xx', toxic::VARCHAR FROM labels"
)
def index_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents replaced by key."""
    old = table(spark, sf, "documents").select("doc_id", "lang", "source")
    new = table(spark, sf, "labels").select("doc_id", F.lit("xx").alias("lang"), F.col("toxic").cast("string").alias("source"))
    return maintain.replaced(old, new, "doc_id")


@C.add("SELECT source, count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def missing_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Posts that still miss a vector, by source."""
    return maintain.without(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("missing"))


@C.add("SELECT l_orderkey AS post_id, concat(l_orderkey, '_', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) AS _id FROM lineitem")
def formula_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of formulas without an id: the post and the number within it."""
    rows = _formulas(spark, sf).withColumn("formula_id", F.lit(None).cast("string")).withColumn("ord", F.struct("ord", "l_partkey", "l_suppkey"))
    return maintain.formula_keys(rows).select("post_id", "_id")


@C.add("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS n FROM lineitem) WHERE n = 1")
def latest_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.latest(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber")


@C.add("SELECT o_orderkey AS post_id, o_orderpriority AS title FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 100 ORDER BY o_orderkey LIMIT 15000")
def xml_posts_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Questions above the checkpoint, capped as ingest is."""
    posts = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("post_id"), F.when(F.col("o_orderstatus") == "F", "1").otherwise("2").alias("post_type"), F.col("o_orderpriority").alias("title")
    )
    return new_questions(posts, 100).select("post_id", "title")


@C.add("SELECT formulas_count, count(*) AS n FROM (SELECT count(*) AS formulas_count FROM lineitem GROUP BY l_orderkey) GROUP BY formulas_count")
def hit_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Distribution of formulas per post."""
    return _formulas(spark, sf).groupBy("post_id").agg(F.count(F.lit(1)).alias("formulas_count")).groupBy("formulas_count").agg(F.count(F.lit(1)).alias("n"))


@C.add("SELECT event_type, user_id % 5 AS kind, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def group_mean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 5).alias("kind")).agg(F.round(F.avg("value"), 6).alias("mean"))


@C.add("SELECT event_type, round(avg(CASE WHEN event_id % 2 = 0 THEN value END), 6) AS full_mean, round(avg(CASE WHEN event_id % 2 = 1 THEN value END), 6) AS cut_mean FROM events GROUP BY event_type")
def summary_means(spark: SparkSession, sf: str) -> DataFrame:
    """Means side by side for two kinds of rows."""
    even = F.col("event_id") % 2 == 0
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.round(F.avg(F.when(even, F.col("value"))), 6).alias("full_mean"), F.round(F.avg(F.when(~even, F.col("value"))), 6).alias("cut_mean")
    )


@C.add(
    """WITH g AS (SELECT l_suppkey, list(l_linenumber ORDER BY l_linenumber) AS p, count(*) + 2 AS total FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, unnest(list_concat(p, [0, 0])) AS position FROM g"""
)
def expand_positions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per test; misses are zero."""
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("p"), (F.count(F.lit(1)) + 2).alias("total"))
    return g.select("l_suppkey", F.explode(evaluate.padded(F.col("p"), F.col("total"))).alias("position"))


@C.add(
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n, CASE c_custkey % 3 WHEN 0 THEN c_custkey + c_nationkey WHEN 1 THEN c_custkey END AS total FROM customer"
)
def list_literals(spark: SparkSession, sf: str) -> DataFrame:
    """Lists written as text, lone numbers and junk."""
    k, x = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    kind = F.col("c_custkey") % 3
    written = F.when(kind == 0, F.concat(F.lit("["), k, F.lit(", "), x, F.lit("]"))).when(kind == 1, k).otherwise("none")
    rows = table(spark, sf, "customer").select("c_custkey", int_list(written).alias("l"))
    total = F.when(F.size("l") > 0, F.aggregate("l", F.lit(0).cast("long"), lambda a, v: a + v))
    return rows.select("c_custkey", F.size("l").alias("n"), total.alias("total"))


@C.add(
    """WITH r AS (SELECT label AS query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings), n AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1),
s AS (SELECT query_id, n, unnest(range(1, 101)) AS place FROM n) SELECT query_id, place::INTEGER AS place, doc_id FROM s JOIN r USING (query_id) WHERE rank = (place - 1) % n + 1"""
)
def composite_output(spark: SparkSession, sf: str) -> DataFrame:
    """Rankings repeated from the top until a hundred places are filled."""
    ranked = table(spark, sf, "embeddings").select(
        F.col("label").alias("query_id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank"), F.col("vec_id").alias("doc_id")
    )
    return fusion.cycled(ranked, 100)


@C.add(
    """SELECT concat('q', conv_id) AS query, concat('d', turn) AS doc_id, length(text)::DOUBLE AS score, count_if(role = 'user') OVER w AS n_expression
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"""
)
def engine_result_parse(spark: SparkSession, sf: str) -> DataFrame:
    """A record stream made of conversations: each one a query, each user turn an expression, each turn a result."""
    t = table(spark, sf, "conversations")
    turn = F.col("turn").cast("double")
    opened = t.groupBy("conv_id").agg(F.lit(-1.0).alias("line")).select("conv_id", "line", F.concat(F.lit("Q\tq"), "conv_id").alias("value"))
    said = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    expressions = t.withColumn("n", F.count_if(F.col("role") == "user").over(said)).select(
        "conv_id", turn.alias("line"), F.concat(F.lit("E\t"), F.col("n").cast("string")).alias("value")
    )
    results = t.select("conv_id", (turn + 0.5).alias("line"), F.concat_ws("\t", F.lit("R"), F.concat(F.lit("d"), "turn"), F.lit("0"), F.lit("x"), F.length("text").cast("string")).alias("value"))
    lines = opened.unionByName(expressions).unionByName(results).withColumnRenamed("conv_id", "file")
    return engine_results(lines).select("query", "doc_id", "score", F.col("query_expression").cast("long").alias("n_expression"))


@C.add("SELECT l_shipdate::DATE AS day, count(*) AS n, sum(l_quantity) AS total, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1")
def mergeable_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counters and sets that merge over partitions."""
    return table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"), F.count_distinct("l_suppkey").alias("n_suppliers")
    )


@C.add("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS not_found, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS found")
def set_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Ids found and not found."""
    there = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("there")).distinct()
    both = table(spark, sf, "documents").select("doc_id").distinct().join(there, "doc_id", "left")
    return both.agg(F.count_if(F.col("there").isNull()).alias("not_found"), F.count_if("there").alias("found"))


@C.add("SELECT doc_id FROM (SELECT doc_id, md5(concat(doc_id, '-42')) AS h FROM documents) ORDER BY h, doc_id LIMIT 100")
def sample_posts(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred posts drawn by hash, the same ones on every run."""
    return table(spark, sf, "documents").select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-42"))).alias("h")).orderBy("h", "doc_id").limit(100).select("doc_id")
