"""Formula trees, tuples, tokens and ids over formulas made from order lines.

A line's formula is part + supplier line-number quantity, written as markup;
what each operator must give for it is known in closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemniscate.operators import formulas, subword
from lemniscate.operators.subword import SubwordRules
from lemniscate.plans.catalog import Catalog
from lemniscate.session import table

C = Catalog()
NS = "http://www.w3.org/1998/Math/MathML"


def _markup(template: str) -> Column:
    out = F.lit(f'<math xmlns="{NS}">{template}</math>')
    for mark, c in (("@p", "l_partkey"), ("@s", "l_suppkey"), ("@n", "l_linenumber")):
        out = F.replace(out, F.lit(mark), F.col(c).cast("string"))
    return out


#: a subscripted variable plus a number, and the same as content.
SLT_FORMULA = "<mrow><msub><mi>x</mi><mn>@n</mn></msub><mo>+</mo><mn>@p</mn></mrow>"
OPT_FORMULA = "<apply><minus/><apply><plus/><ci>y@n</ci><cn>@p</cn></apply><cn>@s</cn></apply>"


def _distinct(spark: SparkSession, sf: str) -> DataFrame:
    """One formula for each distinct (part, supplier, line number)."""
    keys = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber").distinct()
    return keys.withColumn("formula_id", F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 8, "0") for c in ("l_partkey", "l_suppkey", "l_linenumber")]))


def _made(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return _distinct(spark, sf).select("formula_id", _markup(SLT_FORMULA if kind == "slt" else OPT_FORMULA).alias("formula"))


def _parsed(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return formulas.parsed(_made(spark, sf, kind), kind).select("formula_id", "tree", "nodes")


def _tuples(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return formulas.short_enough(formulas.shaped_tuples(_made(spark, sf, kind), "formula_id", kind))


FORMULAS_SQL = """f AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, l_linenumber AS n FROM lineitem),
g AS (SELECT lpad(p::VARCHAR, 8, '0') || '-' || lpad(s::VARCHAR, 8, '0') || '-' || lpad(n::VARCHAR, 8, '0') AS formula_id, p::VARCHAR AS p, s::VARCHAR AS s, n::VARCHAR AS n FROM f)"""
SLT_SQL = f"""{FORMULAS_SQL}, t AS (
SELECT formula_id, 0 AS pos, 'V!x' AS s1, '+' AS s2, 'n' AS rel_path, '-' AS loc FROM g UNION ALL
SELECT formula_id, 1, 'V!x', 'N!' || p, 'nn', '-' FROM g UNION ALL SELECT formula_id, 2, '+', 'N!' || p, 'n', 'n' FROM g UNION ALL
SELECT formula_id, 3, 'N!' || p, '0!', 'n', 'nn' FROM g UNION ALL SELECT formula_id, 4, 'V!x', 'N!' || n, 'b', '-' FROM g UNION ALL
SELECT formula_id, 5, 'N!' || n, '0!', 'n', 'b' FROM g)"""
OPT_SQL = f"""{FORMULAS_SQL}, t AS (
SELECT formula_id, 0 AS pos, 'O!minus' AS s1, 'U!plus' AS s2, '0' AS rel_path, '-' AS loc FROM g UNION ALL
SELECT formula_id, 1, 'O!minus', 'N!' || p, '00', '-' FROM g UNION ALL SELECT formula_id, 2, 'O!minus', 'V!y' || n, '00', '-' FROM g UNION ALL
SELECT formula_id, 3, 'U!plus', 'V!y' || n, '0', '0' FROM g UNION ALL SELECT formula_id, 4, 'V!y' || n, '0!', '0', '00' FROM g UNION ALL
SELECT formula_id, 5, 'U!plus', 'N!' || p, '0', '0' FROM g UNION ALL SELECT formula_id, 6, 'N!' || p, '0!', '0', '00' FROM g UNION ALL
SELECT formula_id, 7, 'O!minus', 'N!' || s, '1', '-' FROM g UNION ALL SELECT formula_id, 8, 'N!' || s, '0!', '0', '1' FROM g)"""


@C.add(f"WITH {SLT_SQL} SELECT * FROM t")
def slt_tuples(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of layout trees."""
    return _tuples(spark, sf, "slt")


@C.add(f"WITH {OPT_SQL} SELECT * FROM t")
def opt_tuples(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of operator trees; operands of an unordered operator share an edge."""
    return _tuples(spark, sf, "opt")


@C.add(f"WITH {FORMULAS_SQL} SELECT formula_id, '[V!x[+[N!' || p || ']],b[N!' || n || ']]' AS slt, '[O!minus,0[U!plus,0[V!y' || n || '],1[N!' || p || ']],1[N!' || s || ']]' AS opt FROM g")
def formula_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Both trees of a formula as text."""
    made = _distinct(spark, sf).select("formula_id", _markup(SLT_FORMULA).alias("slt"), _markup(OPT_FORMULA).alias("opt"))
    return formulas.trees(made, {"slt": "slt", "opt": "opt"}, ["formula_id"])


@C.add(f"WITH {FORMULAS_SQL} SELECT formula_id, 5 AS size, 3 AS depth, 6 AS n_pairs FROM g")
def tree_stats(spark: SparkSession, sf: str) -> DataFrame:
    return formulas.shaped_stats(_made(spark, sf, "opt"), "formula_id", "opt")


def _token_sql(mode: str) -> str:
    """Tokens of a column of symbols; digits of numbers apart where values are shown separately."""
    value = lambda x: f"CASE WHEN {x} LIKE 'N!%' THEN array_to_string(list_transform(range(3, length({x}) + 1), lambda i: substr({x}, i, 1)), ' ') ELSE substr({x}, 3) END"
    kind = lambda x: f"left({x}, 2)"
    made = {
        "value": value,
        "type": kind,
        "both_separated": lambda x: f"{kind(x)} || ' ' || {value(x)}",
        "both": lambda x: x,
    }[mode]
    return ", ".join(f"CASE WHEN contains({x}, '!') THEN {made(x)} ELSE {x} END AS t{k}" for k, x in ((1, "s1"), (2, "s2")))


def _token_query(mode: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        tokens = lambda c: F.array_join(formulas.node_tokens(F.col(c), mode, True), " ")
        return slt_tuples(spark, sf).select("formula_id", "pos", tokens("s1").alias("t1"), tokens("s2").alias("t2"))

    run.__name__ = f"tokens_{mode}"
    return run


for _mode in ("value", "type", "both_separated", "both"):
    C.add(f"WITH {SLT_SQL} SELECT formula_id, pos, {_token_sql(_mode)} FROM t")(_token_query(_mode))


# Symbols of operator trees: type, value, by pair and slot, in order.
IDS_SQL = f"""WITH {OPT_SQL}, parts AS (
SELECT formula_id, pos, 0 AS slot, 'N' AS kind, left(s1, 2) AS symbol FROM t UNION ALL SELECT formula_id, pos, 1, 'N', substr(s1, 3) FROM t UNION ALL
SELECT formula_id, pos, 2, 'N', left(s2, 2) FROM t UNION ALL SELECT formula_id, pos, 3, 'N', substr(s2, 3) FROM t UNION ALL
SELECT formula_id, pos, 4, 'E', left(rel_path, 1) FROM t UNION ALL SELECT formula_id, pos, 5, 'E', substr(rel_path, 2, 1) FROM t WHERE length(rel_path) > 1),
firsts AS (SELECT kind, symbol, min({{'f': formula_id, 'p': pos, 's': slot}}) AS first FROM parts GROUP BY kind, symbol),
ids AS (SELECT kind, symbol, (CASE kind WHEN 'N' THEN 59999 ELSE 499 END + row_number() OVER (PARTITION BY kind ORDER BY first))::INTEGER AS id FROM firsts)"""


def _opt_ids(spark: SparkSession, sf: str) -> DataFrame:
    return formulas.dictionary_of(_made(spark, sf, "opt"), "opt")


@C.add(f"{IDS_SQL} SELECT kind, symbol, id FROM ids")
def encoder_map(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary ids by first occurrence."""
    return _opt_ids(spark, sf)


@C.add(f"{IDS_SQL} SELECT formula_id, pos, string_agg(id::VARCHAR, ' ' ORDER BY slot) AS word FROM parts JOIN ids USING (kind, symbol) GROUP BY formula_id, pos")
def encoded_tuples(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs as words of ids."""
    words, _ = formulas.words_of(_made(spark, sf, "opt"), "opt")
    return words.select("formula_id", "pos", F.array_join(F.col("word").cast("array<string>"), " ").alias("word"))


@C.add(
    r"""WITH w AS (SELECT s_suppkey AS k, '0-' || s_nationkey || '-' || s_suppkey || '-1' AS g, [0, s_nationkey, s_suppkey, 1] AS ids FROM supplier),
g AS (SELECT k, unnest(['0-' || ids[2] || '-' || ids[3], ids[2] || '-' || ids[3] || '-1', g]) AS g FROM w),
d AS (SELECT k, g, unnest(range(0, 8)) AS d FROM g),
v AS (SELECT k, d, avg(('0x' || left(md5(d || ':' || g), 6))::BIGINT / 8388608.0 - 1) AS x FROM d GROUP BY k, d)
SELECT k, string_agg((round(x, 6)::DECIMAL(12, 6))::VARCHAR, ',' ORDER BY d) AS vector FROM v GROUP BY k"""
)
def ngram_mean_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed n-gram vectors of two-symbol words."""
    words = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(0).alias("pos"), F.array(F.col("s_nationkey").cast("int"), F.col("s_suppkey").cast("int")).alias("word"))
    v = formulas.hashed_vectors(words, "k", 8, 3, 6)
    return v.select("k", F.array_join(F.transform("vector", lambda x: F.round(x, 6).cast("decimal(12,6)").cast("string")), ",").alias("vector"))


SUBWORD = SubwordRules(dims=32, buckets=1 << 13, contexts=1 << 12, rounds=2)


def part_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """One formula for each part: a variable by its size, and numbers by its key."""
    made = F.concat(F.lit(f'<math xmlns="{NS}"><mrow><msub><mi>x</mi><mn>'), F.col("p_size").cast("string"), F.lit("</mn></msub><mo>+</mo><mn>"), F.col("p_partkey").cast("string"), F.lit("</mn></mrow></math>"))
    return table(spark, sf, "part").select("p_partkey", made.alias("formula"))


@C.add()
def subword_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of all parts' formulas by a skip-gram model over n-gram buckets, trained on them."""
    found = subword.train_formulas(part_formulas(spark, sf), "slt", "p_partkey", SUBWORD).formula_vectors(part_formulas(spark, sf), "p_partkey")
    return found.select("p_partkey", F.array_join(F.transform("vector", lambda x: F.round(x, 6).cast("decimal(12,6)").cast("string")), ",").alias("vector"))
