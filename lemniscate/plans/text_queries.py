"""LaTeX cleaning, markup and truncation over texts made from table columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemniscate.functions import html, latex, text
from lemniscate.plans.catalog import Catalog
from lemniscate.session import table

C = Catalog()


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_steps(x: str, steps: list[latex.Step]) -> str:
    """The SQL that does what :func:`latex.applied` does."""
    for kind, what, by in steps:
        if kind == "plain":
            x = f"replace({x}, {_sql_text(what)}, {_sql_text(by)})"
        elif what.startswith("(?<"):  # dots not between digits: dots between digits are set aside, the others removed
            aside = f"regexp_replace(regexp_replace({x}, '(\\d)\\.(\\d)', '\\1\x01\\2', 'g'), '(\\d)\\.(\\d)', '\\1\x01\\2', 'g')"
            x = f"replace(replace({aside}, '.', ''), '\x01', '.')"
        else:
            by = by.replace("\\\\", "\\").replace("\\", "\\\\").replace("$1", "\\1").replace("$2", "\\2")
            x = f"regexp_replace({x}, {_sql_text(what)}, {_sql_text(by)}, 'g')"
    return x


# One LaTeX template for each step; @ becomes a line's number, # its quantity.
TEMPLATES: dict[str, str] = {
    "basic": r"$ \left( x_{@} + # \right) \quad \leqslant \textrm{} |y| \\ z $",
    "underset": r"$\underset{x\to@}{lim}f+\underset{i=#}{n}$",
    "operatorname": r"$\operatorname{sen}(@)+\operatorname{lcm}#$",
    "bold": r"$\mathbf{v@}+\mathbb{R}+\boldsymbol{#}+\mathit{x}$",
    "vectors": r"$\vec{v@}+\vec{u}#$",
    "superscripts": r"$x^{@+#}+y^{2}$",
    "parentheses": r"$((x+@))+f(x)+g(#)$",
    "dots": r"$a.b@.5+#.\cdot1.2.3$",
    "angles": r"$sin(@)+\cos(#)+\tan(x)+\sinh(y)+\sec\csc\cot$",
    "special": "$x\u200b@\u2009y\ufeff#$",
    "brackets": "$\u3008@,#\u3009$",
    "primes": r"$f^{\prime}(@)+g'(#)$",
    "mathrm": r"$\mathrm{kg@}+\mathrm{~m}#$",
    "text": r"$x+\text{value @}+\text{}#$",
    "overs": r"$\overline{A@}+\overset{*}{x}+\overrightarrow{P#}+\hat{v}$",
    "integrals": r"$\int_a^b@+(\int)g+\int\int h+\int\int\int#$",
}


def _latex(template: str) -> Column:
    parts = F.lit(template)
    parts = F.replace(parts, F.lit("@"), F.col("l_linenumber").cast("string"))
    return F.replace(parts, F.lit("#"), F.col("l_quantity").cast("int").cast("string"))


def _sql_latex(template: str) -> str:
    return f"replace(replace({_sql_text(template)}, '@', l_linenumber::VARCHAR), '#', l_quantity::INTEGER::VARCHAR)"


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _step_query(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        made = table(spark, sf, "lineitem").select(*KEYS, _latex(TEMPLATES[name]).alias("formula"))
        return made.select(*KEYS, latex.applied(F.col("formula"), latex.STEPS[name]).alias("formula"))

    run.__name__ = f"latex_clean_{name}"
    run.__doc__ = f"The step {name!r} of formula cleaning over one formula per order line."
    return run


for _name in TEMPLATES:
    C.add(f"SELECT {', '.join(KEYS)}, {_sql_steps(_sql_latex(TEMPLATES[_name]), latex.STEPS[_name])} AS formula FROM lineitem")(_step_query(_name))


def _chain_sql(x: str) -> str:
    for name, steps in latex.STEPS.items():
        x = _sql_steps(f"trim({x})" if name == "underset" else x, steps)
    return x


SENTENCE = r"Let  @ be  $\left( x_{@} \right) \leqslant #$ here"


@C.add(
    rf"SELECT {', '.join(KEYS)}, trim(regexp_replace(replace(concat('Let  ', l_linenumber, ' be  ', f, ' here'), '$', ' '), '\s+', ' ', 'g')) AS text FROM "
    rf"(SELECT *, {_chain_sql('raw')} AS f FROM (SELECT *, {_sql_latex(SENTENCE[SENTENCE.index('$') : -5])} AS raw FROM lineitem))"
)
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """Formula spans cleaned inside a sentence."""
    return table(spark, sf, "lineitem").select(*KEYS, latex.cleaned(_latex(SENTENCE)).alias("text"))


@C.add(
    r"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('a $x+', l_linenumber, '$ b $', repeat('y', l_linenumber + 3), '$ c $$ z_', l_quantity::INTEGER, '+1 $$') AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(s, '\$\$.*?\$\$|\$.*?\$'), lambda x: trim(replace(x, '$', ''))), lambda x: length(x) > 5), lambda x: '$' || x || '$'), ' ') AS formulas FROM t"""
)
def extract_formulas(spark: SparkSession, sf: str) -> DataFrame:
    s = F.concat(
        F.lit("a $x+"), F.col("l_linenumber").cast("string"), F.lit("$ b $"), F.repeat(F.lit("y"), F.col("l_linenumber") + 3),
        F.lit("$ c $$ z_"), F.col("l_quantity").cast("int").cast("string"), F.lit("+1 $$"),
    )
    return table(spark, sf, "lineitem").select(*KEYS, F.array_join(latex.formulas(s), " ").alias("formulas"))


@C.add(
    r"""WITH t AS (SELECT doc_id, text, regexp_extract(text, '(?is)\$\$.*?\$\$|\$.*?\$|<math.*?</math>|<mml:math.*?</mml:math>') AS f FROM documents),
b AS (SELECT doc_id, text, f, list_filter(regexp_split_to_array(CASE WHEN f = '' THEN '' ELSE left(text, instr(text, f) - 1) END, '\s+'), lambda x: x <> '') AS w FROM t)
SELECT doc_id, CASE WHEN f = '' THEN trim(left(text, 50)) WHEN len(w) = 0 THEN trim(f) ELSE trim(concat(array_to_string(w[-3:], ' '), ' ', f)) END AS text FROM b"""
)
def truncate_first_formula(spark: SparkSession, sf: str) -> DataFrame:
    """Three words before the first formula and the formula, else the first fifty characters."""
    return table(spark, sf, "documents").select("doc_id", text.cut_after_first_formula(F.col("text")).alias("text"))


@C.add()
def truncate_keep_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifty characters without splitting a formula; control flow in Python, tested by cases."""
    return table(spark, sf, "documents").select("doc_id", text.cut_keeping_formulas("text").alias("text"))


@C.add()
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text of every page; needs a markup parser, tested by cases."""
    return table(spark, sf, "pages").select("page_id", html.html_text("html").alias("text"))


@C.add()
def html_separate(spark: SparkSession, sf: str) -> DataFrame:
    """Text, math elements and offsets of every page; needs a markup parser, tested by cases."""
    return table(spark, sf, "pages").select("page_id", html.separated("html").alias("x")).select("page_id", "x.text", F.size("x.formulas").alias("n_formulas"))


SPAN_HTML = "concat('<p>Order <span class=\"math-container\" id=\"', o_orderkey, '\">x</span> and <span class=\"math-container\" id=\"', o_custkey, '\">y</span></p>')"


def _span_html() -> Column:
    span = lambda c, x: F.concat(F.lit('<span class="math-container" id="'), F.col(c).cast("string"), F.lit(f'">{x}</span>'))
    return F.concat(F.lit("<p>Order "), span("o_orderkey", "x"), F.lit(" and "), span("o_custkey", "y"), F.lit("</p>"))


@C.add(
    rf"""SELECT o_orderkey, array_to_string(regexp_extract_all(h, '<span class="math-container" id="(\d+)">', 1), ',') AS ids, len(regexp_extract_all(h, 'class="math-container"')) AS n
FROM (SELECT o_orderkey, {SPAN_HTML} AS h FROM orders)"""
)
def formula_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", _span_html().alias("h"))
    return rows.select("o_orderkey", F.array_join(html.formula_ids(F.col("h")), ",").alias("ids"), html.formulas_count(F.col("h")).cast("long").alias("n"))


@C.add(
    """SELECT o_orderkey, concat('<p>Order [', o_orderstatus, '] and [FORMULA_ID_', o_custkey, '_SLT_NOT_FOUND]</p>') AS text FROM orders WHERE o_orderkey <> o_custkey
UNION ALL SELECT o_orderkey, concat('<p>Order [', o_orderstatus, '] and [', o_orderstatus, ']</p>') FROM orders WHERE o_orderkey = o_custkey"""
)
def span_substitute(spark: SparkSession, sf: str) -> DataFrame:
    """Formula spans replaced by their looked-up text; ids without one leave a note."""
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        _span_html().alias("h"),
        F.create_map(F.col("o_orderkey").cast("string"), F.concat(F.lit("["), F.col("o_orderstatus"), F.lit("]"))).alias("texts"),
    )
    return rows.select("o_orderkey", html.substituted(F.col("h"), F.col("texts")).alias("text"))


@C.add(
    "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS shown, "
    "regexp_replace(source || '_truncated_50', '_truncated_50$', '') AS base, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS label FROM documents"
)
def display_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Shortened text, base type and label."""
    return table(spark, sf, "documents").select(
        "doc_id",
        text.shown(F.col("text")).alias("shown"),
        text.base_type(F.concat("source", F.lit("_truncated_50"))).alias("base"),
        text.labelled(F.col("lang"), {"en": "English", "de": "German"}).alias("label"),
    )
