"""Search entry points: each takes a corpus and queries as DataFrames and returns ranked rows.

``posts``: post_id, text and the texts of ``post_documents``, optionally
vectors.  ``queries``: query_id, query (markup).  Results: query_id, doc_id,
score, rank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemniscate.functions import latex
from lemniscate.functions.html import html_text, html_text_with_latex, separated
from lemniscate.functions.text import analysed
from lemniscate.functions.vectors import weight
from lemniscate.operators import cells, formulas, fusion, search
from lemniscate.operators.cells import CellIndex, Layout

VECTOR_FIELDS = ("slt_vector", "slt_type_vector", "opt_vector", "formula_vector")
K = 10

Embedder = Callable[[DataFrame], DataFrame]


def _docs(posts: DataFrame | search.Index, field: str) -> DataFrame | search.Index:
    if isinstance(posts, search.Index):
        return posts
    return posts.select(F.col("post_id").alias("doc_id"), F.coalesce(F.col(field), F.lit("")).alias("text"))


def text_index(posts: DataFrame, field: str = "text", analyser: search.Analyser = analysed) -> search.Index:
    """An index of one text field, in place of ``posts`` for any number of searches."""
    return search.build_index(_docs(posts, field), analyser)


def search_pure_text(
    posts: DataFrame | search.Index, queries: DataFrame, k: int = K, field: str = "text", analyser: search.Analyser = analysed
) -> DataFrame:
    """BM25 over one text field; by default words are folded, stemmed and stop words left out."""
    return search.top_k(search.bm25(_docs(posts, field), queries, analyser), k, per="query_id")


def search_treated_formulas(
    posts: DataFrame | search.Index, queries: DataFrame, k: int = K, field: str = "text_latex_search", analyser: search.Analyser = analysed
) -> DataFrame:
    """BM25 of the cleaned query, its formulas as phrases that count double."""
    text = html_text_with_latex("query")
    plain = queries.select("query_id", text.alias("t"))
    cleaned = plain.select("query_id", latex.cleaned(F.col("t")).alias("query"))
    found = plain.select("query_id", F.explode(latex.formulas(F.col("t"))).alias("f"))
    phrases = found.select(F.struct("query_id", "f").alias("query_id"), latex.cleaned(F.col("f")).alias("query"))
    docs = _docs(posts, field)
    hits = search.phrases(docs, phrases, analyser).select("query_id.query_id", "doc_id", (2 * F.col("score")).alias("score"))
    both = search.bm25(docs, cleaned, analyser).unionByName(hits).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    return search.top_k(both, k, per="query_id")


def search_text_vector(posts: DataFrame, queries: DataFrame, embed: Embedder, k: int = K, field: str = "text_without_html_vector") -> DataFrame:
    """Nearest posts to the query's text; ``embed`` takes (doc_id, text) and gives (doc_id, vector)."""
    plain = queries.select(F.col("query_id").alias("doc_id"), html_text("query").alias("text"))
    asked = embed(plain).select(F.col("doc_id").alias("query_id"), "vector")
    return search.knn(posts.select(F.col("post_id").alias("id"), F.col(field).alias("vector")), asked, k).withColumnRenamed("id", "doc_id")


def search_formula_vector(
    index: DataFrame, asked: DataFrame, field: str = "formula_vector", k: int = K, near: CellIndex | None = None, num_candidates: int | None = None
) -> DataFrame:
    """Nearest formulas (formula_id, post_id, vectors) to (query_id, vector); a post can appear several times.

    ``near``: :func:`formula_cells` of the index, read instead of all vectors; with ``num_candidates`` hits may be missed.
    """
    if field not in VECTOR_FIELDS:
        raise ValueError(f"unknown vector field {field!r}; there are {', '.join(VECTOR_FIELDS)}")
    if near is None and num_candidates is not None:
        raise ValueError("num_candidates needs an index of cells")
    rows = index.select(F.col("formula_id").alias("id"), F.col(field).alias("vector"))
    found = search.knn(rows, asked, k) if near is None else cells.nearest(near, asked, k, num_candidates=num_candidates).hits
    return found.join(index.select(F.col("formula_id").alias("id"), "post_id"), "id").withColumnRenamed("id", "formula_id")


def formula_cells(index: DataFrame, path: str, dims: int, field: str = "formula_vector", layout: Layout = Layout()) -> CellIndex:
    """An index of one vector field in cells, under the new folder ``path``; ``cells.load`` opens it again."""
    return cells.build(index.select(F.col("formula_id").alias("id"), F.col(field).alias("vector")), path, dims, layout)


def query_formulas(queries: DataFrame, known: DataFrame | None = None, dims: int = 300) -> DataFrame:
    """query_id, part, vector: layout vectors of the math elements of every query."""
    parts = queries.select("query_id", F.posexplode(separated("query")["formulas"]).alias("part", "formula"))
    keyed = parts.withColumn("formula_id", F.struct("query_id", "part"))
    pairs = formulas.short_enough(formulas.tuples(formulas.parsed(keyed).filter(F.col("nodes").isNotNull()), "formula_id"))
    tokens = formulas.tokenised(pairs, *formulas.MODES["slt"])
    words = formulas.encoded(tokens, "formula_id", formulas.dictionary(tokens, "formula_id", known))
    return formulas.hashed_vectors(words, "formula_id", dims).select("formula_id.query_id", "formula_id.part", "vector")


def search_hybrid(
    text_hits: DataFrame, keyword_hits: DataFrame, index: DataFrame, asked: DataFrame, field: str = "slt_vector", k: int = K
) -> dict[str, DataFrame]:
    """The four fusions of text and formula scores by name.

    ``text_hits`` and ``keyword_hits``: (query_id, doc_id, score), each up to
    three times k; of a post in both, the keyword score counts.  ``asked``:
    (query_id, part, vector).  Both arms are computed once for all four.
    """
    text = fusion.keep_last(text_hits, keyword_hits)
    named = asked.select(F.struct("query_id", "part").alias("query_id"), "vector")
    near = search_formula_vector(index, named, field, 3 * k).select("query_id.*", F.col("post_id").alias("doc_id"), "score")
    hits = near.join(asked.select("query_id", "part", weight(F.col("vector")).alias("weight")), ["query_id", "part"])
    return {
        f"{how}{'_weighted' if weighted else ''}": search.top_k(fusion.fused(text, fusion.by_document(hits, how, weighted)), k, per="query_id")
        for weighted in (False, True)
        for how in ("max", "mean")
    }


def with_attributes(ranked: DataFrame, posts: DataFrame, *columns: str) -> DataFrame:
    """Ranked rows with columns of their posts."""
    return ranked.join(posts.select(F.col("post_id").alias("doc_id"), *columns), "doc_id", "left")
