"""The corpus operators as queries over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lemniscate.llm import minhash
from lemniscate.llm.align import alignment_report
from lemniscate.llm.centroids import cluster_report
from lemniscate.llm.common import table
from lemniscate.llm.html_extract import extract
from lemniscate.llm.line_dedup import line_report
from lemniscate.llm.packing import pack
from lemniscate.llm.pieces import digest
from lemniscate.llm.pii import find_pii
from lemniscate.llm.quality import quality_rules
from lemniscate.llm.sharding import shard
from lemniscate.llm.simhash import near_duplicates
from lemniscate.llm.topk import every_twentieth
from lemniscate.llm.url_filter import judge

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return every_twentieth(table(spark, sf_dir, "embeddings"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_report(table(spark, sf_dir, "documents"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_simhash,
        op3_html_extraction,
        op4_pii,
        op5_exact_top_k,
        op6_url_filter,
        op7_sentencepiece,
        op8_sharding,
        op9_packing,
        op10_quality_rules,
        op11_alignment,
        op12_minhash,
        op13_centroids,
    )
}


def _lloyd_sql(rounds: int) -> str:
    """Lloyd's rounds, each a step of its own: what the assignment is, however distances are skipped."""
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v ORDER BY h LIMIT 8))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""d{r} AS (SELECT i, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM v CROSS JOIN c{r}),
a{r} AS MATERIALIZED (SELECT i, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM d{r} GROUP BY i)"""
        )
        if r < rounds:
            steps.append(
                f"""s{r} AS (SELECT c, k, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM v JOIN a{r} USING (i)) GROUP BY c, k),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k) AS m FROM s{r} GROUP BY c) n USING (c))"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, c::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (i) JOIN c{rounds} USING (c)"""
    )


# Fingerprints, trained models, tokenisers, markup and sequential packing can't be
# expressed in SQL; those queries are held against plain Python in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
WITH lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM lines),
pages AS (SELECT source, count(DISTINCT text) + count(DISTINCT CASE WHEN text IS NULL THEN 1 END) AS n_pages FROM documents GROUP BY source),
bad AS (SELECT c.source, k FROM (SELECT source, k, count(DISTINCT text) AS n FROM keyed WHERE k <> '' GROUP BY source, k) c
  JOIN pages p ON c.source IS NOT DISTINCT FROM p.source WHERE n >= 5 AND n > 0.1 * n_pages),
marked AS (SELECT doc_id, line, i, EXISTS (SELECT 1 FROM bad b WHERE b.source IS NOT DISTINCT FROM x.source AND b.k = x.k) AS gone FROM keyed x)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(m.text, '') END AS text, coalesce(m.n_dropped, 0)::BIGINT AS n_dropped FROM documents d LEFT JOIN
(SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS text, count_if(gone) AS n_dropped FROM marked GROUP BY doc_id) m USING (doc_id)""",
    "op5_exact_top_k": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM p),
twice AS (SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM g JOIN twice USING (doc_id, gram)) GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines) AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 60 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS own,
  100 * n_symbols > 15 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS strict FROM m),
h AS (SELECT source, count(*) AS n, count_if(base_failed OR own) AS k FROM f GROUP BY source),
b AS (SELECT sum(k) / sum(n) AS mean, var_pop(k / n) - avg(k / n * (1 - k / n) / greatest(n - 1, 1)) AS var FROM h),
prior AS (SELECT mean, CASE WHEN var > 0 THEN least(greatest(mean * (1 - mean) / var - 1, 2.0), 10000.0) ELSE 10000.0 END AS weight FROM b),
shrunk AS (SELECT source, n + weight AS seen, least(1.5 * mean, 0.9) AS bar, (k + mean * weight) / (n + weight) AS rate FROM h CROSS JOIN prior),
rates AS (SELECT source, rate, rate - 3 * sqrt(rate * (1 - rate) / (seen + 1)) > bar AS rejected FROM shrunk)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR own) AND NOT (rejected AND strict) AS kept, round(rate, 6) AS host_rate, rejected AS host_rejected
FROM f JOIN rates r ON f.source IS NOT DISTINCT FROM r.source""",
    "op12_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
c AS (SELECT u, min(v) AS least FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.least, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.u = d.doc_id""",
    "op13_centroids": _lloyd_sql(10),
}
