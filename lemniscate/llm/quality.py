"""Quality rules with host-level verdicts (native: DataFrame functions only).

Every document is measured once (words, symbols, repeated lines, repeated
three-word windows) and held against fixed rules.  Failures are then
aggregated by host, each host's failure rate is shrunk towards the corpus by
a beta prior whose parameters come from all hosts (method of moments), and
the host's verdict is joined back to its documents.  A host is rejected when
its shrunk rate, less three of its standard deviations, is still half as high
again as the prior's mean: so a few failures condemn no small host, and where
all hosts are alike none is rejected.

Cases: a null text counts as empty; a null host is a host of its own;
repeated rows are measured and counted one by one; an empty table gives an
empty result; columns other than ``doc_id``, ``text`` and ``source`` are
ignored by :func:`quality_rules` and kept by :func:`keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemniscate.llm.common import BETWEEN, WORD, join_counted, packed, scratch, stored, unpacked


@dataclass(frozen=True)
class QualityRules:
    """Limits; the first two are the base rules, the others the method's own."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: Symbols per hundred words, repeated lines per hundred lines, characters per word.
    max_symbol_percent: int = 30
    max_dup_line_percent: int = 60
    min_word_chars: int = 2
    max_word_chars: int = 20
    #: A host's failure rate is too high above this multiple of the prior's mean,
    host_factor: float = 1.5
    #: above this rate in any case,
    max_host_rate: float = 0.9
    #: and the host is rejected when its shrunk rate is higher by this many of that rate's standard deviations.
    certainty: float = 3.0
    #: On a rejected host only documents below this share of the method's limits stay.
    strict_share: float = 0.5


#: The prior weighs as much as this many documents at least and at most.
PRIOR_WEIGHT = (2.0, 10_000.0)


def measured(df: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` and the measures of ``text``: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    df = df.select(*keep, F.coalesce(text, F.lit("")).alias("_t"))
    df = df.select(
        *[F.col(c) for c in df.columns if c != "_t"],
        F.array_remove(F.split("_t", BETWEEN, -1), "").alias("_words"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)).alias("_lines"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    held = [F.col(c) for c in df.columns if c not in ("_words", "_lines")]
    words = F.col("_words")
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    after = lambda i: (F.get(words, i + 1), F.get(words, i + 2))
    df = df.select(
        *held,
        "_words",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(starts, lambda w, i: F.xxhash64(w, *after(i))).alias("_hashes"),
    )
    # Windows with different hashes differ; only texts with equal ones are looked at word by word.
    held = [F.col(c) for c in df.columns if c not in ("_words", "_hashes")]
    df = df.select(
        *held,
        F.when(
            F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
            F.transform(starts, lambda w, i: F.concat_ws(" ", w, *after(i))),
        ).alias("_windows"),
    )
    held = [F.col(c) for c in df.columns if c != "_windows"]
    df = df.select(*held, F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))).alias("_sorted"))
    held = [F.col(c) for c in df.columns if c != "_sorted"]
    s = F.col("_sorted")
    repeated = F.filter(
        F.transform(
            s,
            lambda x, k: F.struct(
                x["i"].alias("i"),
                ((F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"])).alias("d"),
            ),
        ),
        lambda x: x["d"],
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return df.select(*held, F.when(s.isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"))


def _own_failure(r: QualityRules, share: float) -> Column:
    """Whether a document fails one of the method's own rules at ``share`` of the limits."""
    words, lines = F.col("n_words"), F.col("n_lines")
    return (
        (100 * F.col("n_symbols") > r.max_symbol_percent * share * words)
        | (100 * F.col("n_dup_lines") > r.max_dup_line_percent * share * lines)
        | (F.col("word_chars") < r.min_word_chars * words)
        | (F.col("word_chars") > r.max_word_chars * words)
    )


def host_rates(measures: DataFrame, r: QualityRules = QualityRules()) -> DataFrame:
    """One row per host: documents, failures, the failure rate shrunk by the beta prior fitted to all hosts, and the verdict."""
    hosts = measures.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    fitted = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        # Between-host variance: the observed one less what counting alone gives.
        (
            F.var_pop(rate) - F.avg(rate * (1 - rate) / F.greatest(F.col("n_docs") - 1, F.lit(1)))
        ).alias("var"),
    )
    mean = F.coalesce(F.col("mean"), F.lit(0.0))
    weight = F.when(
        F.col("var") > 0, F.least(F.greatest(mean * (1 - mean) / F.col("var") - 1, F.lit(PRIOR_WEIGHT[0])), F.lit(PRIOR_WEIGHT[1]))
    ).otherwise(F.lit(PRIOR_WEIGHT[1]))
    prior = fitted.select(F.struct(mean.alias("mean"), weight.alias("weight")).alias("prior"))
    mean, weight, rate = F.col("prior.mean"), F.col("prior.weight"), F.col("rate")
    deviation = F.sqrt(rate * (1 - rate) / (F.col("n_docs") + weight + 1))
    too_high = F.least(r.host_factor * mean, F.lit(r.max_host_rate))
    return (
        hosts.withColumn("prior", prior.scalar())
        .withColumn("rate", (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight))
        .withColumn("rejected", rate - r.certainty * deviation > too_high)
        .select("host", "n_docs", "n_failed", "rate", "rejected")
    )


def _with_verdict(df: DataFrame, keep: list[Column], text: Column, host: Column, r: QualityRules, name: str) -> DataFrame:
    m = measured(df, text, [*keep, host.alias("host")])
    m = m.withColumn(
        "base_failed",
        (F.col("n_words") < r.min_words) | (100 * F.col("n_repeat_words") > r.max_repeat_percent * F.col("n_words")),
    ).withColumn("failed", F.col("base_failed") | _own_failure(r, 1.0))
    # Read by the host rates and by the verdicts: measured once, kept without the texts.
    m = stored(m, name)
    hosts = host_rates(m, r).select(F.col("host").alias("_host"), "n_docs", F.col("rate").alias("host_rate"), F.col("rejected").alias("host_rejected"))
    return join_counted(m, hosts, "host", "_host", "n_docs", m.count()).withColumn(
        "kept",
        ~F.col("failed") & ~(F.col("host_rejected") & _own_failure(r, r.strict_share)),
    )


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: the measures, ``base_failed``, the host's shrunk rate and ``kept``."""
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    with scratch():
        out = _with_verdict(docs, [F.col("doc_id")], F.col("text"), F.col("source"), rules, "measures")
        return stored(out.select("doc_id", *measures, "kept", F.round("host_rate", 6).alias("host_rate"), "host_rejected"), "quality", lasting=True)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that the rules and the host verdicts keep."""
    rows = packed(docs)
    good = _with_verdict(rows, [F.col("row")], F.col("row.text"), F.col("row.source"), rules, "quality-rows")
    return unpacked(good.filter("kept"), docs.columns, {})
