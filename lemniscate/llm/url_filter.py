"""URL filter by a ratio of character language models.

Listed rules decide the URLs they fit.  For the models, URLs whose host holds a
listed word are rejected ones, and so are the names of a small labelled sample, each with ends of accepted URLs.
URLs whose host shares a part of its name with that sample are doubtful and
have no label, like those that a rule blocks: such rules are policy about
sections and say nothing about how rejected URLs are spelled.  All others are
accepted ones.  From all labelled URLs two variable-order Markov
models of characters are counted (contexts up to ``order`` characters, as far
as they were seen) and smoothed by Witten-Bell interpolation.  The difference
of the two log-likelihoods, divided by the length, is calibrated on labelled
URLs held out by hash: URLs without a rule are blocked below the threshold.

The models are tables, as large as the URLs' n-grams are many; nothing of them
is cut or gathered on the driver.  A character's probability depends only on
the window of ``order`` characters before it and itself, so windows are
counted once, smoothed order by order with joins to the contexts and to the
next lower order, and joined to the URLs that hold them.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is allowed; an empty table gives an empty result; on a table without
accepted URLs to calibrate by, everything without a rule is allowed; on one
without listed words only the sample says what rejected URLs look like;
repeated rows are counted as often as they are given and judged alike; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemniscate.llm.common import discard, join_counted, scratch, stored

#: (verdict, host, path): fits the host and its subdomains where the path starts so.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Words that label a host as rejected.
REJECTED_WORDS = ("adult", "bet", "bets", "casino", "escort", "gambling", "lottery", "malware", "phishing", "poker", "porn", "sex", "slots", "spam", "torrent", "viagra", "warez", "xxx")
#: Made-up host names of kinds that blocklists hold (pharmacies, advert and click trackers, loans, adult pages, betting, malware), labelled as rejected.
REJECTED_HOSTS = (
    "cheap-meds", "online-pills", "pills-store", "discount-pharmacy", "buy-meds", "diet-pills", "cheap-replica", "cheap-viagra",
    "ads-server", "click-track", "ad-tracker", "track-click", "banner-ads", "popup-ads", "ads-pixel", "pixel-track",
    "payday-loans", "fast-cash", "easy-money", "crypto-doubler", "prize-winner", "free-giveaway",
    "adult-cams", "xxx-videos", "hot-escorts", "live-sex",
    "win-casino", "casino-bonus", "free-slots", "best-bets", "sports-betting", "poker-online",
    "spam-links", "link-farm", "warez-crack", "torrent-keygen", "malware-drop", "phishing-login",
)


@dataclass(frozen=True)
class UrlRules:
    #: Characters in the longest contexts.
    order: int = 5
    #: One labelled URL in so many is held out for calibration.
    holdout: int = 5
    #: One accepted URL in so many lends its end to a name of the labelled sample.
    dealt: int = 5
    #: Of the accepted held-out URLs at most this share may be blocked.
    false_blocks: float = 0.01


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest fitting rule as struct (verdict, rule); null if none fits."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


#: What every character has before anything is counted.
_FLAT = 1 / 256
#: Log-ratios are summed as whole multiples of this, so that their order doesn't matter.
_UNIT = 2.0**-32


def _windows(text: Column, order: int) -> tuple[Column, Column]:
    """Characters of ``text`` between marks, and a function's worth of windows over a column ``_chars`` that holds them."""
    chars = F.split(F.concat(F.lit("\x02"), text, F.lit("\x03")), "")
    held = F.col("_chars")
    # F.get is null before the start, which concat_ws leaves out.
    window = lambda i: F.concat_ws("", *[F.get(held, i - k) for k in range(order, -1, -1)])
    return chars, F.transform(F.sequence(F.lit(1), F.size(held) - 1), window)


def positions(texts: DataFrame, keep: list[str], order: int) -> DataFrame:
    """``keep`` and ``w``: for every character of ``text`` and the end, up to ``order`` characters before it and itself."""
    chars, windows = _windows(F.col("text"), order)
    return texts.select(*keep, chars.alias("_chars")).select(*keep, F.explode(windows).alias("w"))


def train(texts: DataFrame, order: int) -> DataFrame:
    """``texts`` (text, n, label: 1 accepted, 0 rejected, null: neither) to one row per window.

    ``w``, ``rows`` (how many positions of ``texts`` have it) and ``ratio``, the
    log-likelihood of its last character after the others as accepted less
    that as rejected, in units of ``_UNIT``.
    """
    classes = (0, 1)
    counts = positions(texts, ["n", "label"], order).groupBy("w").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in classes]
    )
    length = F.length("w")
    suffixes = F.transform(
        F.sequence(F.lit(1), length), lambda k: F.struct(F.substring(F.col("w"), length - k + 1, k).alias("g"), (k == length).alias("whole"))
    )
    grams = (
        counts.select("rows", "n0", "n1", F.explode(suffixes).alias("x"))
        .groupBy("x.g")
        .agg(F.sum(F.when(F.col("x.whole"), F.col("rows")).otherwise(0)).alias("rows"), *[F.sum(f"n{c}").alias(f"n{c}") for c in classes])
        .select("*", (F.length("g") - 1).alias("k"))
        .select("*", F.expr("substring(g, 1, k)").alias("h"), F.expr("substring(g, 2)").alias("tail"))
    )
    grams = stored(grams, "grams")
    sizes = {x["k"]: x["count"] for x in grams.groupBy("k").count().collect()}  # one row per order
    levels: list[DataFrame] = []
    for k in range(order + 1):
        own = grams.filter(F.col("k") == k)
        contexts = own.groupBy(F.col("h").alias("_h")).agg(
            *[F.sum(f"n{c}").alias(f"t{c}") for c in classes], *[F.count_if(F.col(f"n{c}") > 0).alias(f"d{c}") for c in classes]
        )
        own = own.join(contexts, F.col("h") == F.col("_h"))
        if levels:
            below = levels[-1].select(F.col("g").alias("_tail"), *[F.col(f"p{c}").alias(f"q{c}") for c in classes])
            own = own.join(below, F.col("tail") == F.col("_tail"))
        else:
            own = own.withColumns({f"q{c}": F.lit(_FLAT) for c in classes})
        p = [
            F.when(F.col(f"t{c}") > 0, (F.col(f"n{c}") + F.col(f"d{c}") * F.col(f"q{c}")) / (F.col(f"t{c}") + F.col(f"d{c}")))
            .otherwise(F.col(f"q{c}"))
            .alias(f"p{c}")
            for c in classes
        ]
        levels.append(stored(own.select("g", "rows", *p), "order", sizes.get(k, 0)))
    discard(grams)
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    return every.filter("rows > 0").select(
        F.col("g").alias("w"), "rows", F.round(F.log(F.col("p1") / F.col("p0")) / _UNIT).cast("long").alias("ratio")
    )


def scores(texts: DataFrame, order: int) -> DataFrame:
    """``texts`` (key, text, n, label) to key, n, score: accepted minus rejected, by character."""
    model = train(texts, order).withColumnRenamed("w", "_w")
    total = model.agg(F.sum("rows")).first()[0] or 0
    found = join_counted(positions(texts, ["key", "n"], order), model, "w", "_w", "rows", total)
    by_text = found.groupBy("key").agg(F.max("n").alias("n"), F.sum("ratio").alias("sum"), F.count(F.lit(1)).alias("m"))
    return by_text.select("key", "n", (F.col("sum") * _UNIT / F.col("m")).alias("score"))


#: Bins into which values are counted at once.
BINS = 1024


def smallest(df: DataFrame, column: str, share: float) -> float | None:
    """The value that ``share`` of the column's values reach at most, by counting in ever narrower bins; null without values.

    At most ``BINS`` rows are gathered a pass; the outcome is exact and does not depend on order.
    """
    n, low, high = df.agg(F.count(column), F.min(column), F.max(column)).first()
    if not n:
        return None
    rank, x = max(1, int(-(-n * share // 1))), F.col(column)
    while low < high:
        bin_of = F.least(F.floor((x - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = df.filter(x.between(low, high)).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        for b in sorted(bins.collect(), key=lambda b: b["bin"]):
            if rank <= b["n"]:
                low, high = b["low"], b["high"]
                break
            rank -= b["n"]
    return low


def judge(pages: DataFrame, rules: UrlRules = UrlRules()) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score (accepted minus rejected, by character)."""
    with scratch():
        return stored(_judged(pages, rules), "verdicts", lasting=True)


def _judged(pages: DataFrame, rules: UrlRules) -> DataFrame:
    host, path = parts(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    word = F.concat_ws("|", *[F.lit(w) for w in REJECTED_WORDS])
    df = df.withColumn("found", rule_for(F.col("host"), F.col("path"))).withColumn("text", F.concat("host", "path"))
    rejected = F.regexp_like("host", F.concat(F.lit("(^|[.-])("), word, F.lit(")([.-]|$)")))
    names = sorted({x for h in REJECTED_HOSTS for x in h.split("-")})
    doubtful = F.regexp_like("host", F.lit(f"(^|[.-])({'|'.join(names)})[0-9]*([.-]|$)"))
    label = F.when(rejected, 0).when((F.coalesce("found.verdict", F.lit("")) != "block") & ~doubtful, 1)
    df = df.withColumn("label", F.when(F.col("text") != "", label))
    df = df.select(
        "page_id", "host", "path", "text", "label", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("given"), F.unhex(F.md5("text")).alias("key")
    )
    df = stored(df, "urls")
    held = F.pmod(F.xxhash64("text"), F.lit(rules.holdout)) == 0
    # A text has one label; copies are one row that counts as often as there are copies.
    texts = df.filter("text <> ''").groupBy("key", "text").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("n"))
    texts = texts.withColumn("label", F.when(~held, F.col("label")))
    # The sample's names with ends of accepted URLs, so that only names tell the classes apart; their keys are no page's.
    dealt = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(len(REJECTED_HOSTS) * rules.dealt)).cast("int")
    name = F.get(F.array(*[F.lit(h) for h in REJECTED_HOSTS]), dealt)
    host = F.regexp_extract("text", "^[^/]*", 0)
    made = F.concat(name, F.lit("."), F.substring_index(host, ".", -2), F.expr("substring(text, length(regexp_extract(text, '^[^/]*', 0)) + 1)"))
    sample = texts.filter("label = 1").select(made.alias("text"), "n").filter("text IS NOT NULL")
    sample = sample.select(F.encode("text", "utf-8").alias("key"), "text", F.lit(0).alias("label"), "n")
    texts = stored(texts.unionByName(sample.select(*texts.columns)), "texts")
    scored = join_counted(df, stored(scores(texts, rules.order), "text-scores").withColumnRenamed("key", "_key"), "key", "_key", "n", df.count(), "left")
    scored = stored(scored.withColumn("score", F.coalesce("score", F.lit(0.0))), "scores")
    accepted = scored.filter((F.col("label") == 1) & held)
    bar = smallest(accepted, "score", rules.false_blocks)
    # Never above even odds: what looks accepted stays.
    bar = min(0.0, bar) if bar is not None else float("-inf")
    verdict = F.coalesce("given", F.when(F.col("score") < bar, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
