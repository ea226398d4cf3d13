"""Personal data by weak supervision (native: DataFrame functions only).

The base spans come from fixed patterns and stay in any case.  Wider patterns
propose further spans of other forms: addresses written out, IPv6 numbers,
cards of 14 to 16 digits in the issuers' groups, national phone numbers.  Three
labelers vote on every one of them: the form's own check (regex), prefixes and
endings that the kind is known by (gazetteer; of e-mail endings and area codes
those that the corpus's base spans hold), and the words before the span
(context).  Expectation-maximisation over the counts of vote patterns estimates
the labelers' reliabilities for each kind and gives every pattern a posterior;
those posteriors train a naive Bayes classifier on the spans' features, which
decides on them.

Texts are read once.  What is trained is computed from counts over all spans
of the corpus; the counts' domain (kinds x votes, kinds x feature values,
endings of two or three letters, area codes) is fixed, whatever the corpus.
The work within a text grows with its spans' number times its logarithm.

Cases: a null text is empty; offsets are code points, ends exclusive; added
spans never overlap a base span or each other (the earlier, then the longer
one stays); repeated rows are judged alike; an empty table gives an empty
result; other columns are ignored, or passed through by :func:`masked`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemniscate.llm.common import packed, scratch, stored, unpacked

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")

# The base patterns.  Their repetitions are possessive: with what follows they
# match the same text, but neither backtrack nor recurse.  A match starts at a
# run's first character or where the match before it ended (\G), which spares
# a second look at the rest of a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?:(?<=\G[0-9])|(?<![0-9][0-9]))[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Wider patterns for further spans; their repetition counts are the forms' own.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+ ?[\(\[]at[\)\]] ?[A-Za-z0-9-]++(?:(?: ?[\(\[]dot[\)\]] ?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9+.-])(?<![0-9] )[0-9]{4}(?:(?:[\x20-]?[0-9]{4}){3}|[\x20-]?[0-9]{6}[\x20-]?[0-9]{4,5})(?![0-9])(?![\x20-][0-9])",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
#: Regex labeler: the check of the form.
FORM = {
    "email": r"(?i)(?:[\)\]] ?|\.)[a-z]{2,}$",
    "ip": r"(?i)[a-f]|[0-9]{3}",  # times and counters have neither
    "card": ".",  # and the check digit
    "phone": r"^\(?[2-9][0-9]{2}\)?.[2-9]",
}
#: Gazetteers that are fixed: prefixes given out for addresses, and to card issuers.
GAZETTEER = {
    "ip": r"(?i)^(?:2[0-9a-f]{3}|3fff|f[cd][0-9a-f]{2}|fe80):",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-9]|6011|64|65)",
}
#: Words that announce a kind, or another number, looked for in the CONTEXT characters between a span and the pattern's match before it.
CONTEXT = 40
ANNOUNCED = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(ip|ipv6|host|server|address|adresse|login)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|karte|carte|tarjeta|payment)\b",
    "phone": r"(?i)\b(phone|tel|call|fax|mobile|cell|telefon|t\xe9l\xe9phone|tel\xe9fono|handy)\b",
}
DENIED = r"(?i)\b(order|invoice|isbn|serial|version|tracking|reference|ref|item|part|lot|sku|ticket|build)\b"


@dataclass(frozen=True)
class PiiRules:
    #: A further span is kept above this probability.
    threshold: float = 0.9
    #: Rounds of expectation-maximisation.
    rounds: int = 50


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether the digits of ``x`` pass the Luhn check."""
    d = F.transform(F.filter(F.split(F.reverse(_digits(x)), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(d, lambda c, i: F.when(i % 2 == 0, c).when(c > 4, c * 2 - 9).otherwise(c * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, c: a + c) % 10 == 0


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    return {
        "email": F.lit(True),
        "ip": x.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"),
        "card": n.between(16, 19) & _luhn(x),
        "phone": n.between(8, 15),
    }[kind]


#: Items that are gone through at once; arrays grow by whole chunks, so that long ones are not copied for every item.
CHUNK = 256
#: A text's spans are compared one by one up to so many, and by bisection beyond.
FEW = 32
#: Characters in a block of a text that is masked.
BLOCK = 4096
_HITS = "array<struct<start:int,end:int,value:string,before:string>>"


def _chunked(items: Column) -> Column:
    n = F.ceil(F.size(items) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.slice(items, k * CHUNK + 1, CHUNK))


def _located(text: Column, hits: Column, pattern: str) -> Column:
    """``hits`` of ``pattern`` with their offsets: the lengths of what lies between, added up."""
    gaps = F.split(text, pattern, -1)
    both = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        before = F.substring(x["gap"], -CONTEXT, CONTEXT)
        one = F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("value"), before.alias("before"))
        return F.struct(end.alias("at"), F.array_append(acc["found"], one).alias("found"))

    def chunk(acc: Column, x: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(_HITS).alias("found"))
        return F.aggregate(x, start, step, lambda y: F.struct(y["at"].alias("at"), F.array_append(acc["all"], y["found"]).alias("all")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_HITS}>").alias("all"))
    return F.flatten(F.aggregate(_chunked(both), start, chunk)["all"])


def _below(spans: Column, x: Column) -> Column:
    """How many of ``spans``, ordered by start, start before ``x``: bisection."""
    start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        right = F.get(spans, mid)["start"] < x
        return F.struct(
            F.when((acc["low"] < acc["high"]) & right, mid + 1).otherwise(acc["low"]).alias("low"),
            F.when((acc["low"] < acc["high"]) & ~right, mid).otherwise(acc["high"]).alias("high"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, step)["low"]


def spans(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` and ``base`` and ``wide``: arrays of spans (kind, start, end, value, before)."""
    df = docs.select(*keep, F.coalesce(text, F.lit("")).alias("_t"))
    names = [c for c in df.columns if c != "_t"]
    t = F.col("_t")
    none = F.array().cast("array<string>")
    digit = t.rlike("[0-9]")

    def hits(patterns: dict[str, str], needed: dict[str, Column], prefix: str) -> list[Column]:
        return [F.when(needed[k], F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none).alias(prefix + k) for k, p in patterns.items()]

    needed = {k: (t.contains(x) if x else F.lit(True)) & (digit if k != "email" else F.lit(True)) for k, x in NEEDED.items()}
    wider = {"email": t.contains("at)") | t.contains("at]"), "ip": t.contains(":") & digit, "card": digit, "phone": digit}
    df = df.select(*names, "_t", *hits(BASE, needed, "_b_"), *hits(WIDE, wider, "_w_"))

    def located(patterns: dict[str, str], prefix: str) -> list[Column]:
        return [
            F.when(F.size(prefix + k) > 0, _located(t, F.col(prefix + k), p)).otherwise(F.array().cast(_HITS)).alias(prefix + k)
            for k, p in patterns.items()
        ]

    df = df.select(*names, *located(BASE, "_b_"), *located(WIDE, "_w_"))
    checked = lambda k: lambda s: _valid(k, s["value"])
    df = df.select(*names, *[F.filter(f"_b_{k}", checked(k)).alias(f"_b_{k}") for k in KINDS], *[f"_w_{k}" for k in KINDS])

    def shaped(n: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(F.lit(n).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "value", "before")])

    listed = lambda prefix: F.concat(*[F.transform(prefix + k, shaped(n)) for n, k in enumerate(KINDS)])
    df = df.select(*names, *[f"_b_{k}" for k in KINDS], listed("_b_").alias("base"), listed("_w_").alias("wide"))

    def meets(w: Column) -> Column:
        out = F.lit(False)
        for k in KINDS:  # the last base span of a kind that starts before the wide one ends
            last = F.get(F.col(f"_b_{k}"), _below(F.col(f"_b_{k}"), w["end"]) - 1)
            out = out | F.coalesce(last["end"] > w["start"], F.lit(False))
        one_by_one = F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
        return F.when(F.size("base") <= FEW, one_by_one).otherwise(out)

    return df.select(*names, "base", F.filter("wide", lambda w: ~meets(w)).alias("wide"))


def _key(kind: str, value: Column) -> Column:
    """What the gazetteer of a kind knows a span by: an e-mail's ending, a number's area code."""
    if kind == "email":
        return F.lower(F.regexp_extract(value, r"([A-Za-z]{2,3})$", 1))
    return F.regexp_extract(_digits(value), r"([2-9][0-9]{2})[0-9]{7}$", 1)


def gazetteer(found: DataFrame) -> dict[str, list[str]]:
    """Endings and area codes (of numbers with country code 1) that base spans hold: 18,252 and 800 at most."""
    s = found.select(F.explode("base").alias("s")).select("s.kind", "s.value")
    email, phone = (KINDS.index(k) for k in ("email", "phone"))
    keyed = s.filter((F.col("kind") == email) | ((F.col("kind") == phone) & _digits(F.col("value")).rlike("^1[0-9]{10}$")))
    keyed = keyed.select("kind", F.when(F.col("kind") == email, _key("email", F.col("value"))).otherwise(_key("phone", F.col("value"))).alias("key"))
    out: dict[str, list[str]] = {"email": [], "phone": []}
    for kind, key in keyed.filter("key <> ''").distinct().collect():
        out[KINDS[kind]].append(key)
    return out


def _vote(kind: Column, value: Column, before: Column, known: dict[str, list[str]]) -> Column:
    """Three binary digits: regex, gazetteer, context."""
    out = F.lit(None).cast("int")
    for n, k in enumerate(KINDS):
        form = value.rlike(FORM[k]) & (_luhn(value) if k == "card" else F.lit(True))
        listed = value.rlike(GAZETTEER[k]) if k in GAZETTEER else _key(k, value).isin(sorted(known[k]))
        announced = before.rlike(ANNOUNCED[k]) & ~before.rlike(DENIED)
        bits = F.when(form, 4).otherwise(0) + F.when(listed, 2).otherwise(0) + F.when(announced, 1).otherwise(0)
        out = F.when(kind == n, bits).otherwise(out)
    return out


#: The classifier's features and the number of values each can take.
FEATURES = {"form": 2, "length": 8, "parts": 5, "left": 4, "prefix": 10, "announced": 2}


def _features(value: Column, before: Column, vote: Column) -> dict[str, Column]:
    last = F.substring(before, -1, 1)
    return {
        "form": F.when(vote >= 4, 1).otherwise(0),
        "length": F.least(F.floor(F.length(value) / 4), F.lit(7)).cast("int"),
        "parts": F.least(F.size(F.split(value, r"[ .()-]+")) - 1, F.lit(4)),
        "left": F.when(last == "", 0).when(last.rlike(r"\s"), 1).when(last.rlike(r"\w"), 2).otherwise(3),
        "prefix": F.coalesce(F.regexp_extract(value, "[0-9]", 0).try_cast("int"), F.lit(0)),
        "announced": vote.bitwiseAND(F.lit(1)),
    }


def reliabilities(counts: dict[tuple[int, int], int], rounds: int) -> dict[int, dict[int, float]]:
    """Expectation-maximisation for each kind over (kind, vote) counts: vote to posterior.

    Two classes, labelers independent given the class; starts from the share
    of labelers that fired.  Where little is counted, a labeler is taken to
    fire on four of five true spans and on one of five others.
    """
    out: dict[int, dict[int, float]] = {}
    for kind in sorted({k for k, _ in counts}):
        own = {v: n for (k, v), n in counts.items() if k == kind}
        post = {v: (1 + v.bit_count() * 3) / 11 for v in range(8)}
        for _ in range(rounds):
            pos = sum(n * post[v] for v, n in own.items())
            total = sum(own.values())
            prior = (pos + 1) / (total + 2)
            fires = []
            for b in (4, 2, 1):
                tp = sum(n * post[v] for v, n in own.items() if v & b)
                fp = sum(n * (1 - post[v]) for v, n in own.items() if v & b)
                fires.append((b, (tp + 4) / (pos + 5), (fp + 1) / (total - pos + 5)))
            for v in range(8):
                odds = log(prior / (1 - prior))
                for b, p, q in fires:
                    odds += log(p / q) if v & b else log((1 - p) / (1 - q))
                post[v] = 1 / (1 + 2.718281828459045 ** -max(-500.0, min(500.0, odds)))
        out[kind] = post
    return out


def classifier(found: DataFrame, rules: PiiRules, known: dict[str, list[str]]) -> tuple[dict[int, float], dict[tuple[int, str, int], float]]:
    """Prior log-odds by kind and weights by (kind, feature, value), trained on all further spans of ``found``."""
    every = found.select(F.explode("wide").alias("s")).select("s.*")
    voted = every.withColumn("vote", _vote(F.col("kind"), F.col("value"), F.col("before"), known))
    listed = F.array(
        F.struct(F.lit("").alias("feature"), F.lit(0).alias("level")),
        *[F.struct(F.lit(f).alias("feature"), x.cast("int").alias("level")) for f, x in _features(F.col("value"), F.col("before"), F.col("vote")).items()],
    )
    cells = voted.select("kind", "vote", F.explode(listed).alias("f")).groupBy("kind", "vote", "f.feature", "f.level").count()
    rows = [tuple(r) for r in cells.collect()]  # at most kinds x votes x feature values
    post = reliabilities({(k, v): n for k, v, f, _, n in rows if f == ""}, rules.rounds)
    prior: dict[int, float] = {}
    weights: dict[tuple[int, str, int], float] = {}
    for kind in post:
        pos = sum(n * post[kind][v] for k, v, f, _, n in rows if k == kind and f == "")
        neg = sum(n * (1 - post[kind][v]) for k, v, f, _, n in rows if k == kind and f == "")
        prior[kind] = log((pos + 1) / (neg + 1))
        for feature, levels in FEATURES.items():
            for level in range(levels):
                p = sum(n * post[kind][v] for k, v, f, x, n in rows if (k, f, x) == (kind, feature, level))
                q = sum(n * (1 - post[kind][v]) for k, v, f, x, n in rows if (k, f, x) == (kind, feature, level))
                weights[kind, feature, level] = log((p + 1) / (pos + levels)) - log((q + 1) / (neg + levels))
    return prior, weights


def _probability(s: Column, prior: dict[int, float], weights: dict[tuple[int, str, int], float], known: dict[str, list[str]]) -> Column:
    vote = _vote(s["kind"], s["value"], s["before"], known)
    total = F.lit(0.0)
    for n in range(len(KINDS)):
        total = F.when(s["kind"] == n, F.lit(prior.get(n, -20.0))).otherwise(total)
    for feature, x in _features(s["value"], s["before"], vote).items():
        table = F.array(*[F.lit(weights.get((n, feature, v), 0.0)) for n in range(len(KINDS)) for v in range(FEATURES[feature])])
        total = total + F.coalesce(F.get(table, s["kind"] * FEATURES[feature] + x), F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def _decided(found: DataFrame, rules: PiiRules) -> DataFrame:
    """``found`` with ``spans``: base spans and the further ones that the classifier keeps, by kind and start."""
    known = gazetteer(found)
    prior, weights = classifier(found, rules, known)
    names = [c for c in found.columns if c not in ("base", "wide")]
    taken = F.filter("wide", lambda s: _probability(s, prior, weights, known) > rules.threshold)
    df = found.select(*names, "base", F.array_sort(taken, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])).alias("more"))
    empty = F.filter("more", lambda s: F.lit(False))
    apart = F.aggregate(
        "more",
        F.struct(F.lit(0).alias("end"), empty.alias("kept")),
        lambda acc, s: F.when(s["start"] >= acc["end"], F.struct(s["end"].alias("end"), F.array_append(acc["kept"], s).alias("kept"))).otherwise(acc),
    )["kept"]
    df = df.select(*names, "base", F.when(F.size("more") > 1, apart).otherwise(F.col("more")).alias("more"))
    return df.select(
        *names,
        "base",
        F.sort_array(F.transform(F.concat("base", "more"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).alias("spans"),
    )


def _listed(x: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, rules: PiiRules = PiiRules()) -> DataFrame:
    """Per document: doc_id, base counts by kind, ``base_sha256`` and ``spans`` (kind:start:end, base and further ones)."""
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    places = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    with scratch():
        found = stored(spans(docs, F.col("text"), [F.col("doc_id")]), "spans")
        out = _decided(found, rules).select(
            "doc_id",
            *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)],
            F.sha2(_listed(F.sort_array(places)), 256).alias("base_sha256"),
            _listed(F.col("spans")).alias("spans"),
        )
        return stored(out, "pii", lasting=True)


def masked(docs: DataFrame, rules: PiiRules = PiiRules()) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets, ``n_chars`` counted anew.

    Overlapping spans are replaced together, named after the one that starts first.
    """
    found = stored(spans(packed(docs), F.col("row.text"), [F.col("row")]), "spans-rows")
    df = _decided(found, rules).select(
        "row",
        F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])).alias("s"),
    )
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("row.text")
    n = F.length(text)
    # A piece of a long text is taken from its blocks, so that the text is not gone through for every piece.
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / BLOCK).cast("int")), lambda k: F.substring(text, k * BLOCK + 1, F.lit(BLOCK)))
    df = df.select("row", "s", F.when(F.size("s") > 0, blocks).alias("blocks"))

    def piece(at: Column, end: Column) -> Column:
        first, last = F.floor(at / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        b = F.col("blocks")
        within = F.substring(F.get(b, first), at % BLOCK + 1, end - at)
        across = F.concat(
            F.substring(F.get(b, first), at % BLOCK + 1, F.lit(BLOCK)),
            F.array_join(F.slice(b, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
            F.substring(F.get(b, last), F.lit(1), end % BLOCK),
        )
        return F.when(end <= at, "").when(first == last, within).otherwise(across)

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(piece(acc["at"], s["start"]), F.get(names, s["kind"]))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.array_append(acc["out"], new)).alias("out"),
        )

    def chunk(acc: Column, x: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out"))
        close = lambda y: F.struct(y["at"].alias("at"), F.array_append(acc["all"], F.array_join(y["out"], "")).alias("all"))
        return F.aggregate(x, start, step, close)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("all"))
    rest = lambda acc: F.concat(F.array_join(acc["all"], ""), piece(acc["at"], n))
    df = df.select("row", F.when(F.size("s") > 0, F.aggregate(_chunked(F.col("s")), start, chunk, rest)).alias("masked"))
    changed = {"text": F.coalesce(F.col("masked"), text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("masked").isNotNull(), F.length("masked").cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(df, docs.columns, changed)
