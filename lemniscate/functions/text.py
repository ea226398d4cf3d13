"""Text analysis and the smaller string functions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+"

# The English stop words of the standard analyser.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]
# Letters and what they are folded to.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinoooooouuuuyy"


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def folded(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


def folded_words(text: Column) -> Column:
    """Tokens folded to ASCII, without stop words."""
    return F.filter(F.transform(tokens(text), folded), lambda w: ~w.isin(STOP_WORDS))


def analysed(text: Column) -> Column:
    """Tokens folded to ASCII, without stop words, stemmed."""
    return stems(folded_words(text))


_VOWEL = re.compile(r"[aeiou]|(?<![aeiou])y")
# Suffix steps of the Porter stemmer with what they become.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
_STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]


def _shape(stem: str) -> str:
    """Consonants and vowels as c and v; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Porter stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _shape(w).endswith("cvc") and w[-1] not in "wxy":
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for pairs in (_STEP2, _STEP3):
        for end in sorted(pairs, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + pairs[end]
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not (_shape(w[:-1]).endswith("cvc") and w[-2] not in "wxy")):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def shown(text: Column, most: int = 100) -> Column:
    """Text cut for display, with dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def base_type(name: Column) -> Column:
    """Query type without its truncation suffix."""
    return F.regexp_replace(name, r"_truncated_50$", "")


def labelled(name: Column, labels: dict[str, str]) -> Column:
    """Label of a name, the name itself where there is none."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(pairs[name], name)


def int_list(text: Column) -> Column:
    """``"[1, 2]"`` as an array; a lone number is a list of one; anything else is empty."""
    wrapped = F.when(F.trim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce(F.filter(F.from_json(wrapped, "array<int>"), lambda x: x.isNotNull()), F.array().cast("array<int>"))


def matrix_size(tag: Column) -> tuple[Column, Column]:
    """Rows and columns of a matrix tag such as ``M!()-2x3``; -1 where it has none."""
    get = lambda g: F.coalesce(F.regexp_extract(tag, r"^M!.*?(\d+)x(\d+)$", g).try_cast("int"), F.lit(-1))
    return get(1), get(2)


RELATIONS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def relation(index: Column) -> Column:
    """One-character label of the index-th child."""
    return F.substring(F.lit(RELATIONS), index + 1, F.lit(1))


# Fixed value: what counts as a formula inside a query text.
FORMULA = r"(?is)\$\$.*?\$\$|\$.*?\$|<math.*?</math>|<mml:math.*?</mml:math>"


def cut_after_first_formula(text: Column, words: int = 3, most: int = 50) -> Column:
    """The last ``words`` words before the first formula, and the formula; the first ``most`` characters without one."""
    found = F.regexp_extract(text, FORMULA, 0)
    before = F.filter(F.split(F.substring(text, F.lit(1), F.instr(text, found) - 1), r"\s+"), lambda w: w != "")
    kept = F.slice(before, F.greatest(F.size(before) - words + 1, F.lit(1)), F.lit(words))
    return F.when(found == "", F.trim(F.substring(text, 1, most))).otherwise(
        F.trim(F.concat_ws(" ", F.when(F.size(before) > 0, F.array_join(kept, " ")), found))
    )


def cut_text(text: str, most: int = 50) -> str:
    """The first ``most`` characters; a formula across the cut is kept whole up to twice that, else left out.

    A cut inside a word goes back to the last space if that costs under three tenths.
    """
    spans = sorted(
        (m.start(), n, m.end())
        for n, p in enumerate(FORMULA.removeprefix("(?is)").split("|"))
        for m in re.finditer(p, text, re.I | re.S)
    )
    if len(text) <= most or not spans:
        return text[:most]
    crossing = next((s for s in spans if s[0] < most < s[2]), None)
    at = most if crossing is None else crossing[2] if crossing[2] <= 2 * most else crossing[0]
    out = text[:at]
    if at < len(text) and text[at] not in " \t\n.,;!?" and out.rfind(" ") > 0.7 * most:
        out = out[: out.rfind(" ")]
    return out.strip()


@F.pandas_udf(T.StringType())
def cut_keeping_formulas(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else cut_text(s))


@F.pandas_udf(T.StringType())
def ascii_id(name: pd.Series) -> pd.Series:
    """Name decomposed, without accents and without what isn't ASCII."""
    return name.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


def run_lengths(path: str) -> str:
    """Relation path as counts and labels: nnna becomes 3n1a."""
    return re.sub(r"(.)\1*", lambda m: f"{len(m[0])}{m[1]}", path)


def from_run_lengths(path: str) -> str:
    return re.sub(r"(\d+)(\D)", lambda m: m[2] * int(m[1]), path)


def short_path(path: str) -> str:
    """Paths longer than five labels by run lengths."""
    return run_lengths(path) if len(path) > 5 else path
