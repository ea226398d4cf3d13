"""Alignment of two tokenizers' tokens by interval coalescing.

Both tokenizations cut the same bytes, a space and the text.  The tokens of
both are sorted by start (lexsort) and a running maximum of their ends
(maximum.accumulate) is kept: where a start reaches the maximum of all before
it, both tokenizations end a token, and a new group begins.  All A and B tokens
of a group are linked.  An id pair's count is the number of documents that hold
it linked; links whose count is the highest of their A id are its best ones.

Documents' pairs are stored, counted by shuffle after partial counting, and
their counts joined back: the most frequent pairs, up to a bound, are broadcast,
the others, of which no document holds many, are joined by shuffle.

Cases: texts that are null or empty, or whose tokens of either side don't spell
the space and the text (unknown characters, a literal U+2581, other
normalisation), have no tokens, and zeros; ties of the highest count are all
best; repeated rows count as documents of their own; a null doc_id is a
document too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemniscate.llm.common import scratch, stored

MARK = "▁"
#: Ids of B are below this; a pair of ids is one number.
B_IDS = 1 << 24
#: Texts, and about as many of their code points, that are aligned at once.
TEXTS, POINTS = 256, 1 << 21
#: Pairs of tokens from which a group's equal ids are counted before they are paired.
WIDE = 1 << 12
#: Pairs that are broadcast at most.
HOT_PAIRS = 500_000


@dataclass(frozen=True)
class Vocabularies:
    """Files of a byte-level BPE as ranks (A) and of a piece model (B); None: the given tokenizers' own."""

    ranks: str | None = None
    pieces: str | None = None


class Side:
    """One vocabulary: ids of texts, the bytes of every id, and the ids as text with what may follow them."""

    def __init__(self, encode: Any, spelled: list[bytes], last: str) -> None:
        self.encode, self.spelled = encode, spelled
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.listed = [np.array([f"{i}{end}" for i in range(len(spelled))], object) for end in (",", last)]

    def spells(self, ids: list[int], raw: bytes) -> bool:
        return b"".join(map(self.spelled.__getitem__, ids)) == raw


@lru_cache(maxsize=2)
def sides(ranks_path: str, model_path: str) -> tuple[Side, Side]:
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    a_bytes = [b""] * (max(ranks.values()) + 1)
    for x, i in ranks.items():
        a_bytes[i] = x
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    b_bytes = [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(pieces)]
    return Side(lambda text: bpe.encode_ordinary(" " + text), a_bytes, "|"), Side(sp.encode, b_bytes, ";")


def coalesced(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every A and every B token (byte ranges) the number of its group."""
    starts, ends = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[: len(starts_a)], group[len(starts_a) :]


def counted(group: np.ndarray, ids: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens as (group, id, number): those of wide groups once per id, the others one by one, in the groups' order."""
    at = wide[group]
    if not at.any():
        return group, ids, np.ones(len(ids), np.int64)
    key, n = np.unique(group[at] * B_IDS + ids[at], return_counts=True)
    group, ids, n = (np.concatenate(x) for x in ((group[~at], key // B_IDS), (ids[~at], key % B_IDS), (np.ones((~at).sum(), np.int64), n)))
    order = np.argsort(group, kind="stable")
    return group[order], ids[order], n[order]


def linked_pairs(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document (``doc``: of every group) its distinct id pairs and how often each is linked: doc, pair, times, sorted."""
    n_groups = len(doc)
    wide = np.bincount(group_a, minlength=n_groups) * np.bincount(group_b, minlength=n_groups) > WIDE
    group_a, a, times_a = counted(group_a, a, wide)
    group_b, b, times_b = counted(group_b, b, wide)
    size_b = np.bincount(group_b, minlength=n_groups)
    first_b = np.cumsum(size_b) - size_b
    n = size_b[group_a]
    left = np.repeat(np.arange(len(a)), n)
    right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_b[group_a], n)
    key = (doc[group_a] << 41 | a << 24)[left] | b[right]
    order = np.argsort(key)
    key, times = key[order], (times_a[left] * times_b[right])[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key, times = key[first], np.add.reduceat(times, first) if len(first) else times
    return key >> 41, key & ((1 << 41) - 1), times


def listed(side_a: Side, a: np.ndarray, group_a: np.ndarray, side_b: Side, b: np.ndarray, group_b: np.ndarray) -> np.ndarray:
    """The ids as text in the order of groups, A's before B's, each with the mark that follows it."""
    n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
    out = np.empty(len(a) + len(b), object)
    before = np.cumsum(np.bincount(group_b, minlength=n_groups)) - np.bincount(group_b, minlength=n_groups)
    for side, ids, group, at in ((side_a, a, group_a, before), (side_b, b, group_b, np.cumsum(np.bincount(group_a, minlength=n_groups)))):
        last = np.concatenate([group[1:] != group[:-1], [True]])[: len(group)]
        out[np.arange(len(ids)) + at[group]] = np.where(last, side.listed[1][ids], side.listed[0][ids])
    return out


@dataclass(slots=True)
class Batch:
    """Of every text: numbers of A tokens, B tokens, groups, links and distinct pairs, and the groups as text; all texts' pairs and times end to end."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    n_pairs: np.ndarray
    groups: list[str]
    pairs: np.ndarray
    times: np.ndarray


def aligned(texts: list[str | None], side_a: Side, side_b: Side) -> Batch:
    """The alignments of texts, laid end to end, in one pass."""
    ids: tuple[list[list[int]], list[list[int]]] = ([], [])
    for text in texts:
        raw = b"" if not text else f" {text}".encode("utf-8", "surrogatepass")
        both = [x.encode(text) for x in (side_a, side_b)] if raw else [[], []]
        fits = all(x.spells(y, raw) for x, y in zip((side_a, side_b), both))
        for x, y in zip(ids, both):
            x.append(y if fits else [])
    n_a, n_b = (np.array([len(x) for x in y], np.int64) for y in ids)
    a, b = (np.fromiter(chain.from_iterable(y), np.int64, int(n.sum())) for y, n in zip(ids, (n_a, n_b)))
    ends_a, ends_b = np.cumsum(side_a.lengths[a]), np.cumsum(side_b.lengths[b])
    group_a, group_b = coalesced(ends_a - side_a.lengths[a], ends_a, ends_b - side_b.lengths[b], ends_b)
    doc = np.zeros(int(group_a[-1]) + 1 if len(group_a) else 0, np.int64)
    doc[group_a] = np.repeat(np.arange(len(texts)), n_a)
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=len(texts)).astype(np.int64)
    links = np.bincount(group_a, minlength=len(doc)) * np.bincount(group_b, minlength=len(doc))
    owner, pairs, times = linked_pairs(a, group_a, b, group_b, doc)
    words = listed(side_a, a, group_a, side_b, b, group_b).tolist()
    stops = np.cumsum(n_a + n_b).tolist()
    groups = ["".join(words[i:j])[:-1] for i, j in zip([0, *stops], stops)]
    return Batch(n_a, n_b, np.bincount(doc, minlength=len(texts)), per_doc(links), np.bincount(owner, minlength=len(texts)), groups, pairs, times)


def _slices(texts: Any) -> Iterator[tuple[int, list[str | None]]]:
    """A batch's texts, a bounded number and length at a time."""
    start, held, n = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.as_py())
        n += len(held[-1] or "")
        if len(held) == TEXTS or n > POINTS or i + 1 == len(texts):
            yield start, held
            start, held, n = i + 1, [], 0


def _aligned(ranks_path: str, model_path: str):
    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        both = sides(ranks_path, model_path)
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                x = aligned(texts, *both)
                offsets = pa.array(np.concatenate([[0], np.cumsum(x.n_pairs)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(y)) for y in (x.pairs, x.times)]
                columns = [batch.column(0).slice(start, len(texts)), *map(pa.array, (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(x.groups, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return run


def align(docs: DataFrame, using: Vocabularies = Vocabularies()) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, ``groups`` (``a1,a2|b1;…``, ids in order) and its distinct linked
    id pairs (``pairs``, as a * B_IDS + b) with the number of their links (``times``)."""
    import public_tokenizers

    ranks = using.ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = using.pieces or public_tokenizers.path("piece_bpe_32k.model")
    shape = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_aligned(ranks, pieces), shape)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Of every linked id pair: ``pair``, ``n`` (documents that hold it) and ``best`` (no other pair of its A id has more)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "pairs")
    # One row per id of A's vocabulary.
    highest = counts.groupBy(F.floor(F.col("pair") / B_IDS).alias("_a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(highest), F.floor(F.col("pair") / B_IDS) == F.col("_a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_report(docs: DataFrame, using: Vocabularies = Vocabularies(), hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    with scratch():
        given = align(docs, using).select("doc_id", "n_a", "n_b", "n_groups", "n_links", sha, "pairs", "times")
        marked = stored(given.withColumn("row", F.monotonically_increasing_id()), "aligned")
        counts = stored(pair_counts(marked), "counts")
        # The least count of broadcast pairs: a power of two, so that only as many numbers are looked at.
        held = {k: n for k, n in counts.groupBy(F.floor(F.log2("n")).cast("int")).count().collect()}
        bar = next((k for k in range(64) if sum(n for x, n in held.items() if x >= k) <= hot_pairs), 64)
        hot = F.floor(F.log2("n")).cast("int") >= bar
        each = marked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        common = F.broadcast(counts.filter(hot))
        met = each.join(common, "pair")
        if bar > min(held, default=bar):
            met = met.unionByName(each.join(common.select("pair"), "pair", "left_anti").join(counts.filter(~hot), "pair"))
        sums = met.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
        )
        sums = stored(sums, "sums")
        out = marked.drop("pairs", "times").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
        return stored(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "alignment", lasting=True)
