"""Packing of tokenised documents into fixed windows by best-fit decreasing.

Overlong documents are first cut into full windows.  What remains of each
document is at most a window long, so remainders are exchangeable by length:
best-fit decreasing is run once on the histogram of lengths (at most one entry
per length up to the window), where a segment tree over remaining capacities
finds the tightest open window for all windows and remainders of a kind at
once.  Its outcome is a short list of runs, "the a-th to b-th remainder of
length L go to windows s, s+1, ... with k side by side"; remainders are ranked
by length in parallel and look their place up.  The plan's size depends on the
window alone, not on the corpus.

Cases: a null text is empty and holds only the end id; repeated rows are
documents of their own; a null doc_id is carried along; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemniscate.llm.common import scratch, stored
from lemniscate.llm.tokens import END, encoder

WINDOW = 1024
#: Pieces of one length are ranked in this many parts at least, and in more where a part would hold more rows.
PARTS = 64
ROWS_PER_PART = 250_000

Run = tuple[int, int, int, int, int, int]


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which of them have open windows."""

    def __init__(self, size: int) -> None:
        self.n = 1 << size.bit_length()
        self.open = [0] * (2 * self.n)

    def add(self, capacity: int, windows: int) -> None:
        at = capacity + self.n
        while at:
            self.open[at] += windows
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has an open window."""
        at = least + self.n
        if self.open[at]:
            return least
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.n:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.n
            at >>= 1
        return None


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[Run], int]:
    """Best-fit decreasing over a histogram of lengths.

    Runs (length, first rank, last rank + 1, first window, pieces per window,
    offset) and the number of windows.  Pieces of one length fill a window as
    far as they fit before the next one is looked for, as best fit does: the
    window just used is the tightest that is left.
    """
    tree = CapacityTree(window)
    groups: dict[int, list[tuple[int, int]]] = {}  # capacity: (first window, windows)
    runs: list[Run] = []
    opened = 0

    def put(capacity: int, first: int, count: int) -> None:
        if count and capacity:
            groups.setdefault(capacity, []).append((first, count))
            tree.add(capacity, count)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                each = window // length
                count = -(-left // each)
                first, capacity = opened, window
                opened += count
            else:
                first, count = groups[capacity].pop()
                tree.add(capacity, -count)
                each = capacity // length
            full, rest = min(count, left // each), 0
            if full:
                runs.append((length, rank, rank + full * each, first, each, window - capacity))
                put(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:
                rest = min(left, each)
                runs.append((length, rank, rank + rest, first + full, each, window - capacity))
                put(capacity - rest * length, first + full, 1)
                rank, left = rank + rest, left - rest
                full += 1
            if full < count:
                put(capacity, first + full, count - full)
    return runs, opened


def _pieces(path: str, ranks_path: str, window: int):
    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        encode = encoder(path, ranks_path)
        end = END.to_bytes(4, "little")
        for batch in batches:
            doc, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for k in range(0, n, window):
                    doc.append(i)
                    start.append(k)
                    length.append(min(window, n - k))
                    crc.append(zlib.crc32(ids[4 * k : 4 * (k + window)]))
                    total.append(n)
            columns = [batch.column(0).take(pa.array(doc, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, path: str | None = None, ranks_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Per piece of at most ``window`` ids: doc_id, start, length, ids_crc32, doc_tokens."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = _pieces(path, ranks_path, window)
    return docs.select("doc_id", "text").mapInArrow(made, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _places(runs: list[Run]):
    """A vectorised look-up: (length, rank) to (window, offset)."""
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
    # The key orders by length, then rank; ranks stay far below 2**52.
    keys = table[:, 0].astype(object) * (1 << 52) + table[:, 1] if len(table) else np.zeros(0, object)
    keys = keys.astype(np.int64) if len(table) else np.zeros(0, np.int64)

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            length = cols["length"].to_numpy(zero_copy_only=False)
            rank = cols.pop("rank").to_numpy(zero_copy_only=False)
            if not len(length):
                continue
            at = np.searchsorted(keys, length * (1 << 52) + rank, side="right") - 1
            _, a, _, first, each, offset = table[at].T
            window, side = np.divmod(rank - a, each)
            yield pa.RecordBatch.from_arrays(
                [*cols.values(), pa.array(first + window), pa.array(offset + side * length)],
                names=[*cols, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, path: str | None = None, ranks_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    with scratch():
        return stored(_packed(docs, path, ranks_path, window), "packed", lasting=True)


def _packed(docs: DataFrame, path: str | None, ranks_path: str | None, window: int) -> DataFrame:
    cut = stored(pieces(docs, path, ranks_path, window), "pieces")
    # One row per length, whatever the corpus.
    histogram = {x["length"]: x["count"] for x in cut.groupBy("length").count().collect()}
    runs, _ = plan(histogram, window)
    parts = max(PARTS, max(histogram.values(), default=0) // ROWS_PER_PART + 1)
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(
        F.col("length").alias("_length"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        cut.withColumn("rank", F.row_number().over(within))
        .join(offsets, (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part")))
        .withColumn("rank", F.col("rank") - 1 + F.col("before"))
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return ranked.select(*columns, "rank").mapInArrow(
        _places(runs), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
