"""SimHash near-dedup with a generalised pigeonhole search.

A 64-bit fingerprint is taken of every text; fingerprints that differ in at
most ``TAU`` bits are linked and linked groups become components.  The search
for links groups correlated bits into partitions and gives the partitions
thresholds t_i with sum(t_i) = TAU - m + 1 (t_i = -1: partition unused): any
two fingerprints within TAU bits are within t_i bits in some partition i.  The
number of partitions and the thresholds are chosen by dynamic programming on
estimated candidate counts.  Fingerprints are indexed by their partition
values, probes enumerate the values within t_i bits, and what meets is
verified on all 64 bits.

Equal fingerprints are one node, so copies never make pairs.  Partition
values that many fingerprints share (a dense cluster) are compared in blocks
of bounded size, from each of which only a spanning forest of links leaves
the task.

Cases: a null text counts as empty, and texts without a word have fingerprint
zero and are linked like any other; a null doc_id takes part but is never a
component's smallest id unless the whole component has none; repeated rows
come back as often as they are given; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemniscate.llm.common import join_counted, packed, scratch, stored, unpacked
from lemniscate.llm.components import components

TAU = 3
SHINGLE = 3
SEED = 42
BITS = 64


@dataclass(frozen=True)
class SearchRules:
    #: Partition values that more fingerprints share are compared in blocks, not by the join.
    hot: int = 32
    #: Fingerprints in a block.
    block: int = 1024
    #: Fingerprints from which candidate counts are estimated; they only steer the layout.
    sample: int = 2048


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [h(b" ".join(words), SEED)]
    else:
        hashes = [h(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]
    a = np.array(hashes, dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(a), 1 << 15):
        counts += np.unpackbits(a[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(a)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[Any]) -> Iterator[Any]:
    import pyarrow as pa

    for batch in batches:
        fps = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def _fingerprints_with_hash(batches: Iterator[Any]) -> Iterator[Any]:
    import pyarrow as pa

    for batch in batches:
        (out,) = _fingerprints([batch])
        yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2)], names=["doc_id", "fp", "h"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _gram(batches: Iterator[Any]) -> Iterator[Any]:
    """Of the task's fingerprints: how often bits i and j are both set."""
    import pyarrow as pa

    total = np.zeros((BITS, BITS), dtype=np.int64)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for k in range(0, len(fps), 1 << 14):
            x = np.unpackbits(fps[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.int64)
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "n"])


def bit_order(n: int, gram: np.ndarray) -> list[int]:
    """The 64 bits as a chain in which correlated bits stand side by side."""
    p = np.diag(gram) / max(n, 1)
    cov = gram / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, -1)
    chain = [int(np.unravel_index(np.argmax(corr), corr.shape)[0])]
    left = set(range(BITS)) - set(chain)
    while left:
        chain.append(max(left, key=lambda b: (corr[chain[-1], b], -b)))
        left.discard(chain[-1])
    return chain


def allocate(widths: list[int], share: list[list[float]], n: int) -> tuple[float, list[int]]:
    """Thresholds with sum TAU - m + 1 of least cost, by dynamic programming.

    ``share[i][t]``: estimated share of fingerprints within t bits in partition
    i.  A partition with threshold t costs its probes and its candidates.
    """
    m = len(widths)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, ts) in best.items():
            for t in range(-1, TAU + 1):
                own = 0.0 if t < 0 else sum(comb(widths[i], r) for r in range(t + 1)) + n * share[i][t]
                if total + t not in new or cost + own < new[total + t][0]:
                    new[total + t] = (cost + own, [*ts, t])
        best = new
    return best[TAU - m + 1]


def layout(n: int, gram: np.ndarray, sample: np.ndarray) -> list[tuple[int, list[int], int]]:
    """The partitions that are probed: (number, bits, threshold)."""
    chain = bit_order(n, gram)
    p = np.diag(gram) / max(n, 1)
    differ = 2 * p * (1 - p)
    x = np.unpackbits(sample.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    best: tuple[float, list[tuple[int, list[int], int]]] | None = None
    for m in (2, 3, 4, 5, 6):
        groups = [list(map(int, g)) for g in np.array_split(np.array(chain), m)]
        share = []
        for g in groups:
            odds = np.zeros(TAU + 1)
            odds[0] = 1.0
            for b in g:  # as if bits were independent
                odds = odds * (1 - differ[b]) + np.concatenate([[0.0], odds[:-1]]) * differ[b]
            seen = np.zeros(TAU + 1)
            if len(x) > 1:
                y = x[:, g]
                ones = y.sum(axis=1)
                d = ones[:, None] + ones[None, :] - 2 * (y @ y.T)
                pairs = len(x) * (len(x) - 1)
                seen = np.array([((d == r).sum() - (len(x) if r == 0 else 0)) / pairs for r in range(TAU + 1)])
            share.append(list(np.maximum(np.cumsum(odds), np.cumsum(seen))))
        cost, ts = allocate([len(g) for g in groups], share, n)
        if best is None or cost < best[0]:
            best = cost, [(i, g, t) for i, (g, t) in enumerate(zip(groups, ts)) if t >= 0]
    return best[1]


def _masks(bits: list[int], most: int) -> list[int]:
    """All values that set up to ``most`` of ``bits``."""
    from itertools import combinations

    return [_signed(sum(1 << b for b in c)) for r in range(most + 1) for c in combinations(bits, r)]


def _forest(n_bits: int):
    """Links of a block of indexed and a block of probing fingerprints, as few as keep the same components."""

    def run(batch: Any) -> Any:
        import pyarrow as pa

        side = batch.column("side").to_numpy()
        fps = batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        a, b = np.unique(fps[side == 0]), np.unique(fps[side == 1])
        us: list[np.ndarray] = []
        vs: list[np.ndarray] = []
        left_a, left_b = np.ones(len(a), bool), np.ones(len(b), bool)
        # Breadth first over the bipartite graph; each fingerprint is reached once.
        for start in range(len(a)):
            if not left_a[start]:
                continue
            left_a[start] = False
            queue = [(0, start)]
            while queue:
                kind, k = queue.pop()
                own, other, left = (a, b, left_b) if kind == 0 else (b, a, left_a)
                idx = np.flatnonzero(left)
                if not len(idx):
                    continue
                near = idx[np.bitwise_count(other[idx] ^ own[k]) <= n_bits]
                left[near] = False
                us.append(np.full(len(near), own[k]))
                vs.append(other[near])
                queue.extend((1 - kind, int(x)) for x in near)
        u = np.concatenate(us) if us else np.zeros(0, np.uint64)
        v = np.concatenate(vs) if vs else np.zeros(0, np.uint64)
        kept = u != v
        return pa.table({"u": pa.array(u[kept].view(np.int64)), "v": pa.array(v[kept].view(np.int64))})

    return run


def links(fps: DataFrame, rules: SearchRules = SearchRules()) -> DataFrame:
    """Links (u, v) among distinct fingerprints ``fp`` that keep all components of "at most TAU bits differ"."""
    n = fps.count()
    gram = np.zeros((BITS, BITS), dtype=np.int64)
    for i, j, k in fps.mapInArrow(_gram, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        gram[i, j] = k
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp")).limit(rules.sample).collect()], dtype=np.int64)
    parts = layout(n, gram, sample)

    def keys(probing: bool) -> DataFrame:
        made = [
            F.struct(
                F.lit(i).alias("part"),
                F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits)))).bitwiseXOR(F.lit(mask)).alias("key"),
            )
            for i, bits, t in parts
            for mask in _masks(bits, t if probing else 0)
        ]
        return fps.select("fp", F.explode(F.array(*made)).alias("k")).select("fp", "k.part", "k.key")

    index, probes = keys(False), keys(True)
    counts = stored(index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")), "counts", n * len(parts))
    single = [i for i, _, t in parts if t == 0]  # a lone fingerprint meets nothing there
    light = counts.filter((F.col("n") <= rules.hot) & ((F.col("n") > 1) | ~F.col("part").isin(single)))
    on = ["part", "key"]
    near = (
        index.join(light.select(*on), on)
        .join(probes.withColumnRenamed("fp", "other"), on)
        .filter((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= TAU))
        .select(F.col("fp").alias("u"), F.col("other").alias("v"))
    )
    hot = counts.filter(F.col("n") > rules.hot)
    n_probes = probes.join(hot, on).groupBy(*on).agg(F.count(F.lit(1)).alias("n_probes"), F.first("n").alias("n"))
    grid = stored(
        n_probes.select(
            *on, F.ceil(F.col("n") / rules.block).cast("int").alias("rows"), F.ceil(F.col("n_probes") / rules.block).cast("int").alias("cols")
        ),
        "grid",
        n * sum(len(_masks(bits, t)) for _, bits, t in parts),
    )
    block = F.xxhash64("fp", F.lit(1))
    a = (
        index.join(grid, on)
        .withColumn("x", F.pmod(block, F.col("rows")).cast("int"))
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    )
    b = (
        probes.join(grid, on)
        .withColumn("y", F.pmod(block, F.col("cols")).cast("int"))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    )
    cells = a.select(*on, "x", "y", "fp", F.lit(0).alias("side")).unionByName(b.select(*on, "x", "y", "fp", F.lit(1).alias("side")))
    dense = cells.groupBy(*on, "x", "y").applyInArrow(_forest(TAU), "u long, v long")
    return near.unionByName(dense)


def near_duplicates(docs: DataFrame, rules: SearchRules = SearchRules()) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest doc_id reachable)."""
    with scratch():
        marked = stored(fingerprints(docs), "fingerprints")
        hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
        return stored(_classified(marked, rules).select("doc_id", hexed, "component_id"), "near-duplicates", lasting=True)


def _classified(marked: DataFrame, rules: SearchRules) -> DataFrame:
    """``marked`` (doc_id, fp, ...) with ``root`` (a fingerprint of the component) and ``component_id``."""
    total = marked.count()
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes", total)
    roots = components(links(nodes.select("fp"), rules), total)
    linked = stored(nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", F.col("root").alias("_root"), "least"), "linked", total)
    smallest = linked.groupBy(F.col("_root").alias("root")).agg(F.min("least").alias("linked_id"), F.count(F.lit(1)).alias("size"))
    smallest = stored(smallest, "smallest", total)
    # One component may hold most fingerprints: its root is broadcast.
    moved = join_counted(linked.select("fp", "_root"), smallest.withColumn("_r", F.col("root")), "_root", "_r", "size", linked.count()).select("fp", "root", "linked_id")
    ids = nodes.join(moved, "fp", "left").select(
        F.col("fp").alias("_fp"),
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("linked_id")).alias("component_id"),
        "n",
    )
    return join_counted(marked, stored(ids, "ids", total), "fp", "_fp", "n", total).drop("n")


def keep_one(docs: DataFrame, rules: SearchRules = SearchRules()) -> DataFrame:
    """One row of each component of ``docs``, all columns unchanged: the one with the smallest doc_id.

    A row without doc_id stays only where its component has no other; among
    rows with the same id the one with the smallest text hash stays.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("h").alias("h")))
    with scratch():
        marked = stored(hashed.mapInArrow(_fingerprints_with_hash, "doc_id long, fp long, h long"), "fingerprints")
        kept = _classified(marked, rules).groupBy("root").agg(best.alias("k")).select(F.col("k.id").alias("_id"), F.col("k.h").alias("_h"))
        kept = stored(kept, "kept", lasting=True)
        repeated = marked.groupBy("doc_id", "h").count().filter("count > 1").limit(1).count() > 0
    rows = packed(docs)
    chosen = rows.join(
        kept, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_h")), "left_semi"
    )
    if repeated:
        chosen = chosen.withColumns({"_id": F.col("row.doc_id"), "_h": F.xxhash64("row.text")}).dropDuplicates(["_id", "_h"])
    return unpacked(chosen, docs.columns, {})
