"""Exact top-k inner products by no-random-access aggregation.

Components become the integers floor(64 * x); a score is an integer inner
product.  The vector table is dealt into parts and the query set into blocks;
each (block, part) cell is one small group.  In a cell the dimensions form a
few lists: a list holds, for a query, the partial score of every vector of the
part, sorted.  Lists are read from the top to a common depth.  What has been
read gives every vector a lower bound (unread entries count as the list's
last) and an upper bound (unread entries count as the last one read).  Reading
goes deeper until a vector that was seen in no list can't reach the k-th lower
bound; then the final scores of the vectors whose upper bound reaches it are
resolved.  The cells' winners meet in one ranking per query.

Cases: vectors that are null or hold a null or non-finite component take no
part, nor do rows without id; only vectors of the query's length are
candidates; a query's own id is excluded; repeated rows with another id are
candidates of their own, and of rows that repeat a query's id the smallest
vector is asked; an empty table gives an empty result; ties go to the smaller
id; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64


@dataclass(frozen=True)
class TopKRules:
    k: int = 20
    #: Lists into which the dimensions are grouped.
    lists: int = 4
    #: Share of every list that is read first; it doubles until reading may stop.
    depth: float = 0.25
    #: Vectors in a part and queries in a block, on average: equal numbers copy the fewest rows into cells of a given size.
    part: int = 16_384
    block: int = 16_384
    #: Queries that are worked on at once.
    tile: int = 64


def _matrix(column: Any) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int64)
    return flat.reshape(len(column), -1) if len(column) and len(flat) else np.zeros((len(column), 0), np.int64)


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, r: TopKRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one cell: (query id, vector id, score) of every query's k best, ties to smaller ids."""
    n, dims = vectors.shape
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # Partial scores are whole numbers: float32 holds them exactly up to 2**24, float64 up to 2**53.
    reach = max(1.0, float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dims, 1))
    kind = np.float32 if reach < 2**24 else np.float64
    slack = 0.0 if reach < 2**53 else reach * 1e-12
    groups = [g for g in np.array_split(np.arange(dims), r.lists) if len(g)] or [np.arange(0)]
    columns = [np.ascontiguousarray(vectors[:, g].T, dtype=kind) for g in groups]
    for at in range(0, len(query_ids), r.tile):
        q, own = queries[at : at + r.tile], query_ids[at : at + r.tile]
        lists = [q[:, g].astype(kind) @ c for g, c in zip(groups, columns)]
        ordered = [np.sort(p, axis=1) for p in lists]
        mine = own[:, None] == ids[None, :]
        depth = max(1, int(n * r.depth))
        while True:
            frontier = [s[:, n - depth][:, None] for s in ordered]
            seen = [p >= f for p, f in zip(lists, frontier)]
            lower = sum(np.where(x, p, s[:, :1]) for x, p, s in zip(seen, lists, ordered))
            lower[mine] = -np.inf
            bar = np.partition(lower, n - r.k, axis=1)[:, n - r.k] if n > r.k else np.full(len(q), -np.inf)
            # Outsiders: seen in no list, so below every frontier.
            if depth >= n or (sum(f[:, 0] for f in frontier) < bar - slack).all():
                break
            depth = min(n, 2 * depth)
        upper = sum(np.where(x, p, f) for x, p, f in zip(seen, lists, frontier))
        upper[mine] = -np.inf
        row, col = np.nonzero((upper >= bar[:, None] - slack) & ~mine)
        score = np.einsum("ij,ij->i", q[row], vectors[col])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, np.arange(len(q)))
        best = np.arange(len(row)) - first[row] < r.k
        out.append((own[row[best]], ids[col[best]], score[best]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), (), ())))


def _cell(rules: TopKRules):
    def run(batch: Any) -> Any:
        import pyarrow as pa

        side = batch.column("side").to_numpy()
        ids = batch.column("vec_id").to_numpy()
        v = _matrix(batch.column("v"))
        found = search(ids[side == 0], v[side == 0], ids[side == 1], v[side == 1], rules) if (side == 0).any() else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(x.astype(np.int64)) for x in found))))

    return run


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``v``, the integer components, of the rows that take part."""
    x = F.col("embedding")
    wrong = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return embeddings.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~wrong).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long")).alias("v"),
    )


def top_k(vectors: DataFrame, queries: DataFrame, rules: TopKRules = TopKRules()) -> DataFrame:
    """``vectors`` and ``queries`` (vec_id, v) to query_id, rank, vec_id, score."""
    parts = max(1, -(-vectors.count() // rules.part))
    blocks = max(1, -(-queries.count() // rules.block))
    v = vectors.select(
        F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(0).alias("side"),
        "vec_id",
        "v",
    )
    q = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.lit(1).alias("side"),
        "vec_id",
        "v",
    )
    cells = v.unionByName(q).withColumn("dims", F.size("v"))
    found = cells.groupBy("dims", "block", "part").applyInArrow(_cell(rules), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= rules.k).select("query_id", "rank", "vec_id", "score")
    )


def every_twentieth(embeddings: DataFrame, rules: TopKRules = TopKRules()) -> DataFrame:
    """The query set "ids divisible by 20" against all rows."""
    vectors = whole_numbers(embeddings)
    asked = vectors.filter(F.col("vec_id") % 20 == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return top_k(vectors, asked, rules)
