"""Centroid clustering (Lloyd's rounds) that skips distances by ns-bounds.

Vectors are whole numbers.  Every vector keeps, for each centroid, the distance
that was last evaluated and the round of that evaluation; all rounds' centroids
are retained.  A stored distance is loosened by the norm of the centroid's
total displacement since its evaluation (the norm of the sum of its moves, not
the sum of their norms, so a centroid that wanders back loosens nothing).  A
centroid whose lower bound lies above the own centroid's upper bound is out;
where a bound fails, first the own distance and then those of the failing
centroids are evaluated in whole numbers, and ties go to the smaller number.
So every round's assignment is the exact one.

A round is one pass over the stored vectors, written to the shared folder.
Centroids are updated from the vectors that moved alone: a task adds up what
enters and leaves each cluster, and only one sum per cluster and component
reaches the driver.  Retained centroids take rounds x clusters x components
numbers, whatever the number of vectors.  Rounds end early when no centroid
moves, which changes no result.

Cases: vectors that are null, have another number of components, or hold a null
or non-finite component take no part, nor do those with a component of 2**27 or
more after scaling, whose distances a long cannot hold (a sum of distances that
a long cannot hold is given as the largest long); a null vec_id takes
part but starts no centroid before all others did; repeated rows count as often
as they are given, equal ones may start two centroids, of which the smaller
number gets the vectors; fewer vectors than clusters make fewer clusters; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemniscate.llm.common import discard, scratch, stored

#: Components are below this, so that squared distances fit in a long.
REACH = 1 << 27
#: Rows that are worked on at once.
TILE = 4096


@dataclass(frozen=True)
class ClusterRules:
    clusters: int = 8
    rounds: int = 10
    dims: int = 64
    scale: int = 1024
    #: Vectors whose sha256 of this and their id is smallest start the centroids.
    start: str = "3:"


@dataclass
class Clustering:
    #: vec_id, cluster, distance (squared, to the final centroid).
    assigned: DataFrame
    #: Centroids of every round, the final ones last.
    history: list[list[list[int]]] = field(default_factory=list)

    @property
    def centroids(self) -> list[list[int]]:
        return self.history[-1] if self.history else []


def whole_numbers(embeddings: DataFrame, rules: ClusterRules = ClusterRules()) -> DataFrame:
    """``vec_id`` and ``v``, the integer components, of the rows that take part."""
    x = F.col("embedding")
    scaled = F.transform(x, lambda c: F.lit(rules.scale) * c.cast("double"))
    fits = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < REACH))
    return embeddings.filter((F.size(x) == rules.dims) & fits).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(scaled, lambda c: F.floor(c).cast("int")).alias("v")
    )


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows of whole numbers."""
    d = v.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def reassign(v: np.ndarray, own: np.ndarray, dist: np.ndarray, seen: np.ndarray, history: np.ndarray) -> int:
    """Bring ``own``, ``dist`` and ``seen`` of the vectors up to the last of ``history`` (rounds x clusters x components).

    ``dist[i, j]``: distance of vector i and centroid j as evaluated in round
    ``seen[i, j]`` (-1: never).  Returns how many distances were evaluated.
    """
    now, k = len(history) - 1, history.shape[1]
    moved = np.sqrt(((history[-1] - history).astype(np.float64) ** 2).sum(axis=2))
    each, all_k = np.arange(len(v)), np.arange(k)
    loose = moved[seen, all_k]
    lower = np.where(seen < 0, -1.0, dist - loose)
    lower[each, own] = np.inf
    upper = np.where(seen[each, own] < 0, np.inf, dist[each, own] + loose[each, own])
    wide = lambda x: x * (1 + 1e-9) + 1e-6  # noqa: E731  rounding of bounds never decides
    rows = np.flatnonzero((lower <= wide(upper)[:, None]).any(axis=1))
    if not len(rows):
        return 0
    best = squared(v[rows], history[-1][own[rows]])
    dist[rows, own[rows]], seen[rows, own[rows]] = np.sqrt(best), now
    at, other = np.nonzero(lower[rows] <= wide(np.sqrt(best))[:, None])
    exact = squared(v[rows[at]], history[-1][other])
    dist[rows[at], other], seen[rows[at], other] = np.sqrt(exact), now
    table = np.full((len(rows), k), np.iinfo(np.int64).max)
    table[np.arange(len(rows)), own[rows]] = best
    table[at, other] = exact
    own[rows] = table.argmin(axis=1)
    return len(rows) + len(at)


def _matrix(column: Any, kind: Any) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(len(column), -1)


def _rows(x: np.ndarray) -> Any:
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _round(history: np.ndarray):
    """State rows (vec_id, v, cluster, dist, seen) after one assignment; ``before`` is the cluster that was left."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, TILE):
                b = batch.slice(k, TILE)
                v, before = _matrix(b.column(1), np.int64), b.column(2).to_numpy()
                own = np.maximum(before, 0).astype(np.int64)
                dist, seen = _matrix(b.column(3), np.float64), _matrix(b.column(4), np.int32)
                reassign(v, own, dist, seen, history)
                columns = [b.column(0), b.column(1), pa.array(own.astype(np.int32)), _rows(dist), _rows(seen), b.column(2)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "dist", "seen", "before"])

    return run


def _flows(k: int, dims: int):
    """Of the task's moved vectors: per cluster the number and the component sums of what entered less what left."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        total = np.zeros((k, dims + 1), dtype=np.int64)
        for batch in batches:
            v = np.hstack([np.ones((batch.num_rows, 1), np.int64), _matrix(batch.column(0), np.int64)])
            np.add.at(total, batch.column(1).to_numpy(), v)
            left = batch.column(2).to_numpy()
            np.subtract.at(total, left[left >= 0], v[left >= 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), _rows(total)], names=["cluster", "flow"])

    return run


def _distances(centroids: np.ndarray):
    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in batches:
            own = batch.column(2).to_numpy()
            d = squared(_matrix(batch.column(1), np.int64), centroids[own])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, rules: ClusterRules = ClusterRules()) -> Clustering:
    """``vectors`` (vec_id: long, v: array<int>) to exact Lloyd clusters; see the module for starts, ties and empty clusters."""
    named = vectors.withColumn("_h", F.sha2(F.concat(F.lit(rules.start), F.col("vec_id").cast("string")), 256))
    starts = [list(r["v"]) for r in named.orderBy(F.asc_nulls_last("_h"), "v").limit(rules.clusters).collect()]
    if not starts:
        return Clustering(vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0))
    k, dims = len(starts), len(starts[0])
    history, totals = [starts], [[0] * (dims + 1) for _ in range(k)]
    shape = "vec_id long, v array<int>, cluster int, dist array<double>, seen array<int>"
    with scratch():
        state = vectors.select(
            "vec_id",
            "v",
            F.lit(-1).alias("cluster"),
            F.array_repeat(F.lit(0.0), k).alias("dist"),
            F.array_repeat(F.lit(-1), k).alias("seen"),
        )
        for _ in range(rules.rounds):
            new = stored(state.mapInArrow(_round(np.array(history, dtype=np.int64)), f"{shape}, before int"), "assigned")
            flows = new.filter("cluster <> before").select("v", "cluster", "before").mapInArrow(_flows(k, dims), "cluster int, flow array<long>")
            flows = flows.select("cluster", F.posexplode("flow").alias("d", "x")).groupBy("cluster", "d").agg(F.sum(F.col("x").cast("decimal(20,0)")))
            for c, d, x in flows.collect():
                totals[c][d] += int(x)
            discard(state)
            state = new.drop("before")
            state._lemniscate_path = new._lemniscate_path
            history.append([[x // t[0] for x in t[1:]] if t[0] else old for t, old in zip(totals, history[-1])])
            if history[-1] == history[-2]:
                break
        last = state.mapInArrow(_round(np.array(history, dtype=np.int64)), f"{shape}, before int")
        done = last.mapInArrow(_distances(np.array(history[-1], dtype=np.int64)), "vec_id long, cluster int, distance long")
        return Clustering(stored(done, "clusters", lasting=True), history)


def cluster_report(embeddings: DataFrame, rules: ClusterRules = ClusterRules()) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found = cluster(whole_numbers(embeddings, rules), rules)
    sums = {r[0]: int(r[1]) for r in found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}
    fits = lambda x: min(x, (1 << 63) - 1)
    rows = [(c, fits(sums.get(c, 0)), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(found.centroids)]
    per_cluster = embeddings.sparkSession.createDataFrame(rows, "_c int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.assigned.join(F.broadcast(per_cluster), F.col("cluster") == F.col("_c"))
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
