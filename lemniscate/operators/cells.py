"""Nearest neighbours by an index of vectors in cells.

Every row lies in the cell of a centroid and, within it, in a ring of angles
around the centroid.  A query's angle to the centroid bounds its angle to all
rows of a ring (triangle inequality on the sphere), so rings that cannot hold
one of its k best are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemniscate.functions.vectors import dot, doubles, norm, unit
from lemniscate.operators.search import top_k
from lemniscate.session import discard, stored

#: Angles computed in doubles may be off by this much; bounds are loosened by it.
SLACK = 1e-6
#: A matrix product of unit vectors and the same sums in order differ by less.
ROUNDING = 1e-9
#: Scores that a task holds at once, and queries that it gets for one part (about).
BLOCK, QUERIES = 2_000_000, 4096


@dataclass(frozen=True)
class Layout:
    """How an index is cut.  None of it changes exact results.

    ``sample``: about how many rows the centroids are fitted on (a bound; every row is indexed).
    ``ring``: the width of a ring in radians.  ``part``: rows of a cell that one task scores; a
    larger cell, such as one of equal vectors, is dealt into several parts.
    """

    cells: int = 64
    sample: int = 50_000
    ring: float = 0.1
    part: int = 50_000
    seed: int = 7


@dataclass(frozen=True)
class CellIndex:
    """``rows``: cell, part, ring, id, v (of length 1).  ``rings``: cell, ring, c (the centroid), nearest and farthest angle, n rows, parts of the cell.

    ``left_out``: rows without a direction (null, zero or not finite) or with another number of components.
    """

    rows: DataFrame
    rings: DataFrame
    dims: int
    left_out: int


@dataclass(frozen=True)
class Found:
    """``hits``: query_id, id, score, rank.  ``work``: query_id, rows, rows_read: how many of the index's rows were scored."""

    hits: DataFrame
    work: DataFrame


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _directed(df: DataFrame, dims: int) -> DataFrame:
    """Rows of ``df`` whose ``vector`` has a direction and ``dims`` components."""
    n = norm(F.col("vector"))
    return df.filter((F.size("vector") == dims) & (n > 0) & (n < float("inf")))


def build(collection: DataFrame, path: str, dims: int, layout: Layout = Layout()) -> CellIndex:
    """Index (id, vector) under the new folder ``path``; every row with a direction is indexed.  Ids are whole numbers or strings.

    Centroids come from cosine k-means over a sample by hash.  An empty
    collection gives an empty index; rows that are repeated stay repeated.
    """
    spark = collection.sparkSession
    given = collection.select("id", doubles(F.col("vector")).alias("vector"))
    units = stored(_directed(given, dims).select("id", unit(F.col("vector")).alias("v")), "units")
    total, n = given.count(), units.count()
    share = min(1.0, layout.sample / max(n, 1))
    rows = units.withColumn("x", array_to_vector("v"))
    # Ids are mixed with the seed, so that the sample isn't tied to other uses of the same hash.
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(layout.seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("x") if share < 1 else rows.select("x")
    # Where the sample is empty (possible only for a few rows), all rows are the sample.
    sample = sample if share == 1 or sample.limit(1).count() else rows.select("x")
    if n:
        model = KMeans(k=max(2, layout.cells), featuresCol="x", predictionCol="cell", distanceMeasure="cosine", maxIter=10, seed=layout.seed).fit(sample)
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        rows = model.transform(rows).drop("x")
    else:
        centres, rows = [], rows.drop("x").withColumn("cell", F.lit(0))
    # One row per cell: the number of cells bounds what is broadcast.
    around = spark.createDataFrame(centres, "cell int, c array<double>").select("cell", unit(F.col("c")).alias("c")).filter("c IS NOT NULL")
    placed = rows.join(F.broadcast(around), "cell").withColumn("angle", _angle(dot(F.col("v"), F.col("c"))))
    placed = placed.select("id", "v", "cell", F.floor(F.col("angle") / layout.ring).cast("int").alias("ring"), "angle")
    placed = stored(placed, "placed")
    discard(units)
    rings = placed.groupBy("cell", "ring").agg(F.min("angle").alias("nearest"), F.max("angle").alias("farthest"), F.count(F.lit(1)).alias("n"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / layout.part).cast("int").alias("parts"))
    rings = rings.join(F.broadcast(around), "cell").join(sizes, "cell")
    # At most cells * (pi / ring + 1) rows.
    rings.coalesce(1).write.parquet(f"{path}/rings")
    rings = spark.read.parquet(f"{path}/rings")
    salt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("parts")).cast("int")
    dealt = placed.join(F.broadcast(rings.select("cell", "parts").distinct()), "cell").select("cell", salt.alias("part"), "ring", "id", "v")
    dealt.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part", "ring").write.parquet(f"{path}/rows")
    discard(placed)
    spark.createDataFrame([(json.dumps({"dims": dims, "left_out": total - n}),)], "value string").coalesce(1).write.text(f"{path}/about")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> CellIndex:
    """The index that :func:`build` wrote to ``path``, in whatever session."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return CellIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/rings"), about["dims"], about["left_out"])


def _plan(index: CellIndex, asked: DataFrame) -> DataFrame:
    """n_query, cell, ring, parts, n, low, before: the least angle that a row of the ring can have; rows of the rings before, nearest centroids first.

    Every query meets every ring's bounds, which the number of cells bounds, not the number of rows.
    """
    rings = index.rings.groupBy("cell", "parts").agg(F.first("c").alias("c"), F.collect_list(F.struct("ring", "nearest", "farthest", "n")).alias("rings"))
    bounds = rings.agg(F.collect_list(F.struct("cell", "parts", "c", "rings")).alias("cells"))
    met = asked.select("n_query", "q", F.explode(bounds.scalar()).alias("x"))
    met = met.select("n_query", "x.cell", "x.parts", _angle(dot(F.col("q"), F.col("x.c"))).alias("off"), F.explode("x.rings").alias("r"))
    low = F.greatest(F.lit(0.0), F.col("off") - F.col("r.farthest"), F.col("r.nearest") - F.col("off")) - SLACK
    met = met.select("n_query", "cell", "parts", "off", low.alias("low"), "r.ring", "r.n")
    earlier = Window.partitionBy("n_query").orderBy("off", "cell", "low", "ring").rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("off")


def best_of_part(rows: pd.DataFrame, asked: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """n_query, id, score: of each query the k best rows in its rings that reach its bar, ties by id.

    A matrix product finds who may be among them; their scores are then summed
    component by component, so that equal vectors have equal scores.
    """
    rows = rows.sort_values(["ring", "id"], kind="stable", ignore_index=True)
    v, q = np.stack(rows["v"]), np.stack(asked["q"])
    bar, number, ids = asked["bar"].fillna(-np.inf).to_numpy(float), asked["n_query"].to_numpy(), rows["id"].to_numpy()
    where = asked["rings"].explode().astype(int)
    where = pd.Series(np.repeat(np.arange(len(asked)), asked["rings"].map(len)), index=where.to_numpy())
    for ring, of in rows.groupby("ring").indices.items():
        wanted = where[where.index == ring].to_numpy()
        step = max(1, BLOCK // len(of))
        for at in range(0, len(wanted), step):
            some = wanted[at : at + step]
            product = v[of] @ q[some].T
            least = bar[some] - ROUNDING
            if len(of) > k:
                least = np.maximum(least, np.partition(product, len(of) - k, axis=0)[len(of) - k] - ROUNDING)
            row, query = np.nonzero(product >= least)
            score = np.zeros(len(row))
            for x, y in zip(v[of].T, q[some].T):
                score += x[row] * y[query]
            # Rows are in the order of ids.
            order = np.lexsort((row, -score, query))
            row, query, score = row[order], query[order], score[order]
            kept = (np.arange(len(query)) - np.searchsorted(query, query) < k) & (score >= bar[some][query])
            yield pd.DataFrame({"n_query": number[some][query[kept]], "id": ids[of][row[kept]], "score": score[kept]})


def _scored(index: CellIndex, asked: DataFrame, wanted: DataFrame, k: int, blocks: int) -> DataFrame:
    """n_query, id, score (cosine): of each wanted cell's parts the k best rows in the wanted rings; ``wanted`` may have a ``bar``.

    A task gets one part of a cell and one block of queries.
    """
    bar = F.first("bar") if "bar" in wanted.columns else F.lit(None).cast("double")
    cell = wanted.groupBy("n_query", "cell", "parts").agg(F.collect_list("ring").alias("rings"), bar.alias("bar"))
    ask = cell.join(asked.select("n_query", "q"), "n_query").withColumn("block", F.pmod("n_query", F.lit(blocks)).cast("int"))
    ask = ask.select("n_query", "q", "rings", "bar", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block")
    # At most one row per cell.
    rows = index.rows.join(F.broadcast(wanted.select("cell").distinct()), "cell", "left_semi")
    rows = rows.select("cell", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "ring", "id", "v")
    kind = rows.schema["id"].dataType.simpleString()

    def score(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = list(best_of_part(rows, asked, k)) if len(rows) and len(asked) else []
        return pd.concat(found) if found else pd.DataFrame({"n_query": [], "id": [], "score": []})

    key = ["cell", "part", "block"]
    return rows.groupBy(*key).cogroup(ask.groupBy(*key)).applyInPandas(score, f"n_query long, id {kind}, score double")


def nearest(index: CellIndex, queries: DataFrame, k: int, rescale: bool = True, num_candidates: int | None = None) -> Found:
    """The k best rows by cosine for each (query_id, vector), ties by id; query ids are distinct.

    Exact by default: the nearest rings that hold k rows give a bar, and of the
    others those are read that can hold a row at or above it.  With
    ``num_candidates`` only the nearest rings that hold as many rows are read,
    and hits may be missed.  ``rescale``: scores as (1 + cosine) / 2.  A query
    without a direction finds nothing.
    """
    asked = _directed(queries.select("query_id", doubles(F.col("vector")).alias("vector")), index.dims)
    asked = stored(asked.select(F.monotonically_increasing_id().alias("n_query"), "query_id", unit(F.col("vector")).alias("q")), "asked")
    blocks = asked.count() // QUERIES + 1
    plan = stored(_plan(index, asked), "rings_met")
    first = plan.filter(F.col("before") < (num_candidates or k))
    hits, read = stored(top_k(_scored(index, asked, first, k, blocks), k, tie="id", per="n_query"), "first_hits"), first
    if num_candidates is None:
        bar = hits.filter(F.col("rank") == k).select("n_query", F.col("score").alias("bar"))
        late = plan.filter(F.col("before") >= k).join(bar, "n_query").filter(F.cos(F.greatest(F.lit(0.0), F.col("low"))) >= F.col("bar") - SLACK)
        late = stored(late, "late_rings")
        further = _scored(index, asked, late, k, blocks)
        hits = top_k(hits.drop("rank").unionByName(further), k, tie="id", per="n_query")
        read = first.unionByName(late.drop("bar"))
    names = asked.select("n_query", "query_id")
    hits = hits.join(names, "n_query").select("query_id", "id", ((1 + F.col("score")) / 2 if rescale else F.col("score")).alias("score"), "rank")
    everything = index.rings.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    work = read.groupBy("n_query").agg(F.sum("n").alias("rows_read")).join(names, "n_query")
    return Found(hits, work.select("query_id", everything.scalar().alias("rows"), "rows_read"))


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, recall: the share of the exact hits (query_id, id) that were found."""
    met = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return met.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
