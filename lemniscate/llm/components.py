"""Connected components of a link table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemniscate.llm.common import discard, join_counted, stored


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(links: DataFrame, nodes: int, max_rounds: int = 60) -> DataFrame:
    """``links`` (u, v: long) to one row per linked node: ``node``, ``root`` (the smallest node it reaches).

    ``nodes``: how many nodes there are at most; sizes the files.  Each round
    replaces links by links to smaller nodes; it ends when nothing
    changes.  Centres of large stars are broadcast, the other ones joined by
    shuffle, so no star ends up in one task.  Every round is written to the
    shared folder, so lineage stays short.  Self-links and repeated links do no harm; nulls must not occur.
    """
    now = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links", nodes)
    before = _state(now)
    for _ in range(max_rounds):
        # Large star: every neighbour above the node is linked to the node's smallest neighbour.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).filter("n > 0")
        least = stored(least.select(F.col("u").alias("_u"), F.least("u", "m").alias("m"), "n"), "centres", nodes)
        above = join_counted(both.filter("v > u"), least, "u", "_u", "n", before[0])
        large = stored(above.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", before[0])
        # Small star: every neighbour below the node, and the node, are linked to the smallest.
        low = stored(large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "centres", nodes)
        small = (
            join_counted(large, low, "u", "_u", "n", before[0])
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .filter("u <> v")
            .distinct()
        )
        new = stored(small, "links", before[0])
        for x in (now, least, large, low):
            discard(x)
        now, state = new, _state(new)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
