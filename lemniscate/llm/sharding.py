"""Sharding by balanced label propagation (native: DataFrame functions only).

Documents with the same text are linked.  Every document starts in a shard
given by its hash; in each round, joins find for every linked document the
shard that most of its neighbours are in, as far as that shard can hold them,
and documents move there, those with the most to gain first.  What goes from
one shard to another is balanced by what comes back: documents that want to
go the other way, and, where these are too few, whole groups that stand
together and lose nothing by moving.  Rounds go on until no document wants to
move or several in a row have brought nothing.  Documents without a link gain
nothing anywhere, so they fill what is left: at the end every shard holds its
exact quota of rows, counts at most one apart, and a linked document leaves its
shard only where linked documents alone exceed the quota.

The law is ``rows``.  A group of copies larger than a quota is spread over as
few shards as the quotas allow for.  Ranks within shards come from counts by
hash bucket, so no shard is ranked in one task.

Cases: a null text counts as empty (size 1); repeated rows and null ids are rows like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemniscate.llm.common import discard, join_counted, scratch, stored


@dataclass(frozen=True)
class ShardRules:
    shards: int = 8
    #: So many rounds in a row without a gain end the propagation.
    patience: int = 4
    #: Hash buckets by which ranks within a shard are counted: so many at least, more where one would hold more rows.
    buckets: int = 256
    bucket_rows: int = 250_000
    #: Gains are told apart by their power of two up to this.
    gains: int = 40


def _rows(docs: DataFrame, r: ShardRules) -> DataFrame:
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"),
    ).withColumn("deal", F.xxhash64("doc_id", "text_key", F.lit(7)))


def _ranked(df: DataFrame, by: list[str], total: int, r: ShardRules) -> DataFrame:
    """``df`` with ``place``: its rows' ranks from 0 within ``by``, counted in hash buckets."""
    buckets = max(r.buckets, total // r.bucket_rows + 1)
    df = df.withColumn("_bucket", F.pmod(F.col("deal"), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most groups x buckets rows.
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    on = [F.col(c) == F.col(f"_{c}") for c in by] + [F.col("_bucket") == F.col("_b")]
    within = Window.partitionBy(*by, "_bucket").orderBy("deal", "doc_id", "text_key", "size")
    ranked = df.withColumn("_rank", F.row_number().over(within)).join(starts, on)
    return ranked.withColumn("place", F.col("_before") + F.col("_rank") - 1).drop("_bucket", "_rank", "_b", "_before", *[f"_{c}" for c in by])


def _plan(wishes: dict[tuple[int, int, int], int], whole: dict[tuple[int, int], int], load: list[int], capacity: int) -> tuple[dict, dict]:
    """Which share of the documents moves, by (from, to, level of gain), and which of the whole groups, by (from, to, level of size).

    ``wishes``: documents that gain by moving, by (from, to, level of gain).
    ``whole``: documents of groups that stand together, by (shard, level of size).
    """
    n = len(load)
    pairs = [(s, t) for s in range(n) for t in range(n) if s != t]
    asked = {p: 0 for p in pairs}
    for (s, t, _), k in wishes.items():
        asked[s, t] += k
    # Exchanged between two shards, each with the other.
    go = {(s, t): min(asked[s, t], asked[t, s]) for s, t in pairs}
    room = [capacity - x for x in load]
    rest = {p: asked[p] - go[p] for p in pairs}
    # By the most that one document can gain there: hot groups before small ones.
    best = {p: max((level for s, t, level in wishes if (s, t) == p), default=0) for p in pairs}
    left = dict(whole)
    back = {p: {} for p in pairs}

    def whole_groups(s: int, t: int, most: int) -> int:
        """Whole groups of ``most`` documents in all go from s to t, small ones first, none larger than what is to move."""
        given = 0
        for level in sorted(k for x, k in left if x == s):
            take = min(left[s, level], most - given)
            if take >= 1 << level:
                left[s, level] -= take
                back[s, t][level] = back[s, t].get(level, 0) + take
                given += take
        return given

    # Shards that hold too much give whole groups to those that have room.
    for s, t in pairs:
        if room[s] < 0 < room[t]:
            given = whole_groups(s, t, min(-room[s], room[t]))
            room[s] += given
            room[t] -= given
    for s, t in sorted(pairs, key=lambda p: (-best[p], -rest[p], p)):
        free = min(rest[s, t], max(0, room[t]))
        swapped = whole_groups(t, s, rest[s, t] - free)
        room[t] -= free
        room[s] += free
        go[s, t] += free + swapped
    shares = {}
    for s, t in pairs:
        for level in sorted((k for x, y, k in wishes if (x, y) == (s, t)), reverse=True):
            take = min(go[s, t], wishes[s, t, level])
            if take:
                shares[s, t, level] = take / wishes[s, t, level]
                go[s, t] -= take
    groups = {(s, t, level): k / whole[s, level] for (s, t), x in back.items() for level, k in x.items()}
    return shares, groups


def _drawn(shares: dict[tuple[int, int, int], float], level: Column, luck: Column, r: ShardRules) -> Column:
    """The shard that a document goes to by ``shares``, if ``luck`` (0 to 1) has it so; null if it stays."""
    out = F.lit(None).cast("int")
    for s in range(r.shards):
        for k in sorted({x[2] for x in shares if x[0] == s}):
            edge, inside = 0.0, F.lit(None).cast("int")
            for (_, t, _), share in sorted(x for x in shares.items() if x[0][0] == s and x[0][2] == k):
                inside = F.when((luck >= edge) & (luck < edge + share), t).otherwise(inside)
                edge += share
            out = F.when((F.col("shard") == s) & (level == k), inside).otherwise(out)
    return out


def _propagate(linked: DataFrame, total: int, capacity: int, r: ShardRules) -> DataFrame:
    """``linked`` (…, text_key, deal, shard) after the rounds; linked rows of a shard come to ``capacity`` or near it."""
    least, idle, step = None, 0, 0
    levels = r.gains + 1
    while True:
        counts = [F.count_if(F.col("shard") == s).alias(f"_{s}") for s in range(r.shards)]
        groups = linked.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"), *counts)
        # Ties are dealt anew in every round, so that what finds no room one way is asked for the other way.
        there = F.array(*[F.struct(F.col(f"_{s}").alias("n"), F.xxhash64("text_key", F.lit(s), F.lit(step)).alias("tie"), F.lit(s).alias("shard")) for s in range(r.shards)])
        groups = groups.select(F.col("text_key").alias("_key"), "n", there.alias("there"))
        # A shard that a group fills is done with: its other documents gather in the next fullest.
        most, own = F.array_max(F.filter("there", lambda x: x["n"] < capacity)), F.get("there", F.col("shard"))
        stays = (own["n"] >= capacity) | most.isNull()
        moves = (
            # Every group's counts by shard; the fullest shard is where its members want to be, ties are dealt by hash.
            join_counted(linked, groups, "text_key", "_key", "n", total, "inner")
            .withColumn("to", F.when(stays, F.col("shard")).otherwise(most["shard"]))
            .withColumn("level", F.when(stays, 0).otherwise(F.floor(F.log2((most["n"] - own["n"] + 1).cast("double")))).cast("int"))
            # Of a group that stands together: the power of two that its size reaches.
            .withColumn("whole", F.when(own["n"] == F.col("n"), F.ceil(F.log2(F.col("n").cast("double")))).cast("int"))
            .drop("n", "there")
        )
        moves = stored(moves, "moves", total)
        # Who wants to go where: at most shards x shards x levels rows, whatever the corpus.
        seen = moves.groupBy("shard", "to", "level", "whole").count().collect()
        load = [sum(w["count"] for w in seen if w["shard"] == s) for s in range(r.shards)]
        wishes: dict[tuple[int, int, int], int] = {}
        whole: dict[tuple[int, int], int] = {}
        for w in seen:
            if w["to"] != w["shard"]:
                key = w["shard"], w["to"], min(w["level"], r.gains)
                wishes[key] = wishes.get(key, 0) + w["count"]
            elif w["whole"] is not None:
                whole[w["shard"], w["whole"]] = whole.get((w["shard"], w["whole"]), 0) + w["count"]
        open_wishes = sum(wishes.values()) + sum(max(0, x - capacity) for x in load)
        idle = 0 if least is None or open_wishes < least else idle + 1
        least = open_wishes if least is None else min(least, open_wishes)
        shares, groups_go = _plan(wishes, whole, load, capacity)
        if not (shares or groups_go) or idle > r.patience:
            discard(moves)
            return linked
        share = F.create_map(*[F.lit(x) for (s, t, k), v in shares.items() for x in ((s * r.shards + t) * levels + k, float(v))]) if shares else None
        key = (F.col("shard") * r.shards + F.col("to")) * levels + F.least("level", F.lit(r.gains))
        luck = lambda c: F.pmod(F.xxhash64(c, F.lit(step)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        gains = (F.col("to") != F.col("shard")) & (luck("deal") < F.coalesce(share[key], F.lit(0.0))) if shares else F.lit(False)
        # A whole group has one luck, and goes or stays as one.
        together = _drawn(groups_go, F.col("whole"), luck("text_key"), r)
        new = F.when(F.col("to") != F.col("shard"), F.when(gains, F.col("to"))).otherwise(together)
        new = stored(moves.withColumn("shard", F.coalesce(new, F.col("shard")).cast("int")).drop("to", "level", "whole"), "labels", total)
        discard(linked)
        discard(moves)
        linked, step = new, step + 1


def shard(docs: DataFrame, rules: ShardRules = ShardRules()) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    with scratch():
        return stored(_sharded(docs, rules), "shards", lasting=True)


def _sharded(docs: DataFrame, r: ShardRules) -> DataFrame:
    columns = ["doc_id", "size", "text_crc32", "text_key", "deal", "shard"]
    rows = stored(_rows(docs, r), "rows")
    total = rows.count()
    copies = rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("text_key", "_key")
    marked = join_counted(rows, copies, "text_key", "_key", "n", total).withColumn("linked", F.col("n") > 1)
    marked = stored(marked.withColumn("shard", F.pmod(F.shiftright(F.col("deal"), 20), F.lit(r.shards)).cast("int")).select(*columns, "linked"), "marked", total)
    quota = [total // r.shards + (s < total % r.shards) for s in range(r.shards)]
    linked = _propagate(stored(marked.filter("linked").select(*columns), "labels", total), total, min(quota), r)
    # Linked rows come first in every shard, so that those without a link give way.
    placed = linked.withColumn("single", F.lit(0)).unionByName(marked.filter("NOT linked").select(*columns).withColumn("single", F.lit(1)))
    placed = stored(_ranked(placed, ["shard", "single"], total, r), "placed", total)
    n = {(s, one): 0 for s in range(r.shards) for one in (0, 1)}
    n |= {(x["shard"], x["single"]): x["count"] for x in placed.groupBy("shard", "single").count().collect()}
    load = [n[s, 0] + n[s, 1] for s in range(r.shards)]
    quotas, firsts = F.array(*[F.lit(x) for x in quota]), F.array(*[F.lit(n[s, 0]) for s in range(r.shards)])
    slot = F.col("place") + F.col("single") * F.get(firsts, F.col("shard"))
    placed = placed.withColumn("slot", slot.cast("long")).withColumn("over", F.col("slot") - F.get(quotas, F.col("shard")))
    # The k-th row beyond a quota takes the k-th free slot; both are counted shard by shard.
    beyond = [max(0, load[s] - quota[s]) for s in range(r.shards)]
    free = [max(0, quota[s] - load[s]) for s in range(r.shards)]
    order = F.col("over") + F.get(F.array(*[F.lit(sum(beyond[:s])) for s in range(r.shards)]), F.col("shard"))
    to, at = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in reversed(range(r.shards)):
        if free[s]:
            inside = order < sum(free[: s + 1])
            to = F.when(inside, s).otherwise(to)
            at = F.when(inside, order - sum(free[:s]) + load[s]).otherwise(at)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(F.col("over") >= 0, to).otherwise(F.col("shard")).alias("shard"),
        F.when(F.col("over") >= 0, at).otherwise(F.col("slot")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def cut_links(sharded: DataFrame, group: Column) -> DataFrame:
    """Groups of equal ``group`` and the shards beyond the first that they reach: what the propagation keeps small."""
    return sharded.groupBy(group.alias("g")).agg((F.count_distinct("shard") - 1).alias("cuts"), F.count(F.lit(1)).alias("n"))
