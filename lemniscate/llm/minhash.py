"""MinHash near-dedup with SuperMinHash signatures.

A document's set are its distinct five-word shingles.  In a SuperMinHash
signature every element of a set runs through a random permutation of the
signature's components: at rank j it offers j and a random fraction to the
component that its permutation has there, and a component keeps the smallest
offer.  Ranks are correlated (an element never offers twice to one component),
which lowers the variance against independent minima.  Ranks are taken one by
one for the whole batch, and a document stops as soon as each of its components
has an offer, since all later ones are larger.

Equal sets are one node.  Signatures are cut into bands, and nodes that share a
band's value share a bucket; two sets whose Jaccard similarity is 0.85 miss each
other in all 30 bands of 5 with a probability of 2e-8.  Within a bucket nobody
makes all pairs: in each star round the members that the bucket's pivot isn't
connected with yet are compared with the pivot, and links found so far connect
members.  What is unconnected after the star rounds is compared pair by pair in
small buckets, and in blocks of bounded size in large ones, from each of which
only a spanning forest leaves the task.  So the number of rows grows with the
members, not with their pairs.  Every link is confirmed on the full sets.
Links go through union-find within a task and star joins across tasks.

Shingles are 64-bit hashes of five hashed words; node ids are 128-bit digests of
whole sets.  Texts of candidates are read again instead of storing all sets.

Cases: a null text, or one without words, has an empty set and is linked with
nothing (its component_id is its doc_id); a null doc_id takes part but is a
component's id only if the whole component has no other; repeated rows come
back as often as they are given, and are kept alike; rows that repeat a doc_id
with other texts are documents of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemniscate.llm.common import join_counted, scratch, stored
from lemniscate.llm.components import components

SEED = 42
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Shingles and documents whose signatures are worked out at once.
TILE = 1 << 18
DOCS = 2048
#: Hashed words that a task remembers before it forgets all; a matter of memory only.
WORDS = 500_000


@dataclass(frozen=True)
class MinHashRules:
    shingle: int = 5
    #: Least similarity of linked sets, in hundredths.
    percent: int = 85
    bands: int = 30
    rows: int = 5
    #: Star rounds before the rest of a bucket is compared pair by pair.
    stars: int = 3
    #: Members up to which the rest of a bucket is compared by a join.
    small: int = 16
    #: Shingles on one side of a block of a larger bucket.
    block: int = 1 << 20

    @property
    def size(self) -> int:
        return self.bands * self.rows


def mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit number for every one (splitmix64)."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingles(text: str | None, words: WordHashes, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        out = mix(out * GOLDEN ^ h[k : k + n])
    return np.unique(out)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (sets x m) of non-empty sets: rank in the upper, random fraction in the lower 32 bits."""
    x = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    best = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    flat = best.reshape(-1)
    swaps: list[np.ndarray] = []
    for rank in range(m):
        r = mix(x + np.uint64((2 * rank + 1) * int(GOLDEN) % (1 << 64)))
        to = rank + ((r >> np.uint64(32)) * np.uint64(m - rank) >> np.uint64(32)).astype(np.int16)
        # What stands at place `to` after the swaps of the earlier ranks (Fisher-Yates, followed backwards).
        at = to.copy()
        for earlier in range(rank - 1, -1, -1):
            np.copyto(at, np.int16(earlier), where=at == swaps[earlier])
        offer = np.uint64(rank << 32) | (r & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, doc * m + at, offer)
        open_docs = best.max(axis=1) == np.iinfo(np.uint64).max
        if not open_docs.any():
            break
        kept = open_docs[doc]
        x, doc, swaps = x[kept], doc[kept], [s[kept] for s in (*swaps, to)]
    return best


def band_keys(sig: np.ndarray, rules: MinHashRules) -> np.ndarray:
    """One 64-bit key per set and band."""
    parts = sig.reshape(len(sig), rules.bands, rules.rows)
    key = np.broadcast_to(np.arange(rules.bands, dtype=np.uint64), parts.shape[:2]) * GOLDEN
    for k in range(rules.rows):
        key = mix(key ^ parts[:, :, k])
    return key


def _digest(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes(), SEED)


def _lists(values: np.ndarray, lengths: np.ndarray) -> Any:
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _marked(rules: MinHashRules):
    """doc_id and text to doc_id, key (null: empty set), n_shingles and band keys."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        words = WordHashes()
        for batch in batches:
            start, held, n = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                held.append(shingles(text.as_py(), words, rules.shingle))
                n += len(held[-1])
                if i + 1 < batch.num_rows and n < TILE and len(held) < DOCS:
                    continue
                full = [s for s in held if len(s)]
                bands = band_keys(signatures(full, rules.size), rules) if full else np.zeros((0, rules.bands), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(held)),
                        pa.array([_digest(s) if len(s) else None for s in held], pa.binary()),
                        pa.array([len(s) for s in held], pa.int64()),
                        _lists(bands.ravel(), np.array([rules.bands if len(s) else 0 for s in held])),
                    ],
                    names=["doc_id", "key", "n_shingles", "bands"],
                )
                start, held, n = i + 1, [], 0

    return run


def _sets(rules: MinHashRules):
    """Texts to key and whole shingle set."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        words = WordHashes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                sets = [shingles(t.as_py(), words, rules.shingle) for t in batch.column(0).slice(k, 256)]
                values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), _lists(values, np.array([len(s) for s in sets]))], names=["key", "set"]
                )

    return run


def _forest(percent: int):
    """Links of a block's sets, as few as keep the same components, by counting shared shingles."""

    def run(batch: Any) -> Any:
        import pyarrow as pa

        nodes, start = np.unique(batch.column("node").to_numpy(), return_index=True)
        sets = batch.column("set").combine_chunks()
        sets = [sets[int(k)].values.to_numpy() for k in start]
        sizes = np.array([len(s) for s in sets])
        _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
        holder = np.repeat(np.arange(len(sets)), sizes)[np.argsort(shingle, kind="stable")]
        first = np.concatenate([[0], np.cumsum(np.bincount(shingle))])
        own = np.concatenate([[0], np.cumsum(sizes)])
        left = np.ones(len(sets), bool)
        us: list[np.ndarray] = []
        vs: list[np.ndarray] = []
        # Breadth first; each set is reached once.
        for begin in range(len(sets)):
            queue = [begin] if left[begin] else []
            left[begin] = False
            while queue and left.any():
                u = queue.pop()
                mine = shingle[own[u] : own[u + 1]]
                n = first[mine + 1] - first[mine]
                at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(holder[at], minlength=len(sets))
                near = np.flatnonzero(left & (100 * both >= percent * (sizes[u] + sizes - both)))
                left[near] = False
                us.append(np.full(len(near), nodes[u]))
                vs.append(nodes[near])
                queue.extend(near.tolist())
        none = [np.zeros(0, np.int64)]
        return pa.table({"u": pa.array(np.concatenate(us or none)), "v": pa.array(np.concatenate(vs or none))})

    return run


#: Pairs that one copy of a set meets at most, about; more copies of it are made.
PAIRS_PER_COPY = 5_000


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (u, v) whose whole ``sets`` (node, set) are similar enough.

    A node with many pairs, as u, has its set copied as often as its pairs need.
    """
    copies = pairs.count() // PAIRS_PER_COPY + 1
    salted = pairs.withColumn("copy", F.pmod(F.xxhash64("v"), F.lit(copies)))
    right = salted.join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    left = salted.select("u", "copy").distinct().join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u")
    both = F.size(F.array_intersect("a", "b"))
    return right.join(left, ["u", "copy"]).filter(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("u", "v")


def links(docs: DataFrame, nodes: DataFrame, total: int, rules: MinHashRules = MinHashRules()) -> DataFrame:
    """Links (u, v) among ``nodes`` (node, key, least, n_shingles, bands) that keep all components of similar sets."""
    buckets = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # A hot bucket has few keys to be joined with: those are broadcast.
    members = stored(
        join_counted(buckets, shared.withColumnRenamed("bucket", "_b"), "bucket", "_b", "n", total * rules.bands).withColumn("root", F.col("node")), "members"
    )
    wanted = stored(members.select("node").distinct().join(nodes.select("node", "least", "key"), "node"), "wanted", total)
    texts = docs.join(wanted.select(F.col("least").alias("_least")).distinct(), F.col("doc_id").eqNullSafe(F.col("_least")), "left_semi")
    made = texts.select("text").distinct().mapInArrow(_sets(rules), "key binary, set array<long>").dropDuplicates(["key"])
    sets = stored(made.join(wanted.select("node", "key"), "key").select("node", "set"), "sets")
    alike = lambda a, b: 100 * F.least(a, b) >= rules.percent * F.greatest(a, b)

    def star(among: DataFrame, salt: int) -> DataFrame:
        pick = F.struct((F.col("node") if salt == 0 else F.xxhash64("node", F.lit(salt))).alias("first"), F.col("node").alias("u"), F.col("root").alias("r"), F.col("n_shingles").alias("k"))
        pivots = among.groupBy(F.col("bucket").alias("_b")).agg(F.min(pick).alias("p"), F.count(F.lit(1)).alias("size"))
        met = join_counted(among.drop("n"), pivots.select("_b", "p.*", "size"), "bucket", "_b", "size", total * rules.bands)
        pairs = met.filter((F.col("root") != F.col("r")) & alike(F.col("n_shingles"), F.col("k"))).select("u", F.col("node").alias("v"))
        return stored(confirmed(stored(pairs.distinct(), "pairs", total), sets, rules.percent), "confirmed", total)

    def open_ones(among: DataFrame, found: DataFrame) -> DataFrame:
        """Members of buckets that the links found so far leave in several components."""
        roots = components(found, total)
        now = among.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        now = stored(now, "labelled")
        open_now = now.groupBy(F.col("bucket").alias("_b")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo < hi")
        return stored(join_counted(now, open_now.drop("lo", "hi"), "bucket", "_b", "size", total * rules.bands).drop("size"), "open")

    found = star(members, 0)
    rest = open_ones(members.filter("n > 2"), found)
    # Small buckets: all pairs of different components but those with the pivot.
    few = rest.filter(F.col("n") <= rules.small)
    few = few.join(few.groupBy("bucket").agg(F.min("node").alias("pivot")), "bucket").filter("node <> pivot")
    a, b = (few.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "n_shingles")]) for x in "ab")
    pairs = a.join(b, "bucket").filter((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & alike(F.col("n_shingles_a"), F.col("n_shingles_b")))
    pairs = stored(pairs.select(F.col("node_a").alias("u"), F.col("node_b").alias("v")).distinct(), "pairs", total)
    found = stored(found.unionByName(confirmed(pairs, sets, rules.percent)), "found", total)
    large = rest.filter(F.col("n") > rules.small)
    for salt in range(1, rules.stars):
        if large.isEmpty():
            return found
        found = stored(found.unionByName(star(large, salt)), "found", total)
        large = open_ones(large, found)
    if large.isEmpty():
        return found
    grid = large.groupBy(F.col("bucket").alias("_b")).agg((F.sum("n_shingles") / rules.block).cast("int").alias("last"), F.count(F.lit(1)).alias("size"))
    dealt = join_counted(large.select("bucket", "node"), grid, "bucket", "_b", "size", total * rules.bands)
    dealt = dealt.withColumn("x", F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int")).withColumn("z", F.explode(F.sequence(F.lit(0), F.col("last"))))
    cells = dealt.select("bucket", F.least("x", "z").alias("i"), F.greatest("x", "z").alias("j"), "node").join(sets, "node")
    return found.unionByName(cells.groupBy("bucket", "i", "j").applyInArrow(_forest(rules.percent), "u long, v long"))


def near_duplicates(docs: DataFrame, rules: MinHashRules = MinHashRules()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (it is the document itself)."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch():
        marked = stored(given.mapInArrow(_marked(rules), "doc_id long, key binary, n_shingles long, bands array<long>"), "marked")
        total = marked.count()
        one = marked.filter("key IS NOT NULL").groupBy("key")
        nodes = one.agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
        nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        roots = components(links(given, nodes, total, rules), total)
        linked = stored(nodes.select("node", "least").join(roots, "node"), "linked", total)
        smallest = stored(linked.groupBy(F.col("root").alias("_r")).agg(F.min("least").alias("linked_id"), F.count(F.lit(1)).alias("size")), "smallest", total)
        # One component may hold most sets, and one set most documents: such keys are broadcast.
        moved = join_counted(linked.select("node", "root"), smallest, "root", "_r", "size", total).select("node", "linked_id")
        ids = nodes.join(moved, "node", "left").select(F.col("key").alias("_k"), F.coalesce("linked_id", "least").alias("component_id"), "n")
        ids = stored(ids, "ids", total)
        rows = join_counted(marked.filter("key IS NOT NULL").select("doc_id", "n_shingles", "key"), ids, "key", "_k", "n", total).drop("key", "n")
        alone = marked.filter("key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        out = rows.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        return stored(out, "near-duplicates", lasting=True)
