"""Skip-gram vectors of words as means of hashed n-gram buckets, trained with negative sampling.

A word is an array of ids.  Its n-grams, and the word itself, are hashed into a
fixed number of buckets, so the model has a fixed size, needs no vocabulary and
knows every word: one that training never met has the vectors of its n-grams.
Context words are hashed into buckets too, which two words may share.

Sentences are dealt into parts by their key, as many as their number asks for.
In a round each part runs through its sentences in order from the round's common parameters,
and the changes of every bucket are averaged over the parts that touched it.
Parts, their order and their random numbers depend on the data and the seed
alone, and changes are added as whole numbers, so a training run gives the same
vectors on any number of machines.  Parameters take buckets x dimensions
numbers, whatever the number of sentences; only they pass the driver.

Cases: words that are null or empty are left out; a sentence of one word trains
nothing; repeated rows are words that follow each other; an empty table leaves
the vectors that the seed gives; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from itertools import batched, groupby
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lemniscate.operators.formulas import grams, words_of
from lemniscate.session import discard, stored

#: Changes are added in units of this.
UNIT = 2.0**-40


@dataclass(frozen=True)
class SubwordRules:
    dims: int = 100
    buckets: int = 1 << 16
    contexts: int = 1 << 14
    window: int = 5
    negatives: int = 5
    rounds: int = 5
    rate: float = 0.05
    least: int = 3
    most: int = 6
    #: Sentences of a part, about.
    part: int = 50_000
    #: Sentences whose changes are made at once.
    batch: int = 32
    seed: int = 1


def buckets(word: Column, rules: SubwordRules) -> Column:
    """Numbers of a word's buckets: of its n-grams and of itself."""
    all_grams = F.concat(grams(word, rules.least, rules.most), F.array(F.array_join(word.cast("array<string>"), "-")))
    return F.transform(all_grams, lambda g: F.pmod(F.xxhash64(g), F.lit(rules.buckets)).cast("int"))


def sentences(words: DataFrame, key: str, rules: SubwordRules, parts: int) -> DataFrame:
    """part, at (order in the part), b (every word's buckets), c (every word's context bucket) of ``words`` (key, pos, word)."""
    known = words.filter(F.size("word") > 0)
    context = F.pmod(F.xxhash64(F.array_join(F.col("word").cast("array<string>"), "-")), F.lit(rules.contexts)).cast("int")
    made = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", buckets(F.col("word"), rules).alias("b"), context.alias("c")))).alias("w"))
    at = F.to_json(F.struct(key))
    return made.select(F.pmod(F.xxhash64(at), F.lit(parts)).cast("int").alias("part"), at.alias("at"), F.col("w.b").alias("b"), F.col("w.c").alias("c"))


def start(rules: SubwordRules) -> tuple[np.ndarray, np.ndarray]:
    """Parameters before training: small random numbers for words, zeros for contexts."""
    rng = np.random.default_rng(rules.seed)
    return rng.uniform(-1 / rules.dims, 1 / rules.dims, (rules.buckets, rules.dims)), np.zeros((rules.contexts, rules.dims))


def pairs_of(n: int, window: int, rng: np.random.Generator) -> list[tuple[int, int]]:
    """Centre and context places of a sentence of n words, each centre with a random reach up to the window."""
    reach = rng.integers(1, window + 1, n)
    return [(i, j) for i in range(n) for j in range(max(0, i - int(reach[i])), min(n, i + int(reach[i]) + 1)) if i != j]


def _summed(rows: np.ndarray, change: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``rows`` and the sums of ``change[at]`` by row."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[begin], np.add.reduceat(change[at[order]], begin, axis=0)


def step(w: np.ndarray, c: np.ndarray, centres: list[list[int]], owners: np.ndarray, targets: np.ndarray, rate: float) -> float:
    """One step on pairs at once: ``owners`` are the pairs' centres, in order, ``centres`` their words' buckets, ``targets`` a context and its negatives.  Returns the loss.

    A bucket that several pairs change moves by the mean of their changes.
    What a centre's pairs change is added up before it is dealt to its buckets.
    """
    sizes = np.array([len(x) for x in centres])
    flat = np.concatenate([np.asarray(x) for x in centres])
    h = (np.add.reduceat(w[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None])[owners]
    out = c[targets]
    score = 1 / (1 + np.exp(-np.clip(np.einsum("pd,pkd->pk", h, out), -30, 30)))
    label = np.zeros(targets.shape)
    label[:, 0] = 1
    g = label - score
    n = np.bincount(owners, minlength=len(centres))
    to_w = np.add.reduceat(np.einsum("pk,pkd->pd", g, out), np.cumsum(n) - n, axis=0)
    to_c = (g[:, :, None] * h[:, None, :]).reshape(-1, w.shape[1])
    for table, rows, change, at, times in (
        (w, flat, to_w, np.repeat(np.arange(len(centres)), sizes), np.repeat(n, sizes)),
        (c, targets.ravel(), to_c, np.arange(targets.size), np.ones(targets.size, int)),
    ):
        met, total = _summed(rows, change, at)
        table[met] += rate * total / np.bincount(rows, times)[met][:, None]
    return float(-np.log(np.where(label == 1, score, 1 - score) + 1e-12).sum())


def train_part(part: int, number: int, w: np.ndarray, c: np.ndarray, share: np.ndarray, listed: Iterable[tuple[list[list[int]], list[int]]], rules: SubwordRules) -> tuple[float, int]:
    """Change ``w`` and ``c`` by one run through a part's sentences; returns the summed loss and the number of pairs."""
    rng = np.random.default_rng([rules.seed, number, part])
    loss, n = 0.0, 0
    for some in batched(listed, rules.batch):
        centres, owners, found = [], [], []
        for b, ctx in some:
            last = None
            for i, j in pairs_of(len(b), rules.window, rng):
                if i != last:
                    centres.append(b[i])
                    last = i
                owners.append(len(centres) - 1)
                found.append(ctx[j])
        if not found:
            continue
        negatives = np.searchsorted(share, rng.random((len(found), rules.negatives)), side="right")
        targets = np.hstack([np.array(found)[:, None], np.minimum(negatives, len(share) - 1)])
        loss += step(w, c, centres, np.array(owners), targets, rules.rate)
        n += len(found)
    return loss, n


def _changes(part: int, loss: float, n: int, old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]) -> Iterator[Any]:
    """Rows of changed buckets (side: 0 words, 1 contexts), and one of loss and pairs (side 2)."""
    import pyarrow as pa

    def rows(side: int, numbers: np.ndarray, change: np.ndarray) -> Any:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(numbers) + 1, dtype=np.int32) * change.shape[1]), pa.array(change.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), side, np.int32)), pa.array(numbers.astype(np.int32)), lists], names=["side", "bucket", "change"])

    yield rows(2, np.zeros(1), np.array([[round(loss * 2**20), n]], np.int64))
    for side in (0, 1):
        met = np.flatnonzero((old[side] != new[side]).any(axis=1))
        for k in range(0, len(met), 4096):
            some = met[k : k + 4096]
            yield rows(side, some, np.rint((new[side][some] - old[side][some]) / UNIT).astype(np.int64))


def _round(given: Any, number: int, rules: SubwordRules):
    """Sentences, sorted by part and place, to the changes that each part makes; a part is read as a stream."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        w0, c0, share = given.value
        rows = (r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))))
        for part, own in groupby(rows, key=lambda r: r[0]):
            w, c = w0.copy(), c0.copy()
            loss, n = train_part(part, number, w, c, share, (r[1:] for r in own), rules)
            yield from _changes(part, loss, n, (w0, c0), (w, c))

    return run


def _added(batches: Iterator[Any]) -> Iterator[Any]:
    """Sums of changes by side and bucket, and of how many parts; whole numbers, so in any order."""
    import pyarrow as pa

    sums: dict[tuple[int, int], list[Any]] = {}
    for batch in batches:
        for k, (side, bucket) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            kept = sums.setdefault((side, bucket), [0, 0])
            kept[0] = kept[0] + batch.column(2)[k].values.to_numpy()
            kept[1] += 1
    keys = list(sums)
    columns = [pa.array([k[x] for k in keys], pa.int32()) for x in (0, 1)] + [pa.array([sums[k][0] for k in keys], pa.list_(pa.int64())), pa.array([sums[k][1] for k in keys], pa.int32())]
    yield pa.RecordBatch.from_arrays(columns, names=["side", "bucket", "change", "n"])


def _means(given: Any):
    """Keys with the buckets of their words to the means of the words' means."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        table = given.value
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(1)
            n, in_word = np.diff(words.offsets.to_numpy()), np.diff(words.flatten().offsets.to_numpy())
            flat = words.flatten().flatten().to_numpy()
            vectors, at = [], np.concatenate([[0], np.cumsum(in_word)])
            ends = np.concatenate([[0], np.cumsum(n)])
            for k in range(0, len(n), 1000):
                mine = in_word[ends[k] : ends[min(k + 1000, len(n))]]
                of = n[k : k + 1000]
                word = np.add.reduceat(table[flat[at[ends[k]] : at[ends[k] + len(mine)]]], np.cumsum(mine) - mine, axis=0) / mine[:, None]
                vectors.append(np.add.reduceat(word, np.cumsum(of) - of, axis=0) / of[:, None])
            made = np.concatenate(vectors)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[batch.schema.names[0], "vector"])

    return run


@dataclass
class SubwordModel:
    rules: SubwordRules
    #: bucket, vector
    table: DataFrame
    #: Mean loss of a pair in every round.
    losses: list[float]
    #: Ids of the symbols that words are made of (kind, symbol, id), and of which representation; None: words come as ids.
    dictionary: DataFrame | None = None
    kind: str | None = None

    def save(self, path: str) -> None:
        """A new version under ``path``; the highest complete one is the one that is loaded."""
        spark = self.table.sparkSession
        number = max(versions(spark, path), default=0) + 1
        self.table.write.parquet(f"{path}/{number:06d}/table")
        if self.dictionary is not None:
            self.dictionary.write.parquet(f"{path}/{number:06d}/dictionary")
        about = json.dumps({"rules": asdict(self.rules), "losses": self.losses, "kind": self.kind})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/{number:06d}/about")

    def vectors(self, words: DataFrame, key: str) -> DataFrame:
        """key, vector: the mean over a key's words of the means of their buckets, whether training met the words or not."""
        spark = words.sparkSession
        given = spark.sparkContext.broadcast(self._dense())
        # Sorted, so that sums come out the same every time.
        listed = words.filter(F.size("word") > 0).select(key, buckets(F.col("word"), self.rules).alias("b")).groupBy(key).agg(F.sort_array(F.collect_list("b")).alias("b"))
        schema = T.StructType([listed.schema[key], T.StructField("vector", T.ArrayType(T.DoubleType()))])
        return listed.mapInArrow(_means(given), schema)

    def _dense(self) -> np.ndarray:
        """The table as one array; a model has a fixed size."""
        rows = self.table.toArrow()
        out = np.zeros((self.rules.buckets, self.rules.dims))
        out[rows.column("bucket").to_numpy()] = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, self.rules.dims)
        return out

    def formula_vectors(self, given: DataFrame, key: str = "formula_id") -> DataFrame:
        """key, vector of formulas (key, formula), seen in training or not; symbols without an id get the next ones."""
        return self.vectors(words_of(given, self.kind, key, self.dictionary)[0], key)


def versions(spark: SparkSession, path: str) -> list[int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n) for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/about/_SUCCESS")))


def load(spark: SparkSession, path: str, version: int | None = None) -> SubwordModel:
    found = versions(spark, path)
    if not found or version is not None and version not in found:
        raise ValueError(f"no such model: {path}")
    at = f"{path}/{version or found[-1]:06d}"
    (row,) = spark.read.text(f"{at}/about").collect()
    about = json.loads(row[0])
    table = spark.read.schema("bucket int, vector array<double>").parquet(f"{at}/table")
    ids = spark.read.schema("kind string, symbol string, id int").parquet(f"{at}/dictionary") if about["kind"] else None
    return SubwordModel(SubwordRules(**about["rules"]), table, about["losses"], ids, about["kind"])


def train(words: DataFrame, key: str, rules: SubwordRules = SubwordRules()) -> SubwordModel:
    """A model of ``words`` (key, pos, word); the words of a key are a sentence."""
    import pyarrow as pa

    spark = words.sparkSession
    parts = words.select(key).distinct().count() // rules.part + 1
    given = stored(sentences(words, key, rules, parts), "sentences")
    # Counts of context buckets, of which there is a fixed number.
    counts = np.zeros(rules.contexts)
    for c, n in given.select(F.explode("c").alias("c")).groupBy("c").count().collect():
        counts[c] = n
    share = np.cumsum(counts**0.75) / max((counts**0.75).sum(), 1e-300)
    w, c = start(rules)
    losses = []
    for number in range(rules.rounds):
        shared = spark.sparkContext.broadcast((w, c, share))
        ordered = given.repartition(parts, "part").sortWithinPartitions("part", "at")
        changes = ordered.mapInArrow(_round(shared, number, rules), "side int, bucket int, change array<long>")
        # At most one row for each bucket.
        added = changes.repartition("side", "bucket").mapInArrow(_added, "side int, bucket int, change array<long>, n int").toArrow()
        w, c = w.copy(), c.copy()
        sides, numbers, n = (added.column(k).to_numpy() for k in ("side", "bucket", "n"))
        for side, table in ((0, w), (1, c)):
            at = np.flatnonzero(sides == side)
            change = added.column("change").take(at).combine_chunks().flatten().to_numpy().reshape(-1, rules.dims)
            table[numbers[at]] += change * UNIT / n[at][:, None]
        (loss, pairs) = added.column("change").take(np.flatnonzero(sides == 2)).to_pylist()[0] if (sides == 2).any() else (0, 0)
        losses.append(loss / 2**20 / max(1, pairs))
        shared.destroy()
    discard(given)
    table = pa.table({"bucket": pa.array(range(rules.buckets), pa.int32()), "vector": pa.array(list(w), pa.list_(pa.float64()))})
    return SubwordModel(rules, stored(spark.createDataFrame(table, "bucket int, vector array<double>"), "buckets"), losses)


def train_formulas(given: DataFrame, kind: str = "slt", key: str = "formula_id", rules: SubwordRules = SubwordRules()) -> SubwordModel:
    """A model over one representation of formulas (key, formula), with the dictionary that new formulas need."""
    words, ids = words_of(given, kind, key)
    ids = stored(ids, "dictionary")
    model = train(stored(words, "words"), key, rules)
    model.dictionary, model.kind = ids, kind
    return model
