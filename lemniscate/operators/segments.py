"""A search index of immutable segments that follows inserts, updates and deletes, and its pruned search.

A segment is written once: documents (doc_id, dl, hash, block), postings and,
for every term of every block of documents, how many postings it has there and
their impact frontier (the pairs of term frequency and length that no other
pair beats, so that the largest score in the block is known for any average
length).  Documents of similar words lie in one block.

Changes add segments and graves.  A grave (doc_id, before) buries the rows of a
document in all segments numbered below ``before``; what the buried postings
take from document frequencies is written with it.  So nothing is rewritten
until ``merge`` puts all living postings into one segment.

A version of the index is a small manifest that names segments and graves, the
number of living documents and words, and the source's fingerprint.  It becomes
visible when Spark's writer has finished it, so a change that fails half way
leaves the version before it as it was; older versions can be read until
``vacuum``.  One writer at a time: the second one to write a version fails.

Cases: rows without an id are left out; of rows that repeat an id in one change
the greatest text counts; a null text is empty; deleting unknown ids does
nothing; an empty change makes a new version with the same content; other
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemniscate.functions.text import tokens
from lemniscate.operators import search
from lemniscate.operators.ranking import numbered
from lemniscate.session import discard, stored

#: Documents in a block.
BLOCK = 128
#: Postings whose frontiers are worked out at a time, at least.
GATHERED = 200_000
DOCS = "doc_id long, dl int, hash long, block long, segment int"
POSTINGS = "term string, doc_id long, tf int, positions array<int>, dl int, block long, segment int"
BLOCKS = "term string, segment int, block long, n long, frontier array<struct<tf:int,dl:int>>"
GRAVES = "doc_id long, before int"
TAKEN = "term string, n long"


def fingerprint(spark: SparkSession, path: str) -> str:
    """The files of a table with their sizes and times of change."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return ";".join(sorted(found))


def _in_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` sorted by their words' smallest hashes (_k0, _k1), with ``block``: equal numbers of neighbours."""
    dealt = docs.repartitionByRange("_k0", "_k1", "doc_id").sortWithinPartitions("_k0", "_k1", "doc_id")
    return dealt.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK))


def _terms(batches: Iterator[Any]) -> Iterator[Any]:
    """doc_id, dl, block and words to postings: words of a document are sorted in place, so nothing is shuffled."""
    import pyarrow as pa

    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            b = batch.slice(k, 512)
            words = b.column(3).flatten().dictionary_encode()
            sizes = b.column(1).to_numpy().astype(np.int64)
            if not len(words):
                continue
            doc = np.repeat(np.arange(b.num_rows), sizes)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            code = words.indices.to_numpy().astype(np.int64)
            order = np.argsort(doc * len(words.dictionary) + code, kind="stable")
            doc, code, place = doc[order], code[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])]))
            bounds_ = np.concatenate([first, [len(doc)]]).astype(np.int32)
            owner = pa.array(doc[first])
            columns = [words.dictionary.take(pa.array(code[first])), b.column(0).take(owner), pa.array(np.diff(bounds_)), pa.ListArray.from_arrays(pa.array(bounds_), pa.array(place.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*columns, b.column(1).take(owner), b.column(2).take(owner)], names=["term", "doc_id", "tf", "positions", "dl", "block"])


def _frontiers(batches: Iterator[Any]) -> Iterator[Any]:
    """term, block, tf and dl of postings to term, block, n and frontier.

    A block's postings lie side by side, so that it has one row for a term; one
    that two tasks read has a row from each, which only loosens its bound.
    """
    import pyarrow as pa

    def made(rows: Any) -> Any:
        words = rows.column("term").combine_chunks().dictionary_encode()
        places, at = np.unique(rows.column("block").to_numpy(), return_inverse=True)
        key = at * len(words.dictionary) + words.indices.to_numpy()
        tf, dl = (rows.column(c).to_numpy().astype(np.int64) for c in ("tf", "dl"))
        order = np.lexsort((dl, -tf, key))
        key, tf, dl = key[order], tf[order], dl[order]
        opens = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(opens)
        # From the most frequent: a pair stays if it is shorter than all before it; each group starts below the last.
        low = dl - (np.cumsum(opens) - 1) * (dl.max() + 1)
        kept = np.concatenate([[True], low[1:] < np.minimum.accumulate(low)[:-1]])
        ends = np.concatenate([[0], np.cumsum(np.add.reduceat(kept.astype(np.int32), first))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(x[kept].astype(np.int32)) for x in (tf, dl)], names=["tf", "dl"])
        columns = [words.dictionary.take(pa.array(key[first] % len(words.dictionary))), pa.array(places[key[first] // len(words.dictionary)])]
        n = np.diff(np.concatenate([first, [len(key)]]))
        return pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pairs)], names=["term", "block", "n", "frontier"])

    held: list[Any] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            rows = pa.Table.from_batches(held)
            block = rows.column("block").to_numpy()
            other = np.flatnonzero(block != block[-1])
            if len(other):
                yield made(rows.slice(0, other[-1] + 1))
                held = rows.slice(other[-1] + 1).to_batches()
    if held:
        yield made(pa.Table.from_batches(held))


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    segments: list[int] = field(default_factory=list)
    graves: list[int] = field(default_factory=list)
    #: Living documents and their words.
    n: int = 0
    words: int = 0
    source: str = ""


class SegmentedIndex:
    """An index under ``path`` (any file system Spark writes to); ``analyser`` must be the one it was made with."""

    def __init__(self, spark: SparkSession, path: str, analyser: search.Analyser = tokens, version: int | None = None) -> None:
        self.spark, self.path, self.analyser = spark, path.rstrip("/"), analyser
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"there is no version {version}")
        self.manifest = self._manifest(version or max(known)) if known else Manifest()

    # Reading

    def _fs(self, path: str) -> tuple[object, object]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []

    def versions(self) -> list[int]:
        """Versions whose manifest is complete."""
        return sorted(int(x) for x in self._names(f"{self.path}/versions") if "_SUCCESS" in self._names(f"{self.path}/versions/{x}"))

    def _manifest(self, version: int) -> Manifest:
        (row,) = self.spark.read.text(f"{self.path}/versions/{version:010d}").collect()
        return Manifest(**json.loads(row[0]))

    def _read(self, kind: str, numbers: list[int], schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{n:010d}" for n in numbers]
        if paths:
            return self.spark.read.schema(schema).parquet(*paths)
        return self.spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("x")).select("x.*")

    def _living(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, segment, …) that no grave buries."""
        if not self.manifest.graves:
            return rows
        graves = self._read("graves", self.manifest.graves, GRAVES).groupBy(F.col("doc_id").alias("_id")).agg(F.max("before").alias("_before"))
        return rows.join(graves, (F.col("doc_id") == F.col("_id")) & (F.col("segment") < F.col("_before")), "left_anti")

    def docs(self) -> DataFrame:
        return self._living(self._read("docs", self.manifest.segments, DOCS))

    def postings(self) -> DataFrame:
        return self._living(self._read("postings", self.manifest.segments, POSTINGS))

    def blocks(self) -> DataFrame:
        """Term, segment, block, number of postings and frontier; buried postings included, which only loosens bounds."""
        return self._read("blocks", self.manifest.segments, BLOCKS)

    def frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """term, df: in how many living documents a term is, from blocks and graves alone."""
        held, taken = self.blocks().select("term", "n"), self._read("taken", self.manifest.graves, TAKEN).select("term", (-F.col("n")).alias("n"))
        both = held.unionByName(taken)
        both = both if terms is None else both.join(terms, "term", "left_semi")
        return both.groupBy("term").agg(F.sum("n").cast("int").alias("df")).filter("df > 0")

    @property
    def avgdl(self) -> float | None:
        return self.manifest.words / self.manifest.n if self.manifest.n else None

    def index(self) -> search.Index:
        """What the searches of :mod:`search` take."""
        rows = self.postings().select("term", "doc_id", "tf", "positions", "dl")
        return search.Index(rows, self.manifest.n, self.avgdl, self.analyser, self.frequencies())

    # Writing

    def _write(self, df: DataFrame, kind: str, number: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{kind}/{number:010d}")

    def _commit(self, new: Manifest) -> None:
        line = self.spark.createDataFrame([(json.dumps(asdict(new)),)], "value string")
        line.coalesce(1).write.mode("errorifexists").text(f"{self.path}/versions/{new.version:010d}")
        self.manifest = new

    def _segment(self, number: int, docs: DataFrame, rows: DataFrame) -> None:
        """Write a segment of ``docs`` (doc_id, dl, hash, block) and ``rows`` (term, doc_id, tf, positions, dl, block), blocks side by side."""
        self._write(docs.select("doc_id", "dl", "hash", "block", F.lit(number).alias("segment")), "docs", number)
        self._write(rows.select("term", "doc_id", F.col("tf").cast("int").alias("tf"), "positions", "dl", "block", F.lit(number).alias("segment")), "postings", number)
        written = self._read("postings", [number], POSTINGS).select("term", "block", "tf", "dl")
        made = written.mapInArrow(_frontiers, "term string, block long, n long, frontier array<struct<tf:int,dl:int>>")
        self._write(made.select("term", F.lit(number).alias("segment"), "block", "n", "frontier"), "blocks", number)

    def _bury(self, number: int, ids: DataFrame) -> tuple[int, int]:
        """Bury the living rows of ``ids`` (doc_id, distinct) in the segments below ``number``: how many documents and words that were."""
        dead = stored(self.docs().join(ids, "doc_id", "left_semi").select("doc_id", "dl"), "dead")
        n, words = dead.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if n:
            taken = self.postings().join(dead, "doc_id", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
            self._write(taken, "taken", number)
            self._write(dead.select("doc_id", F.lit(number).alias("before")), "graves", number)
        discard(dead)
        return n, words

    def _analysed(self, docs: DataFrame) -> DataFrame:
        """doc_id, words, dl, hash and block of one row for each id, documents of similar words side by side."""
        given = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        if not given.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            given = given.groupBy("doc_id").agg(F.max("text").alias("text"))
        made = given.select("doc_id", self.analyser(F.col("text")).alias("words"), F.xxhash64("text").alias("hash")).withColumn("dl", F.size("words"))
        alike = [F.array_min(F.transform("words", lambda w, k=k: F.xxhash64(w, F.lit(k)))).alias(f"_k{k}") for k in range(2)]
        return _in_blocks(made.select("*", *alike)).drop("_k0", "_k1")

    def _changed(self, docs: DataFrame | None, gone: DataFrame | None, source: str | None) -> SegmentedIndex:
        m = self.manifest
        number = m.version + 1
        n_new = words_new = 0
        ids = gone
        analysed = None
        if docs is not None:
            analysed = stored(self._analysed(docs), "analysed")
            n_new, words_new = analysed.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            ids = analysed.select("doc_id") if gone is None else gone.select("doc_id").unionByName(analysed.select("doc_id")).distinct()
        n_dead, words_dead = self._bury(number, ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()) if m.n and ids is not None else (0, 0)
        if n_new:
            rows = analysed.select("doc_id", "dl", "block", "words").mapInArrow(_terms, "term string, doc_id long, tf int, positions array<int>, dl int, block long")
            self._segment(number, analysed, rows)
        if analysed is not None:
            discard(analysed)
        self._commit(
            Manifest(
                number,
                [*m.segments, *([number] if n_new else [])],
                [*m.graves, *([number] if n_dead else [])],
                m.n + n_new - n_dead,
                m.words + words_new - words_dead,
                m.source if source is None else source,
            )
        )
        return self

    def put(self, docs: DataFrame, source: str | None = None) -> SegmentedIndex:
        """Insert documents (doc_id, text), in place of those with the same ids."""
        return self._changed(docs, None, source)

    def delete(self, ids: DataFrame) -> SegmentedIndex:
        """Delete documents by ``doc_id``."""
        return self._changed(None, ids, None)

    def sync(self, docs: DataFrame, source: str = "") -> SegmentedIndex:
        """Bring the index to exactly these documents (doc_id, text): only new, changed and missing ones are worked on."""
        now = docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
        old = self.docs().select("doc_id", "hash")
        fresh = now.join(old.withColumnRenamed("hash", "_hash"), "doc_id", "left").filter(~F.col("_hash").eqNullSafe(F.xxhash64("text"))).select("doc_id", "text")
        return self._changed(fresh, old.join(now, "doc_id", "left_anti").select("doc_id"), source)

    def merge(self) -> SegmentedIndex:
        """All living postings in one segment, without graves."""
        m = self.manifest
        number = m.version + 1
        if m.n:
            rows = self.postings().select("term", "doc_id", "tf", "positions", "dl")
            least = rows.groupBy("doc_id").agg(*[F.min(F.xxhash64("term", F.lit(k))).alias(f"_k{k}") for k in range(2)])
            docs = stored(_in_blocks(self.docs().select("doc_id", "dl", "hash").join(least, "doc_id", "left")), "docs")
            placed = rows.join(docs.select("doc_id", "block"), "doc_id").repartition("block").sortWithinPartitions("block", "doc_id", "term")
            self._segment(number, docs, placed)
            discard(docs)
        self._commit(replace(m, version=number, segments=[number] if m.n else [], graves=[]))
        return self

    def vacuum(self) -> SegmentedIndex:
        """Delete versions before this one and what only they read."""
        kept = {"versions": {self.manifest.version}, "graves": {*self.manifest.graves}, "taken": {*self.manifest.graves}}
        for kind in ("versions", "docs", "postings", "blocks", "graves", "taken"):
            for name in self._names(f"{self.path}/{kind}"):
                if int(name) not in kept.get(kind, {*self.manifest.segments}):
                    fs, where = self._fs(f"{self.path}/{kind}/{name}")
                    fs.delete(where, True)
        return self


# Search

#: Blocks of a query that are scored first, for a bar that the others have to reach.
FIRST = 12
#: Scores that lie closer than this are told apart later, so both are scored.
SLACK = 1e-6
PLACE = ["query_id", "segment", "block"]


#: Rows of asked terms, bytes of their words, and longs that say for which queries a block is read, up to which they are broadcast.
ASKED, WORDS, MARKS = 100_000, 8_000_000, 2_000_000
WIDTH = 64


def _hinted(asked: DataFrame) -> tuple[DataFrame, bool]:
    """``asked``, a stored table with a term, to be broadcast if it is proven small; and whether it is."""
    rows, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    small = rows <= ASKED and size <= WORDS
    return (F.broadcast(asked) if small else asked), small


def weights(index: SegmentedIndex, queries: DataFrame) -> DataFrame:
    """query_id, q, term, weight: number in the query times inverse document frequency; ``q`` numbers the queries from 0."""
    terms = stored(search.query_terms(queries, index.analyser), "terms")
    hinted, _ = _hinted(terms)
    asked = stored(hinted.join(index.frequencies(hinted), "term"), "frequencies")
    q = numbered(asked.select("query_id").distinct(), ["query_id"], name="q")
    weight = F.col("qtf") * search.idf(F.lit(index.manifest.n), F.col("df"))
    out = stored(asked.join(q, "query_id").select("query_id", F.col("q").cast("int").alias("q"), "term", weight.alias("weight")), "asked")
    discard(terms)
    discard(asked)
    return out


def term_bounds(index: SegmentedIndex, asked: DataFrame) -> DataFrame:
    """query_id, term, segment, block, bound: what the term can add in the block to a score at most, for ``asked``, a stored table."""
    most = F.array_max(F.transform("frontier", lambda x: search.saturated(x["tf"], x["dl"], F.lit(index.avgdl))))
    hinted, _ = _hinted(asked)
    met = index.blocks().join(hinted.select("query_id", "term", "weight"), "term")
    return met.select("query_id", "term", "segment", "block", (F.col("weight") * most).alias("bound"))


def bounds(index: SegmentedIndex, asked: DataFrame) -> DataFrame:
    """query_id, segment, block, bound: what a document of the block can score at most."""
    return term_bounds(index, asked).groupBy(*PLACE).agg(F.sum("bound").alias("bound"))


def _parts(index: SegmentedIndex, asked: DataFrame, where: DataFrame) -> DataFrame:
    """query_id, segment, block, doc_id, score: what the terms ``asked`` (query_id, q, term, weight) add in the blocks
    ``where`` (query_id, q, segment, block); both are stored tables.

    Where both are small, postings stay where they are: blocks come with a bit
    for each query that reads them, and what a document's terms add is summed
    up before it is shuffled, for its postings lie together.  Otherwise
    postings meet the terms that are read of their block.
    """
    rows = index.postings().select("term", "segment", "block", "doc_id", search.saturated(F.col("tf"), F.col("dl"), F.lit(index.avgdl)).alias("part"))
    hinted, small = _hinted(asked)
    blocks, last = where.agg(F.count_distinct("segment", "block"), F.coalesce(F.max("q"), F.lit(0))).first()
    longs = last // WIDTH + 1
    if small and blocks * longs <= MARKS:
        bits = [F.coalesce(F.bit_or(F.when(F.floor(F.col("q") / WIDTH) == n, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("q") % WIDTH))), F.lit(0).cast("long")) for n in range(longs)]
        marks = where.groupBy("segment", "block").agg(F.array(*bits).alias("bits"))
        met = rows.join(F.broadcast(marks), ["segment", "block"]).join(hinted, "term")
        bit = F.call_function("shiftright", F.get("bits", F.floor(F.col("q") / WIDTH).cast("int")), F.col("q") % WIDTH).bitwiseAND(F.lit(1).cast("long"))
        met = met.filter(bit == 1)
    else:
        read = index.blocks().select("term", "segment", "block").join(asked, "term").join(where.select(*PLACE), PLACE, "left_semi")
        met = rows.join(read, ["term", "segment", "block"])
    return met.groupBy(*PLACE, "doc_id").agg(F.sum(F.col("weight") * F.col("part")).alias("score"))


def scored(index: SegmentedIndex, asked: DataFrame, where: DataFrame) -> DataFrame:
    """query_id, doc_id, score of the living documents in the blocks ``where`` (query_id, segment, block)."""
    numbers = asked.select("query_id", "q").distinct()
    return _parts(index, asked, where.select(*PLACE).join(numbers, "query_id")).select("query_id", "doc_id", "score")


@dataclass(frozen=True)
class Best:
    #: query_id, doc_id, score of all documents that can be among the k best, and of some others.
    scored: DataFrame
    #: query_id, blocks (that hold a term of the query), read (of which postings were read), documents (that were scored).
    work: DataFrame


def best(index: SegmentedIndex, queries: DataFrame, k: int) -> Best:
    """The k best documents of every query are among ``scored``, with their exact scores; ties at the end are all there.

    The blocks with the highest bounds are scored first; the k-th score found
    there is the bar.  Blocks whose bound stays below it are not read.  Of the
    others, the query's weakest terms, which together stay below the bar, are
    left until last: a document without one of the stronger terms can't reach
    it, and of the others only those are scored in full whose stronger terms
    and the block's bound for the weak ones do.
    """
    if not index.manifest.n:
        none = queries.select("query_id").limit(0)
        return Best(none.selectExpr("query_id", "0L doc_id", "0D score"), none.selectExpr("query_id", "0L blocks", "0L read", "0L documents"))
    asked = weights(index, queries)
    q = asked.select("query_id", "q").distinct()
    whole = stored(bounds(index, asked).join(q, "query_id"), "bounds")
    order = search.top_k(whole.withColumn("place", F.struct("segment", "block")), FIRST, by="bound", tie="place", per="query_id")
    first = stored(order.select(*PLACE, "q"), "first")
    seen = stored(_parts(index, asked, first).select("query_id", "doc_id", "score"), "seen")
    kth = search.top_k(seen, k, per="query_id").filter(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("bar"))
    bars = stored(q.join(kth, "query_id", "left").na.fill(0.0, ["bar"]).select("query_id", "bar"), "bars")
    rest = stored(whole.join(first, PLACE, "left_anti").join(bars, "query_id").filter("bound >= bar").select(*PLACE, "q", "bar"), "rest")
    # Terms from the weakest; a query has as many rows as terms.
    upwards = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    strength = term_bounds(index, asked).groupBy("query_id", "term").agg(F.max("bound").alias("most")).withColumn("sum", F.sum("most").over(upwards))
    judged = asked.join(strength.join(bars, "query_id").select("query_id", "term", (F.col("sum") >= F.col("bar")).alias("strong")), ["query_id", "term"])
    judged = stored(judged, "judged")
    strong, weak = (stored(judged.filter(F.col("strong") == x).drop("strong"), "terms") for x in (True, False))
    partial = _parts(index, strong, rest)
    able = partial.join(rest, PLACE).join(bounds(index, weak).withColumnRenamed("bound", "weak"), PLACE, "left")
    able = able.filter(F.col("score") + F.coalesce("weak", F.lit(0.0)) >= F.col("bar"))
    able = stored(able.select(*PLACE, "q", "doc_id", "score"), "able")
    at = stored(able.select(*PLACE, "q").distinct(), "at")
    added = _parts(index, weak, at).withColumnRenamed("score", "more")
    late = able.join(added, [*PLACE, "doc_id"], "left").select("query_id", "doc_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    out = stored(seen.unionByName(late), "best")
    count = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    work = count(whole, "blocks").join(count(first.select("query_id").unionByName(rest.select("query_id")), "read"), "query_id").join(count(out, "documents"), "query_id", "left")
    work = stored(work.na.fill(0, ["documents"]), "work")
    for df in (asked, whole, first, seen, bars, rest, judged, strong, weak, able, at):
        discard(df)
    return Best(out, work)
