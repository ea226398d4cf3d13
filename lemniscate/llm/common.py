"""Helpers that the corpus operators share: shared-folder tables and column packing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BETWEEN = r"[\x20\x09-\x0D]+"
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_own_folder: dict[str, str] = {}
_swept: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session that sets none gets its own."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_folder:
        _own_folder[key] = "file://" + tempfile.mkdtemp(prefix="lemniscate-")
        atexit.register(_remove_folder, _own_folder[key])
    return _own_folder[key]


def _remove_folder(url: str) -> None:
    import shutil

    shutil.rmtree(url.removeprefix("file://"), ignore_errors=True)


def _folder(spark: SparkSession) -> str:
    """This application's tables; they go when the driver's Python ends."""
    path = f"{shared_folder(spark)}/lemniscate/{spark.sparkContext.applicationId}"
    if path not in _swept:
        _swept.add(path)
        atexit.register(_sweep, spark._jvm, spark._jsc.hadoopConfiguration(), path)
    return path


def _sweep(jvm: object, conf: object, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


#: Rows of narrow tables that one file, and the task that writes it, may hold.
ROWS_PER_FILE = 250_000


#: Tables that end with the scratch scopes around, the innermost last.
_scopes: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """What is :func:`stored` inside is deleted at the end; tables stored as ``lasting`` end with the scope around this one."""
    made: list[DataFrame] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        for df in made:
            discard(df)


def stored(df: DataFrame, name: str, rows: int | None = None, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors.

    ``rows``: about how many narrow rows there are; small tables then go to
    few files, whatever the number of shuffle partitions.  ``lasting``: the
    table outlives the scratch scope it is made in.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(rows // ROWS_PER_FILE + 1)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lemniscate_path = path
    scopes = _scopes.get()[:-1] if lasting else _scopes.get()
    if scopes:
        scopes[-1].append(out)
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table of :func:`stored` that no later plan reads."""
    path = getattr(df, "_lemniscate_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def join_counted(big: DataFrame, small: DataFrame, left: str, right: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """``big`` joined to ``small``, which has one row per key and in ``n`` the number of rows that ``big`` has of it.

    Keys with a thousandth of the ``total`` rows or more, a thousand at most,
    are broadcast; the others, none of which is hot, are joined by shuffle.
    Keys compare null-safely; ``right`` is dropped.
    """
    heavy = F.col(n) >= max(total, 1) / 1000
    hot = small.filter(heavy)
    same = F.col(left).eqNullSafe(F.col(right))
    a = big.join(F.broadcast(hot), same)
    b = big.join(F.broadcast(hot.select(right)), same, "left_anti").join(small.filter(~heavy), same, how)
    return a.unionByName(b).drop(right)


def packed(docs: DataFrame, name: str = "row") -> DataFrame:
    """All columns as one struct, so that no helper column can clash with a given one."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))


def unpacked(df: DataFrame, columns: list[str], replaced: dict[str, Column], name: str = "row") -> DataFrame:
    """The columns that :func:`packed` had, some of them replaced."""
    return df.select(*[(replaced[c] if c in replaced else F.col(f"{name}.`{c}`")).alias(c) for c in columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
