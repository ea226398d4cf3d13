"""Session builder and table access."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
_swept: set[str] = set()


def session(app: str = "lemniscate", **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC; further settings override."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in settings.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sides of a join up to this many rows are small enough to be broadcast.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder in ``spark.checkpoint.dir``; it goes when the driver's Python ends.

    Only a local session that sets none gets a temporary folder of its own.
    """
    app = spark.sparkContext.applicationId
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _own_folder:
            _own_folder[app] = tempfile.mkdtemp(prefix="lemniscate-tables-")
            atexit.register(shutil.rmtree, _own_folder[app], ignore_errors=True)
        return f"file://{_own_folder[app]}"
    path = f"{given.rstrip('/')}/lemniscate-tables/{app}"
    if path not in _swept:
        _swept.add(path)
        atexit.register(_sweep, spark._jvm, spark._jsc.hadoopConfiguration(), path)
    return path


def _sweep(jvm: object, conf: object, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once, and its lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lemniscate_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`stored` that no later plan reads."""
    path = getattr(df, "_lemniscate_path", None)
    if path:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
