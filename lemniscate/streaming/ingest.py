"""Incremental ingestion with Structured Streaming.

A checkpoint folder remembers which files were taken, and a batch is marked
done only after its table write has ended; posts that still miss a vector are
found by an anti-join, so the fill-up can run again at any time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lemniscate.operators.maintain import without


def stream_of(spark: SparkSession, path: str, schema: StructType | str, form: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def ingest(
    source: DataFrame, out: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, key: str = "post_id"
) -> StreamingQuery:
    """Append what the source has now, prepared, one row per key and batch, and stop when it is read."""

    def write(batch: DataFrame, number: int) -> None:
        # Each batch owns a folder: written again after a failure, it replaces itself.
        prepare(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collection(spark: SparkSession, out: str, key: str = "post_id") -> DataFrame:
    """What was ingested; of a key that came twice the latest batch's row."""
    rows = spark.read.parquet(out)
    others = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("r"))
    return newest.select(key, *[F.col(f"r.{c}").alias(c) for c in others if c != "batch"])


def fill_missing(
    posts: DataFrame, vectors: DataFrame | None, embed: Callable[[DataFrame], DataFrame], key: str = "post_id"
) -> DataFrame:
    """Vectors for the posts that ``vectors`` lacks, as ``embed`` gives them."""
    return embed(posts if vectors is None else without(posts, vectors, key))


def max_id(batch: DataFrame, key: str = "post_id") -> int | None:
    """The highest id of a batch, where ingestion by id goes on."""
    return batch.agg(F.max(F.col(key).cast("long"))).first()[0]
