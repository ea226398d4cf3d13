"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null or all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(v: Column) -> Column:
    """The vector brought to length 1; null where it is null or all zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n))


def knn_score(a: Column, b: Column) -> Column:
    """Cosine moved to 0..1, as nearest-neighbour search scores it."""
    return (1 + cosine(a, b)) / 2


def added(*vectors: Column) -> Column:
    """Element-wise sum; null if a part is null."""
    out = doubles(vectors[0])
    for v in vectors[1:]:
        out = F.zip_with(out, doubles(v), lambda x, y: x + y)
    return out


def added_leniently(dims: int, *vectors: Column) -> Column:
    """Element-wise sum in which missing parts count as zero; null if all are missing."""
    zero = F.array_repeat(F.lit(0.0), dims)
    total = added(*[F.coalesce(doubles(v), zero) for v in vectors])
    return F.when(F.coalesce(*[F.when(v.isNotNull(), 1) for v in vectors]).isNotNull(), total)


def concatenated(*vectors: Column) -> Column:
    return F.concat(*[doubles(v) for v in vectors])


def mean_vectors(df: DataFrame, key: str, vector: str, weights: str | None = None) -> DataFrame:
    """``key`` and the (weighted) mean of its vectors; null vectors are skipped.

    Vectors are added up where they are read and only the sums are shuffled;
    a key's vectors are never gathered.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = df.filter(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(doubles(F.col(vector))))
    mean = Summarizer.mean(F.col("_v"), F.col(weights)) if weights else Summarizer.mean(F.col("_v"))
    return rows.groupBy(key).agg(mean.alias("_m")).select(key, vector_to_array("_m").alias(vector))


def weight(v: Column) -> Column:
    """Weight of a formula vector: a tenth of its norm, at most 1."""
    return F.least(F.lit(1.0), norm(v) / 10)
