"""Exact vector search over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """Unit vector in double precision; a zero vector stays."""
    size = norm(vector)
    return F.transform(vector, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def cosine_distance(vector: Column, query: Column, query_norm: Column | None = None) -> Column:
    """1 minus the cosine; 1 if either side is all zeros, null if a number is missing or the lengths differ."""
    dot = _dot(vector, query)
    scale = norm(vector) * (norm(query) if query_norm is None else query_norm)
    return F.when(scale == 0, dot + 1).otherwise(1 - F.try_divide(dot, scale))


def literal(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def cosine_top_k(vectors: DataFrame, query: list[float], k: int = 50, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, distance, rank) of the k nearest; filters belong before it. Each task keeps k rows; only they meet.

    The query is a literal, and its norm a constant, so the scan is one projection. A vector or query of zeros is at
    distance 1; rows whose vector is null, of another length or holds a null have no distance and are not found.
    """
    size = sum(float(x) ** 2 for x in query) ** 0.5
    distance = cosine_distance(F.col(vector), literal(query), F.lit(size))
    order = [F.round("distance", 9).asc_nulls_last(), F.col("id")]
    best = vectors.select(F.col(key).alias("id"), distance.alias("distance")).orderBy(*order).limit(k)
    found = best.where("distance is not null")
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def wrong_dimension(vectors: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is missing or of another length."""
    return vectors.where(F.coalesce(F.size(vector), F.lit(-1)) != dimension)
