"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.storage import cut, drop, new_path, scratch, store  # noqa: F401

#: What counts as white space in every word-based contract here.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
HEAVY = 1000  # a key with more than 1/HEAVY of the rows joins by broadcast; there are fewer than HEAVY of them


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def packed(names: list[str]) -> Column:
    """The caller's columns as one struct, so that no name of theirs can clash with ours."""
    return (F.struct(*[F.col(f"`{n}`") for n in names]) if names else F.lit(None).cast("string")).alias("__row")


def unpacked(names: list[str]) -> list[Column]:
    return [F.col("__row").getField(n).alias(n) for n in names]


def fold(name: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(name).cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))


def ranked(df: DataFrame, groups: list[str], order: list[str], rank: str, buckets: int) -> DataFrame:
    """Adds a gapless 0-based rank in each group of a few large groups.

    Rows are dealt to hash buckets of their order columns; bucket counts (groups x buckets rows) give each
    bucket's offset, so that no group is ever sorted in one task. df must be cheap to compute twice.
    """
    df = df.withColumn("__b", F.pmod(F.xxhash64(*order, F.lit(rank)), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        F.col("__b").alias("__ob"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
    )
    inside = df.withColumn("__i", F.row_number().over(Window.partitionBy(*groups, "__b").orderBy(*order)) - 1)
    same = F.col("__b") == F.col("__ob")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    # groups x buckets rows: both are parameters of the caller, so the table has a fixed size bound
    return (
        inside.join(F.broadcast(offsets), same)
        .withColumn(rank, (F.col("__off") + F.col("__i")).cast("long"))
        .drop("__b", "__ob", "__off", "__i", *[f"__g{i}" for i in range(len(groups))])
    )


def attach(rows: DataFrame, summary: DataFrame, keys: list[str], weight: str, total: int, nulls: bool = False) -> DataFrame:
    """rows left-joined with a summary of one row a key, where `weight` counts the rows of that key.

    Fewer than HEAVY keys can hold more than 1/HEAVY of all rows: these are broadcast, and only rows of lighter
    keys shuffle, so that no task gets a large group. With `nulls`, the first key may be null: such rows match nothing
    and stay where they are.
    """
    added = [c for c in summary.columns if c not in keys]
    tagged = rows.join(F.broadcast(summary.where(F.col(weight) * HEAVY > total)), keys, "left")
    rest = tagged.where(F.col(weight).isNull()).drop(*added)
    found = tagged.where(F.col(weight).isNotNull())
    if nulls:
        none = [F.lit(None).cast(summary.schema[c].dataType).alias(c) for c in added]
        found = found.unionByName(rest.where(F.col(keys[0]).isNull()).select("*", *none))
        rest = rest.where(F.col(keys[0]).isNotNull())
    return found.unionByName(rest.join(summary.where(F.col(weight) * HEAVY <= total), keys, "left"))


def release(spark: SparkSession) -> None:
    """Lets the driver drop the shuffle files of plans that are done with; they would count against the disk."""
    gc.collect()
    spark._jvm.System.gc()


def numbered(docs: DataFrame, carry: list[str], columns: list[Column]) -> DataFrame:
    """The carried columns as one struct, further columns and a row number __uid (unique, with gaps), stored once.

    Decisions are then made on narrow columns of the table and brought back by __uid.
    """
    return store(docs.select(packed(carry), *columns, F.monotonically_increasing_id().alias("__uid")))
