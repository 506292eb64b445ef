"""What to (re)index, and collections as tables: selection by manifest, upsert, delete, manifest rebuild."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNKER_VERSION = 2


def pending(videos: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return videos.join(done.select(key).distinct(), key, "left_anti")


def listed(duration: Column, is_live: Column, least: float = 60) -> Column:
    """Which listed videos count: not live and long enough, unknown or 0 lengths passing; with least 0 all do."""
    if least <= 0:
        return F.lit(True)
    known = F.coalesce(duration, F.lit(0))
    return ~F.coalesce(is_live, F.lit(False)) & ((known == 0) | (known >= least))


def select_videos(files: DataFrame, manifest: DataFrame, *, force: bool = False, key: str = "video_id") -> DataFrame:
    """Adds action ('process' or 'skip') and altered to files (key, mtime), by manifest (key, mtime, chunker)."""
    known = manifest.select(F.col(key).alias("__k"), F.col("mtime").alias("__m"), F.col("chunker").alias("__c"))
    joined = files.join(known, F.col(key) == F.col("__k"), "left")
    absent = F.col("__k").isNull()
    stale = ~absent & ~F.col("__c").eqNullSafe(F.lit(CHUNKER_VERSION))
    newer = F.col("mtime") > F.coalesce("__m", F.lit(0.0))
    process = absent | stale | F.lit(force) | newer
    altered = ~absent & (stale | (F.lit(not force) & newer))
    return joined.withColumn("action", F.when(process, "process").otherwise("skip")).withColumn("altered", altered).drop("__k", "__m", "__c")


def counters(selected: DataFrame) -> DataFrame:
    return selected.agg(
        F.count_if(F.col("action") == "process").alias("to_process"),
        F.count_if(F.col("action") == "skip").alias("ignored"),
        F.count_if("altered").alias("altered"),
    )


def rebuild_manifest(chunks: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, chunks) of every video with a name; such records carry no chunker, so all are stale."""
    named = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    return chunks.where(named).groupBy(key).agg(F.count(F.lit(1)).alias("chunks"))


def delete_by_key(collection: DataFrame, keys: DataFrame, key: str = "video_id") -> DataFrame:
    return collection.join(keys.select(key).distinct(), key, "left_anti")


def upsert(collection: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The collection with rows of the same key replaced and new ones added."""
    return collection.join(rows.select(key), key, "left_anti").unionByName(rows)


def replace_videos(collection: DataFrame, rows: DataFrame, video: str = "video_id", key: str = "id") -> DataFrame:
    """Reindexing: all old chunks of the videos go first, so that shrunken videos leave none behind."""
    return upsert(delete_by_key(collection, rows, video), rows, key)


def is_bot_error(message: Column) -> Column:
    # Fixed values, which results depend on.
    signs = ("Sign in to confirm you're not a bot", "Sign in to confirm you’re not a bot", "Failed to decrypt with DPAPI", "HTTP Error 403")
    found = F.lit(False)
    for sign in signs:
        found = found | F.coalesce(message.contains(sign), F.lit(False))
    return found


def bot_runs(attempts: DataFrame, most: int, *, run: str = "run", order: str = "pos") -> DataFrame:
    """Attempts (run, order, ok, message) with `failures`, the bot errors since the run's last success, and `stop`.

    Other errors neither count nor reset. A run ends with its first attempt that has `most` failures: later attempts
    are not made, and are left out.
    """
    bot = ~F.col("ok") & is_bot_error(F.col("message"))
    so_far = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy(run, "__s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = attempts.withColumn("__s", F.count_if(F.col("ok")).over(so_far)).withColumn("failures", F.count_if(bot).over(since))
    reached = counted.withColumn("stop", (F.col("failures") >= most) & bot)
    earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)
    return reached.withColumn("__e", F.coalesce(F.bool_or("stop").over(earlier), F.lit(False))).where("not __e").drop("__s", "__e")


def video_url(webpage_url: Column, url: Column, video_id: Column) -> Column:
    found = F.coalesce(F.nullif(webpage_url, F.lit("")), url, F.lit(""))
    return F.when(found.startswith("http"), found).otherwise(F.concat(F.lit("https://www.youtube.com/watch?v="), video_id))
