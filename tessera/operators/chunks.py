"""Timed segments to passages: greedy cuts by word budget, short-block merge, boundary trim, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as tx


def number_or_null(value: Column) -> Column:
    return value.cast("string").try_cast("double")


def valid_segments(segments: DataFrame, video: str = "video_id", order: str = "pos") -> DataFrame:
    """(video, pos, start, end, text) with times repaired; blank and noise texts dropped.

    A bad or missing start is 0, a bad, missing or zero end is the start, and ends before starts are swapped.
    """
    start = F.coalesce(number_or_null(F.col("start")), F.lit(0.0))
    end = number_or_null(F.col("end"))
    end = F.when(end.isNull() | (end == 0), start).otherwise(end)
    text = tx.strip(F.coalesce(F.col("text"), F.lit("")))
    return (
        segments.select(video, order, F.least(start, end).alias("start"), F.greatest(start, end).alias("end"), text.alias("text"))
        .where(~tx.is_noise(F.col("text")))
    )


def numbered(segments: DataFrame, video: str = "video_id", order: str = "pos") -> DataFrame:
    """Adds seg (0-based), n (of the video), w (words) and stop (ends a sentence)."""
    by = Window.partitionBy(video)
    return (
        segments.withColumn("seg", F.row_number().over(by.orderBy(order)) - 1)
        .withColumn("n", F.count(F.lit(1)).over(by).cast("int"))
        .withColumn("w", tx.word_count(F.col("text")))
        .withColumn("stop", tx.ends_sentence(F.col("text")))
    )


def greedy_blocks(segments: DataFrame, target: int = 160, video: str = "video_id") -> DataFrame:
    """Adds block: a block closes after the segment that reaches the target, if another follows.

    The fold carries the words so far and the cuts only, so its state grows by one number a block. What is left
    after the last cut is one block up to its last sentence end (not counting its first segment), then single
    segments.
    """
    target = max(20, int(target))
    listed = segments.groupBy(video).agg(F.array_sort(F.collect_list(F.struct("seg", "w"))).alias("all"))

    def step(acc: Column, s: Column) -> Column:
        words = acc["words"] + s["w"]
        full = (words >= target) & (s["seg"] + 1 < acc["n"])
        return F.struct(
            F.when(full, 0).otherwise(words).alias("words"),
            F.when(full, F.concat(acc["cuts"], F.array(s["seg"] + 1))).otherwise(acc["cuts"]).alias("cuts"),
            acc["n"].alias("n"),
        )

    start = F.struct(F.lit(0).alias("words"), F.array().cast("array<int>").alias("cuts"), F.size("all").alias("n"))
    cuts = listed.select(F.col(video).alias("__v"), F.aggregate("all", start, step, lambda a: a["cuts"]).alias("cuts"))
    tail = F.coalesce(F.array_max("cuts"), F.lit(0))
    rows = segments.join(cuts, F.col(video).eqNullSafe(F.col("__v"))).withColumn("tail", tail)
    stop_at = F.max(F.when(F.col("stop") & (F.col("seg") > F.col("tail")), F.col("seg"))).over(Window.partitionBy(video))
    passed = F.size(F.filter("cuts", lambda c: c <= F.col("seg")))
    first = F.size("cuts")
    own = (
        F.when(F.col("seg") < F.col("tail"), passed)
        .when(F.col("__stop").isNotNull() & (F.col("seg") <= F.col("__stop")), first)
        .otherwise(first + F.col("seg") - F.coalesce(F.col("__stop"), F.col("tail")))
    )
    return rows.withColumn("__stop", stop_at).withColumn("block", own.cast("int")).drop("__v", "cuts", "tail", "__stop")


def merge_short(blocks: DataFrame, least: int = 25, video: str = "video_id") -> DataFrame:
    """Blocks under `least` words join the block to their left; leading ones the next, if they stay short together."""
    if least <= 0:
        return blocks
    sized = blocks.withColumn("__words", F.sum("w").over(Window.partitionBy(video, "block")))
    first = Window.partitionBy(video).orderBy("block", "seg")
    starts = F.lag("block").over(first).isNull() | (F.lag("block").over(first) != F.col("block"))
    long = (starts & (F.col("__words") >= least)).cast("int")
    grouped = sized.withColumn("__long", long).withColumn("__g", F.sum("__long").over(first.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(video)
    lead = F.sum(F.when(F.col("__g") == 0, F.col("w"))).over(whole)
    forward = (F.coalesce(lead, F.lit(0)) < least) & (F.max("__g").over(whole) > 0)
    return grouped.withColumn("block", F.when(forward, F.greatest(F.col("__g"), F.lit(1))).otherwise(F.col("__g")).cast("int")).drop(
        "__words", "__long", "__g"
    )


def trim_links(blocks: DataFrame, overlap: int = 30, video: str = "video_id") -> DataFrame:
    """Drops the first segment of a later block when it opens with a linking word.

    Only where that segment is under `overlap` words and the block reaches them before its last segment.
    """
    if overlap <= 0:
        return blocks
    place = Window.partitionBy(video, "block").orderBy("seg")
    rows = (
        blocks.withColumn("__i", F.row_number().over(place))
        .withColumn("__total", F.sum("w").over(Window.partitionBy(video, "block")))
        .withColumn("__last", F.last("w").over(place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("__first", F.min("block").over(Window.partitionBy(video)))
    )
    drop = (
        (F.col("__i") == 1)
        & (F.col("block") > F.col("__first"))
        & tx.start_linking(F.col("text"))
        & (F.col("w") < overlap)
        & (F.col("__total") - F.col("__last") >= overlap)
    )
    return rows.where(~drop).drop("__i", "__total", "__last", "__first")


def chunk_transcripts(
    segments: DataFrame,
    meta: DataFrame | None = None,
    *,
    target_words: int = 160,
    overlap_words: int = 30,
    min_chunk_words: int = 25,
    video: str = "video_id",
    order: str = "pos",
) -> DataFrame:
    """Passages of transcripts: (id, document, embedding_input, the 13 metadata columns).

    `segments` has (video, order, start, end, text), `meta` optionally (video, title, upload_date, webpage_url).
    """
    rows = numbered(valid_segments(segments, video, order), video, order)
    rows = trim_links(merge_short(greedy_blocks(rows, target_words, video), min_chunk_words, video), overlap_words, video)
    joined = rows.groupBy(video, "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda s: s["text"]), " ").alias("document"),
        F.min_by("start", "seg").alias("start_time"),
        F.max_by("end", "seg").alias("end_time"),
    )
    by = Window.partitionBy(video)
    joined = joined.withColumn("chunk_index", F.row_number().over(by.orderBy("block")) - 1).withColumn(
        "total_chunks", F.count(F.lit(1)).over(by).cast("int")
    )
    vid = F.coalesce(F.col(video).cast("string"), F.lit(""))
    if meta is None:
        joined = joined.select("*", *[F.lit(None).cast("string").alias(c) for c in ("title", "upload_date", "webpage_url")])
    else:
        names = meta.select(F.col(video).alias("__v"), "title", "upload_date", "webpage_url")
        joined = joined.join(names, F.col(video).eqNullSafe(F.col("__v")), "left")
    page = F.when(F.coalesce("webpage_url", F.lit("")) == "", F.concat(F.lit(tx.WATCH_URL), vid)).otherwise(F.col("webpage_url"))
    title = F.when(F.coalesce("title", F.lit("")) == "", F.lit("Vídeo sem título")).otherwise(F.col("title"))
    return joined.select(
        F.format_string("%s_chunk_%04d", vid, F.col("chunk_index")).alias("id"),
        "document",
        F.col("document").alias("embedding_input"),
        vid.alias("video_id"),
        title.alias("title"),
        F.coalesce("upload_date", F.lit("")).alias("upload_date"),
        page.alias("webpage_url"),
        tx.timestamp_url(page, F.col("start_time")).alias("timestamp_url"),
        "start_time",
        "end_time",
        tx.format_seconds(F.col("start_time")).alias("start_str"),
        tx.format_seconds(F.col("end_time")).alias("end_str"),
        "chunk_index",
        "total_chunks",
        tx.word_count(F.col("document")).alias("word_count"),
        F.char_length("document").alias("char_count"),
    )
