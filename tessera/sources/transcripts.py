"""Readers and writers: transcripts, captions, done lists, error logs, manifests, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as tx
from tessera.operators.captions import decode_bytes, parse_captions
from tessera.sources.storage import file_system

TRANSCRIPT = (
    "id string, title string, upload_date string, webpage_url string, duration double, detected_language string, "
    "language_probability double, segments array<string>, _corrupt_record string"
)
SEGMENT = "start string, end string, text string"


def read_transcripts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a JSON file; unreadable files are left out. Ids fall back to the file's stem; mtime in seconds.

    Segments stay JSON texts, as any element may be anything.
    """
    rows = (
        spark.read.schema(TRANSCRIPT)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.json")
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"))
    )
    stem = F.regexp_extract(F.try_url_decode("path"), r"([^/]*)\.json$", 1)
    return (
        rows.where("_corrupt_record is null")
        .withColumn("video_id", F.when(F.coalesce("id", F.lit("")) == "", stem).otherwise(F.col("id")))
        .withColumn("mtime", F.col("at").cast("double"))
        .drop("at", "_corrupt_record")
    )


def segment_rows(transcripts: DataFrame) -> DataFrame:
    """(video_id, pos, start, end, text) of elements that are objects, times still as written."""
    rows = transcripts.select("video_id", F.posexplode("segments").alias("pos", "raw")).where(F.col("raw").rlike(r"^\s*\{"))
    return rows.withColumn("s", F.from_json("raw", SEGMENT)).select("video_id", "pos", "s.start", "s.end", "s.text")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of caption files, decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{vtt,srt}").load(path)
    return files.select("path", decode_bytes(F.col("content")).alias("content"))


def best_captions(files: DataFrame, video: Column) -> DataFrame:
    """(video_id, path, segments): of each video's caption files the one with most segments, the first of equals."""
    parsed = parse_captions(files).withColumn("video_id", video)
    best = Window.partitionBy("video_id").orderBy(F.size("segments").desc(), "path")
    return parsed.withColumn("i", F.row_number().over(best)).where("i = 1").drop("i")


def asr_segments(raw: Column) -> Column:
    """Segments of a recogniser's JSON with offsets in milliseconds, stripped, without empty ones."""
    parsed = F.from_json(raw, "transcription array<struct<offsets:struct<`from`:double,`to`:double>,text:string>>")
    rows = F.transform(
        parsed["transcription"],
        lambda t: F.struct(
            (t["offsets"]["from"] / 1000).alias("start"), (t["offsets"]["to"] / 1000).alias("end"), tx.strip(t["text"]).alias("text")
        ),
    )
    return F.filter(rows, lambda s: F.coalesce(s["text"], F.lit("")) != "")


def asr_language(name: Column) -> Column:
    clean = F.lower(tx.strip(name))
    return F.when(~clean.isin("", "auto"), clean)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The distinct, not blank lines of a done list (id); a list that does not exist yet is empty."""
    files, where = file_system(spark, path)
    if not files.exists(where):
        return spark.createDataFrame([], "id string")
    return spark.read.text(path).select(tx.strip(F.col("value")).alias("id")).where("id <> ''").distinct()


def append_done(ids: DataFrame, path: str) -> None:
    ids.select(F.col("id").cast("string")).write.mode("append").text(path)


def append_errors(errors: DataFrame, path: str) -> None:
    """Tab-separated (at, id, 'kind: message') with line breaks as spaces."""
    flat = F.regexp_replace(F.concat_ws(": ", "kind", "message"), "[\r\n]", " ")
    at = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ssXXX")
    errors.select(F.concat_ws("\t", at, "id", flat)).write.mode("append").text(path)


def as_text(segments: Column) -> Column:
    return F.concat(tx.strip(F.array_join(F.transform(segments, lambda s: s["text"]), "\n")), F.lit("\n"))


def as_vtt(segments: Column) -> Column:
    cues = F.transform(
        segments,
        lambda s: F.concat(
            tx.vtt_timestamp(s["start"]), F.lit(" --> "), tx.vtt_timestamp(s["end"]), F.lit("\n"),
            F.replace(s["text"], F.lit("-->"), F.lit("->")), F.lit("\n"),
        ),
    )
    return F.array_join(F.concat(F.array(F.lit("WEBVTT\n")), cues), "\n")


def as_json(row: DataFrame) -> Column:
    names = ["id", "title", "upload_date", "webpage_url", "duration", "detected_language", "language_probability", "segments"]
    return F.to_json(F.struct(*[F.col(n) for n in names if n in row.columns]), {"ignoreNullFields": "false"})


def output_name(upload_date: Column, title: Column, video_id: Column) -> Column:
    """'{date} - {title} [{id}]'; titles are reduced to safe characters (an approximation) and 110 of them."""
    safe = F.regexp_replace(F.translate(F.coalesce(title, video_id), tx.ACCENTED, tx.PLAIN), r"[^A-Za-z0-9._-]+", "_")
    short = F.substring(F.btrim(safe, F.lit(" ._")), 1, 110)
    date = F.coalesce(F.nullif(upload_date, F.lit("")), F.lit("SEM_DATA"))
    return F.concat(date, F.lit(" - "), F.coalesce(F.nullif(short, F.lit("")), video_id), F.lit(" ["), video_id, F.lit("]"))


def append_jsonl(chunks: DataFrame, path: str) -> None:
    """(id, embedding, document, metadata) lines."""
    meta = [c for c in chunks.columns if c not in ("id", "embedding", "document", "embedding_input")]
    chunks.select("id", "embedding", "document", F.struct(*meta).alias("metadata")).write.mode("append").json(path)


def lookup(chunks: DataFrame, ids: DataFrame, where: Column | None = None) -> DataFrame:
    """Chunks of the ids (a top-k list), filtered."""
    found = chunks.join(ids.select("id"), "id", "left_semi")
    return found if where is None else found.where(where)
