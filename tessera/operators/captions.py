"""WebVTT and SRT captions to timed segments, without the repetitions of rolling captions."""

from __future__ import annotations

import html
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as tx

#: Entities that HTML takes without their semicolon, and which names go on to another one. Of those that lack it only
#: an &amp that runs into no word is sure to be one.
_OPEN = [n for n in html5 if not n.endswith(";")]
_CLOSED = [n for n in html5 if n.endswith(";") and n.startswith(tuple(_OPEN))]
UNCLOSED = rf"&(?=amp[a-z0-9]|(?!amp)(?:{'|'.join(_OPEN)})|#)(?!{'|'.join(_CLOSED)}|#[0-9]+;|#[xX][0-9a-fA-F]+;)"


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """HTML entities have no built-in function; only texts with an ampersand differ."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def clean_caption(text: Column, unclosed: bool = True) -> Column:
    """Without markup and entities; entities without a semicolon, as in a text that was cut, stay if not `unclosed`."""
    bare = tx.without_markup(text)
    return tx.tidy_caption(unescape(bare if unclosed else F.regexp_replace(bare, UNCLOSED, "&amp;")))


def decode_bytes(content: Column) -> Column:
    """UTF-8 where it is valid, else Latin-1."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))


def repeated_words(previous: Column, current: Column) -> Column:
    """Length of the longest start of the current words, two at least, that ends the previous; 0 if there is none."""
    most = F.least(F.size(previous), F.size(current))
    sizes = F.when(most >= 2, F.sequence(most, F.lit(2))).otherwise(F.array().cast("array<int>"))
    overlap = F.filter(
        sizes,
        lambda n: (F.get(previous, F.size(previous) - n) == F.get(current, F.lit(0)))
        & (F.slice(previous, F.size(previous) - n + 1, n) == F.slice(current, F.lit(1), n)),
    )
    return F.coalesce(F.get(overlap, F.lit(0)), F.lit(0))


def drop_repetition(cues: DataFrame, key: str = "path", order: str = "pos") -> DataFrame:
    """Cues (key, order, start, end, text) of each key, each without what repeats the last one that was kept.

    A fold over a file's cues in order: what was last emitted, not the cue before, decides. A cue equal to it, or
    with nothing new that holds a letter or digit, is dropped.
    """
    worded = cues.withColumn("words", tx.words(F.col("text")))
    listed = worded.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "start", "end", "text", "words"))).alias("cues"))
    kind = "array<struct<start:double,end:double,text:string>>"

    def step(acc: Column, cue: Column) -> Column:
        def emit(cut: Column) -> Column:
            words = cue["words"]
            fresh = F.slice(words, cut + 1, F.greatest(F.size(words) - cut, F.lit(0)))
            same = (cut == 0) & (acc["last"] == words)
            keep = ~same & F.exists(fresh, lambda w: w.rlike(r"[\p{L}\p{N}]"))
            said = F.when(cut == 0, cue["text"]).otherwise(F.array_join(fresh, " "))
            segment = F.struct(cue["start"].alias("start"), F.greatest(cue["start"], cue["end"]).alias("end"), said.alias("text"))
            return F.when(
                keep, F.struct(fresh.alias("last"), F.concat(acc["out"], F.array(segment)).alias("out"))
            ).otherwise(acc)

        return tx.let(repeated_words(acc["last"], cue["words"]), emit)

    start = F.struct(F.array().cast("array<string>").alias("last"), F.array().cast(kind).alias("out"))
    return listed.select(key, F.aggregate("cues", start, step, lambda a: a["out"]).alias("segments"))


def parse_cues(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, pos, start, end, text) for each cue with useful text, before repetitions are dropped."""
    lines = F.regexp_replace(F.coalesce(F.col(content), F.lit("")), "\r\n|\r", "\n")
    paragraphs = F.split(lines, r"\n(?U:\s*)\n|^(?U:\s*)\n")
    rows = files.select(key, F.posexplode(paragraphs).alias("pos", "paragraph"))
    listed = rows.withColumn("lines", F.split("paragraph", "\n"))
    opens = lambda line: ~line.rlike("^(WEBVTT|NOTE|STYLE|REGION)") & line.rlike(tx.TIMING)
    at = F.array_position(F.transform("lines", opens), True).cast("int")
    opened = listed.withColumn("at", at).where("at > 0")
    opened = opened.withColumn("head", F.element_at("lines", F.col("at"))).withColumn(
        "payload",
        F.filter(F.slice("lines", F.col("at") + 1, F.size("lines")), lambda line: tx.strip(line) != ""),
    )
    first = F.get("payload", F.lit(0))
    numbered = (F.size("payload") > 1) & tx.strip(first).rlike(r"^\p{Nd}+$")
    rest = F.slice("payload", F.lit(2), F.greatest(F.size("payload"), F.lit(1)))
    trimmed = F.concat(F.array(F.regexp_replace(first, r"<(\d+)>\s*$", "")), rest)
    body = F.when(F.size("payload") == 0, F.lit("")).when(numbered, F.array_join(rest, " ")).otherwise(F.array_join(trimmed, " "))
    return (
        opened.withColumn("text", clean_caption(body))
        .withColumn("start", tx.caption_seconds(F.regexp_extract("head", tx.TIMING, 1)))
        .withColumn("end", tx.caption_seconds(F.regexp_extract("head", tx.TIMING, 2)))
        .where(tx.is_useful(F.col("text")))
        .select(key, "pos", "start", "end", "text")
    )


def parse_captions(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, segments) for each file that has any."""
    return drop_repetition(parse_cues(files, key, content), key)
