"""Exact deduplication with a heavy-hitter split, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, cut, numbered, text_of, unpacked

RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    support: float = 1 / 512,
) -> DataFrame:
    """Marks, in each group of texts equal but for white space, the one row that stays.

    Texts are read and digested once, into a table of the carried columns, lengths, digests and row numbers; what
    follows reads its narrow columns. Misra-Gries counters (at most 1/support of them, kept per partition and
    merged) name every digest that can hold more than that share of the rows. Their exact sizes and winners come
    from a map-side combining aggregate over them alone and are broadcast (at most 1/support rows), so that rows of
    frequent digests never shuffle; the other digests are aggregated and joined by ordinary shuffling.

    Returned: the carried columns (default: all) and keep_id, group_size, kept, text_sha256, which replace input
    columns of these names. The row with the most code points stays, then the smallest id, null ids last. Of
    repeated rows exactly one, the first by row number, is kept: minima choose it, so a group is never gathered. A
    null text counts as empty; an empty table gives an empty result.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    text = text_of(text_col)
    rows = numbered(
        docs,
        carry,
        [
            F.col(id_col).alias("__id"),
            F.char_length(text).alias("__len"),
            F.unhex(F.sha2(F.regexp_replace(text, SPACE, ""), 256)).alias("__digest"),
        ],
    )
    keys = rows.drop("__row")
    frequent = keys.select(F.hex("__digest").alias("d")).freqItems(["d"], support)
    suspects = frequent.select(F.explode("d_freqItems").alias("d")).select(F.unhex("d").alias("__digest"))
    # longest first, then null ids last, then the smallest id, then the first of repeated rows
    better = F.struct((-F.col("__len")).alias("l"), F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), F.col("__uid").alias("u"))

    def sizes(of: DataFrame) -> DataFrame:
        return of.groupBy("__digest").agg(F.count(F.lit(1)).alias("__n"), F.min(better).alias("__best"))

    # at most 1/support rows
    winners = cut(sizes(keys.join(F.broadcast(suspects), "__digest")))
    heavy = rows.join(F.broadcast(winners), "__digest")
    light = rows.join(F.broadcast(winners.select("__digest")), "__digest", "left_anti")
    light = light.join(sizes(keys.join(F.broadcast(winners.select("__digest")), "__digest", "left_anti")), "__digest")
    return heavy.unionByName(light).select(
        *unpacked(carry),
        F.col("__best.i").alias("keep_id"),
        F.col("__n").alias("group_size"),
        (F.col("__uid") == F.col("__best.u")).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS txt,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (SELECT doc_id, text_sha256, length(txt) AS n FROM t)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST) = 1 AS kept,
       text_sha256
FROM r
"""
