"""Mixing sources to target weights by weighted fair queueing over shuffled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, cut, numbered, text_of, unpacked

RESULT = ["size", "source_size", "target", "taken", "finish"]


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """Water-filling: (__src, __source_size) -> with __target. One row a source, ranked in one task (a million sources
    are some 100 MB there).

    Sources by code point, null last, take the weights in turn. Sorted by capacity over weight, the capped ones
    come first: source i is capped when what is left for it exceeds `most` times its size. What is left, in words
    and in weights, falls along that order, so the first source that is not capped has the largest of both.
    """
    ordered = Window.orderBy(F.col("__src").isNull(), "__src")
    turn = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long")
    whole = Window.partitionBy()
    filled = Window.orderBy(F.col("__source_size") / F.col("__w"), F.col("__src").isNull(), "__src")
    earlier = filled.rowsBetween(Window.unboundedPreceding, -1)
    table = (
        sizes.withColumn("__w", weight)
        .withColumn("__all", F.sum("__source_size").over(whole))
        .withColumn("__weights", F.sum("__w").over(whole))
        .withColumn("__size_before", F.coalesce(F.sum("__source_size").over(earlier), F.lit(0)))
        .withColumn("__w_before", F.coalesce(F.sum("__w").over(earlier), F.lit(0)))
        # both times share[1], to stay in integers
        .withColumn("__left", share[0] * F.col("__all") - share[1] * most * F.col("__size_before"))
        .withColumn("__w_left", F.col("__weights") - F.col("__w_before"))
        .withColumn("__capped", share[1] * most * F.col("__source_size") * F.col("__w_left") <= F.col("__left") * F.col("__w"))
        .withColumn("__left_free", F.max(F.when(~F.col("__capped"), F.col("__left"))).over(whole))
        .withColumn("__w_free", F.max(F.when(~F.col("__capped"), F.col("__w_left"))).over(whole))
    )
    free = (F.col("__w") * F.col("__left_free")).cast("double") / (share[1] * F.col("__w_free")).cast("double")
    return table.select(
        "__src",
        "__source_size",
        F.col("__all"),
        F.when(F.col("__capped"), (most * F.col("__source_size")).cast("double")).otherwise(free).alias("__target"),
    )


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    carry: list[str] | None = None,
    weights: tuple[int, ...] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
) -> DataFrame:
    """Takes whole documents, at most twice each, until the mix holds share[0]/share[1] of all words.

    Each source's documents stand in a fixed shuffled order (md5 of the id and of the text, then the row number), twice
    over. A document's virtual finish time is the running word count of its source divided by the source's target; the
    mix is the prefix, in order of finish time, that fits the total. Everything finishing by time 1 fits (no source is
    past its target there); of what follows, only documents within the few words still left can enter, and these and
    each source's first that is too long (the prefix ends there) are sorted together, a few rows a source in one task.

    Texts are read once, into a table of the carried columns, sizes, order and row numbers; decisions are made on its
    narrow columns and brought back by row number. Running counts come from (source, hash bucket) sums, so a hot source
    is split over 4096 buckets; only rows of equal id and text share a bucket by force.

    Returned: the carried columns (default: all) with size, source_size, target, taken (words) and finish (virtual
    time of the first copy; null without words); these replace input columns of such names. Null texts have no
    words and are never taken; repeated rows count as rows; a null source is a source of its own, ranked last;
    an empty table gives an empty result.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    digest = lambda c: F.md5(F.encode(c, "UTF-8"))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = numbered(
        docs,
        carry,
        [
            F.col(source_col).alias("__src"),
            F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("__size"),
            digest(F.concat(name, F.lit(":"), digest(text_of(text_col)))).alias("__order"),
        ],
    )
    keys = rows.select("__uid", "__src", "__size", "__order", F.conv(F.substring("__order", 1, 3), 16, 10).cast("int").alias("__b"))

    slots = cut(keys.groupBy("__src", "__b").agg(F.sum("__size").alias("__sum")))
    sizes = slots.groupBy("__src").agg(F.sum("__sum").alias("__source_size"))
    targets = source_targets(sizes, weights, share, 2)
    before = Window.partitionBy("__src").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slots.withColumn("__off", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
        .join(targets.withColumnRenamed("__src", "__tsrc"), F.col("__src").eqNullSafe(F.col("__tsrc")))
        .select(
            F.col("__src").alias("__osrc"), F.col("__b").alias("__ob"), "__off", "__source_size", "__target", "__all"
        )
    )
    inner = Window.partitionBy("__src", "__b").orderBy("__order", "__uid")
    queued = (
        keys.withColumn("__in", F.sum("__size").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
        .join(offsets, F.col("__src").eqNullSafe(F.col("__osrc")) & (F.col("__b") == F.col("__ob")))
        .withColumn("__cum", F.col("__off") + F.col("__in"))
        .drop("__osrc", "__ob", "__off", "__in", "__b")
    )
    first = (F.col("__cum") <= F.col("__target")) & (F.col("__size") > 0)
    second = (F.col("__cum") + F.col("__source_size") <= F.col("__target")) & (F.col("__size") > 0)
    queued = cut(queued.withColumn("__copies", F.when(first, 1).otherwise(0) + F.when(second, 1).otherwise(0)))

    # what is left once every source has reached time 1, and the next documents that may still fit
    taken = queued.groupBy("__src").agg(
        F.sum(F.col("__size") * F.col("__copies")).alias("__got"), F.max("__all").alias("__all")
    )
    taken = cut(taken)
    whole = taken.agg(F.sum("__got").alias("got"), F.max("__all").alias("all")).first()
    left = (share[0] * whole["all"]) // share[1] - whole["got"] if whole["all"] else 0
    got = taken.select(F.col("__src").alias("__gsrc"), "__got")
    spare = (
        queued.where("__size > 0 and __copies < 2")
        .withColumn("__turn", F.explode(F.sequence(F.col("__copies"), F.lit(1))))
        .withColumn("__at", F.col("__cum") + F.col("__turn") * F.col("__source_size"))
        .where((F.col("__at") > F.col("__target")) & (F.col("__at") - F.col("__size") - F.col("__target") <= left))
        .join(got, F.col("__src").eqNullSafe(F.col("__gsrc")))
        .where(F.col("__at") - F.col("__size") - F.col("__got") <= left)
    )
    line = Window.orderBy(
        F.col("__at") / F.col("__target"), F.col("__src").isNull(), "__src", "__order", "__uid", "__turn"
    ).rowsBetween(Window.unboundedPreceding, 0)
    extra = (
        spare.withColumn("__run", F.sum("__size").over(line))
        .where(F.col("__run") <= left)
        .groupBy("__uid")
        .agg(F.count(F.lit(1)).cast("int").alias("__extra"))
    )
    decided = queued.join(extra, "__uid", "left").withColumn("__copies", F.col("__copies") + F.coalesce(F.col("__extra"), F.lit(0)))
    return (
        rows.select("__row", "__uid")
        .join(decided, "__uid")
        .select(
            *unpacked(carry),
            F.col("__size").alias("size"),
            F.col("__source_size").alias("source_size"),
            F.col("__target").alias("target"),
            (F.col("__size") * F.col("__copies")).cast("long").alias("taken"),
            F.when(F.col("__size") > 0, F.col("__cum") / F.col("__target")).alias("finish"),
        )
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS o
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM s),
p AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS ws,
         CAST(coalesce(sum(source_size) OVER f, 0) AS BIGINT) AS sb, CAST(coalesce(sum(w) OVER f, 0) AS BIGINT) AS wb
  FROM w
  WINDOW f AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (
  SELECT *, 3 * total - 4 * sb AS lft, ws - wb AS wl,
         4 * source_size * (ws - wb) <= (3 * total - 4 * sb) * w AS capped FROM p),
f AS (
  SELECT *, max(CASE WHEN NOT capped THEN lft END) OVER () AS lf, max(CASE WHEN NOT capped THEN wl END) OVER () AS wf
  FROM c),
t AS (
  SELECT source, source_size, total,
         CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(w * lf AS DOUBLE) / CAST(2 * wf AS DOUBLE) END AS target
  FROM f),
q AS (
  SELECT d.rid, d.doc_id, d.source, d.size, d.o, t.source_size, t.target, t.total,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.rid
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, unnest([0, 1]) AS turn FROM q WHERE size > 0),
r AS (
  SELECT *, CAST(sum(size) OVER (
    ORDER BY CASE WHEN cum + turn * source_size <= target THEN 0 ELSE 1 END,
             CASE WHEN cum + turn * source_size <= target THEN 0
                  ELSE CAST(cum + turn * source_size AS DOUBLE) / target END,
             source NULLS LAST, o, rid, turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run
  FROM e),
k AS (SELECT rid, count(*) AS copies FROM r WHERE run <= (3 * total) // 2 GROUP BY rid)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(k.copies, 0) AS BIGINT) AS taken,
       CASE WHEN q.size > 0 THEN CAST(q.cum AS DOUBLE) / q.target END AS finish
FROM q LEFT JOIN k ON q.rid = k.rid
"""
