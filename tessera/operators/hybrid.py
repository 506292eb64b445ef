"""Reciprocal-rank fusion of vector and lexical rankings, thresholds, diversification, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as tx
from tessera.operators import lexical, vectors

RRF_K = 60


def fuse(vector: DataFrame, lexical_hits: DataFrame, lexical_weight: float = 1.0) -> DataFrame:
    """(id, distance, vector_rank, lexical_rank, score) of two rankings with 0-based ranks.

    If the lexical side has no row, the score is that of the vector side alone, 1/(60 + rank), which is one rank
    more generous than the fused 1/(61 + rank). Both branches are one plan: the lexical side's count is a window
    over the at most 2k fused rows.
    """
    v = vector.select("id", "distance", F.col("rank").alias("vector_rank"))
    hits = lexical_hits.select(F.col("id").alias("__lid"), F.col("rank").alias("lexical_rank"))
    both = v.join(hits, F.col("id") == F.col("__lid"), "full").withColumn("id", F.coalesce("id", "__lid")).drop("__lid")
    alone = F.count("lexical_rank").over(Window.partitionBy()) == 0
    side = lambda rank, w: F.coalesce(w / (RRF_K + 1 + F.col(rank)), F.lit(0.0))
    fused = side("vector_rank", F.lit(1.0)) + side("lexical_rank", F.lit(float(lexical_weight)))
    return both.withColumn("score", F.when(alone, 1.0 / (RRF_K + F.col("vector_rank"))).otherwise(fused))


def final_order() -> list[Column]:
    """Best score first; of equal scores lexical hits come first, by their rank, then the others by theirs."""
    return [F.round("score", 12).desc(), F.col("lexical_rank").isNull(), F.coalesce("lexical_rank", "vector_rank"), F.col("id")]


def ranked(results: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Adds pos (0-based) after dropping scores under the threshold."""
    kept = results.where(F.col("score") >= min_score)
    return kept.withColumn("pos", F.row_number().over(Window.orderBy(*final_order())) - 1)


def diversify(results: DataFrame, most: int, group: str = "video_id", order: str = "pos") -> DataFrame:
    """Renumbers pos: the first `most` of each group, then the rest, both in their order; 0 changes nothing."""
    if most <= 0:
        return results
    over = F.row_number().over(Window.partitionBy(F.coalesce(F.col(group).cast("string"), F.lit(""))).orderBy(order)) > most
    marked = results.withColumn("__over", over)
    return marked.withColumn(order, F.row_number().over(Window.orderBy("__over", order)) - 1).drop("__over")


def hybrid_search(
    chunks: DataFrame,
    query_vector: list[float],
    query_text: str,
    *,
    candidates: int = 50,
    lexical_weight: float = 1.0,
    min_score: float = 0.0,
    where: Column | None = None,
    per_video: int = 0,
    top_k: int | None = None,
    hybrid: bool = True,
) -> DataFrame:
    """Search over (id, document, embedding, video_id, ...): (id, distance, vector_rank, lexical_rank, score, pos).

    `where` applies before the vector top-k but after the lexical one, whose ranks are then renumbered.
    """
    near = vectors.cosine_top_k(chunks if where is None else chunks.where(where), query_vector, candidates)
    if hybrid and lexical_weight > 0 and query_text.strip():
        hits = lexical.bm25(chunks, query_text, candidates)
        if where is not None:
            allowed = chunks.where(where).select(F.col("id").alias("__aid"))
            # at most `candidates` rows on the hits' side
            hits = allowed.join(F.broadcast(hits), F.col("__aid") == F.col("id")).drop("__aid")
            hits = hits.withColumn("rank", F.row_number().over(Window.orderBy("rank")) - 1)
    else:
        hits = near.where(F.lit(False)).select("id", "rank")
    found = ranked(fuse(near, hits, lexical_weight), min_score)
    if per_video > 0:
        # at most 2 x candidates rows are looked up
        videos = chunks.select(F.col("id").alias("__cid"), "video_id").join(F.broadcast(found), F.col("__cid") == F.col("id"))
        found = diversify(videos.drop("__cid"), per_video)
    return found if top_k is None else found.where(F.col("pos") < top_k)


def labels(results: DataFrame) -> DataFrame:
    """Adds origin, distance_label and score_label as they are shown."""
    shown = lambda name, rank: F.when(F.col(rank).isNotNull(), F.format_string(f"{name} #%d", F.col(rank) + 1))
    return (
        results.withColumn("origin", F.concat_ws(" + ", shown("vetorial", "vector_rank"), shown("lexical", "lexical_rank")))
        .withColumn("distance_label", F.when(F.col("distance").isNull(), "lexical").otherwise(F.format_string("cosseno %.3f", F.col("distance"))))
        .withColumn("score_label", F.format_string("RRF %.4f", F.col("score")))
    )


def rendered(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, pos, block): the text shown for each result. The wording is fixed, as readers of the output depend on it."""
    about = chunks.select(
        F.col("id").alias("__cid"), "document", "title", "upload_date", "start_str", "end_str", "chunk_index", "total_chunks", "timestamp_url"
    )
    # at most 2 x candidates rows are looked up
    found = about.join(F.broadcast(labels(results)), F.col("__cid") == F.col("id"))
    dated = F.coalesce(F.col("upload_date"), F.lit("")) != ""
    lines = F.concat_ws(
        "\n",
        F.format_string("[%d] %s | %s | %s", F.col("pos") + 1, "distance_label", "score_label", "origin"),
        F.format_string("  Vídeo:  %s", F.coalesce("title", F.lit("(sem título)"))),
        F.when(dated, F.format_string("  Data:   %s", "upload_date")),
        F.format_string(
            "  Momento: %s → %s  (bloco %d de %d)",
            F.coalesce("start_str", F.lit("??:??")),
            F.coalesce("end_str", F.lit("??:??")),
            F.coalesce("chunk_index", F.lit(0)) + 1,
            F.coalesce("total_chunks", F.lit(1)),
        ),
        F.format_string("  Link:   %s", F.coalesce("timestamp_url", F.lit(""))),
        F.lit("  Trecho:"),
        F.concat(F.lit("    "), tx.strip(F.col("document"))),
    )
    return found.select("id", "pos", lines.alias("block"))
