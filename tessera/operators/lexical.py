"""BM25 over passages: an index as three tables, a scan for single queries, a join for many."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as tx
from tessera.sources.storage import drop, file_system, new_path, store

K1, B = 1.5, 0.75


def term_frequencies(docs: DataFrame, key: str = "id", text: str = "document") -> DataFrame:
    """(id, term, tf)"""
    return docs.select(key, F.explode(tx.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(
        F.count(F.lit(1)).cast("int").alias("tf")
    )


def document_lengths(docs: DataFrame, key: str = "id", text: str = "document") -> DataFrame:
    """(id, len): number of tokens; documents without any stay."""
    return docs.select(key, F.size(tx.tokens(F.col(text))).alias("len"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n, avgdl); avgdl is 0 for an empty corpus."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, length: Column, avgdl: Column) -> Column:
    ratio = F.when(avgdl > 0, length / avgdl).otherwise(1.0)
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * ratio))


BUCKETS = 64  # partitions of a saved index by term


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def version(docs: DataFrame, key: str = "id", text: str = "document") -> tuple[int, str]:
    """Number of documents and a sum of their hashes: any change of an id or a text shows."""
    hashes = F.sum(F.xxhash64(key, text).cast("decimal(38,0)")).cast("string")
    return tuple(docs.agg(F.count(F.lit(1)), F.coalesce(hashes, F.lit("0"))).first())


@dataclass
class LexicalIndex:
    """Saved index: postings(bucket, term, id, tf, len), terms(term, df), corpus(n, avgdl, hashes, id_type)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame

    @staticmethod
    def build(docs: DataFrame, path: str | None = None, key: str = "id", text: str = "document") -> LexicalIndex:
        """Tokenises once; the other tables come from the written postings, which are sorted by term in their buckets."""
        spark = docs.sparkSession
        path = path or new_path(spark)
        n, hashes = version(docs, key, text)
        tokens = docs.select(F.col(key).alias("id"), tx.tokens(F.col(text)).alias("t"))
        postings = (
            tokens.select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
            .groupBy("term", "id")
            .agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("len").alias("len"))
            .withColumn("bucket", _bucket(F.col("term")))
        )
        # a bucket, which a very common term may fill, is dealt to more tasks as the documents grow
        shares = F.pmod(F.xxhash64("id"), F.lit(1 + n // 1_000_000))
        sorted_rows = postings.repartition("bucket", shares).sortWithinPartitions("bucket", "term", "id")
        sorted_rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        written = spark.read.schema(postings.schema).parquet(f"{path}/postings")
        document_frequencies(written).write.mode("overwrite").parquet(f"{path}/terms")
        total = F.coalesce(F.sum("tf"), F.lit(0))
        corpus = written.agg(
            F.lit(n).cast("long").alias("n"), (total / F.lit(max(n, 1))).alias("avgdl"), F.lit(hashes).alias("hashes"),
            F.lit(docs.select(key).schema[0].dataType.simpleString()).alias("id_type"),
        )
        corpus.write.mode("overwrite").parquet(f"{path}/corpus")
        return LexicalIndex.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LexicalIndex:
        parts = [spark.read.parquet(f"{path}/{p}") for p in ("terms", "corpus")]
        kind = parts[1].first()["id_type"]
        postings = spark.read.schema(f"term string, id {kind}, tf int, len int, bucket int").parquet(f"{path}/postings")
        return LexicalIndex(postings, *parts)

    @staticmethod
    def open(docs: DataFrame, path: str, key: str = "id", text: str = "document") -> LexicalIndex:
        """The saved index if it is of these documents, else a new one in its place."""
        spark = docs.sparkSession
        files, where = file_system(spark, f"{path}/corpus/_SUCCESS")
        if files.exists(where):
            found = LexicalIndex.load(spark, path)
            row = found.corpus.first()
            if row is not None and (row["n"], row["hashes"]) == version(docs, key, text):
                return found
        drop(spark, path)
        return LexicalIndex.build(docs, path, key, text)


def scan_scores(docs: DataFrame, query: str, key: str = "id", text: str = "document") -> DataFrame:
    """(id, score, term_ord) of every document that has a term of the query, without postings.

    Each text is tokenised once, into its length and the counts of the query's few terms, a narrow table that is
    stored; document frequencies, n, avgdl and the scores come from it. Documents never shuffle.
    """
    terms = tx.query_terms(query)
    if not terms:
        none = docs.select(F.col(key).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("term_ord"))
        return none.where(F.lit(False))
    names = F.array(*[F.lit(t) for t, _ in terms])

    def counted(tokens: Column) -> Column:
        wanted = F.filter(tokens, lambda x: F.array_contains(names, x))
        tf = tx.let(wanted, lambda w: F.transform(names, lambda name: F.size(F.filter(w, lambda x: x == name))))
        return F.struct(F.size(tokens).alias("len"), tf.alias("tf"))

    counts = store(docs.select(F.col(key).alias("id"), tx.let(tx.tokens(F.col(text)), counted).alias("c")))
    tf = [F.col("c.tf")[i] for i in range(len(terms))]
    stats = counts.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg("c.len"), F.lit(0.0)).alias("avgdl"),
        *[F.count_if(x > 0).alias(f"df{i}") for i, x in enumerate(tf)],
    )
    score = F.lit(0.0)
    for i, (_, qtf) in enumerate(terms):
        part = qtf * idf(F.col("n"), F.col(f"df{i}")) * weight(tf[i], F.col("c.len"), F.col("avgdl"))
        score = score + F.when(tf[i] > 0, part).otherwise(0.0)
    first = F.coalesce(*[F.when(x > 0, i) for i, x in enumerate(tf)])
    # stats is one row
    hits = counts.where(F.exists("c.tf", lambda x: x > 0))
    return hits.crossJoin(F.broadcast(stats)).select("id", score.alias("score"), first.alias("term_ord"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best with their 0-based rank; ties by the first matching query term, then by position (the id)."""
    order = [F.round("score", 9).desc(), F.col("term_ord"), F.col("id")]
    best = scores.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def bm25(docs: DataFrame, query: str, k: int = 50, key: str = "id", text: str = "document") -> DataFrame:
    """(id, score, term_ord, rank) of the k best documents."""
    return top_k(scan_scores(docs, query, key, text), k)


BROADCAST_TERMS = 1_000_000  # rows of (query, term); a longer list of queries joins by shuffling


def bm25_many(index: LexicalIndex, queries: DataFrame, k: int = 50, key: str = "qid", text: str = "query") -> DataFrame:
    """(qid, id, score, rank) of the k best documents of each query.

    Only the buckets of the queries' terms are read. While the queries have at most BROADCAST_TERMS terms, they are
    broadcast and postings stay where they are until their scores are summed.
    """
    stop = F.array(*[F.lit(w) for w in sorted(set(tx.STOPWORDS))])
    asked = store(
        queries.select(key, F.posexplode(F.filter(tx.tokens(F.col(text)), lambda t: ~F.array_contains(stop, t))).alias("ord", "term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("qtf"), F.min("ord").alias("ord"))
    )
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.collect_set(_bucket(F.col("term"))).alias("buckets")).first()
    small = F.broadcast if size["n"] <= BROADCAST_TERMS else (lambda df: df)
    weighted = index.terms.join(small(asked), "term").crossJoin(F.broadcast(index.corpus.select("n", "avgdl")))  # one row
    part = F.col("qtf") * idf(F.col("n"), F.col("df")) * weight(F.col("tf"), F.col("len"), F.col("avgdl"))
    scored = (
        index.postings.where(F.col("bucket").isin(size["buckets"]))
        .join(small(weighted), "term")
        .groupBy(key, "id")
        .agg(F.sum(part).alias("score"), F.min("ord").alias("term_ord"))
    )
    by = Window.partitionBy(key).orderBy(F.round("score", 9).desc(), "term_ord", "id")
    return scored.withColumn("rank", F.row_number().over(by) - 1).where(F.col("rank") < k).select(key, "id", "score", "rank")
