"""Quality scores by nearest-neighbour voting among latent-semantic vectors of labelled documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold, packed, text_of, unpacked

WORDS, SHAPES = 2048, 512  # hashed terms: words, and the shapes of words
TERMS = WORDS + SHAPES
RESULT = ["held_out", "score", "predicted"]
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+").findall
_RUNS = [(re.compile(p), r) for p, r in ((r"[^\W\d_a-z]*[A-ZÀ-ÖØ-Þ]+", "A"), (r"[^\W\d_A]+", "a"), (r"\d+", "0"), (r"(.)\1+", r"\1+"))]


def shape(word: str) -> str:
    """The word with runs of capitals, of other letters and of digits as one sign each, other runs marked."""
    if word.isalpha():
        return "a" if word.islower() else "A" if word.isupper() else "Aa"
    for run, sign in _RUNS:
        word = run.sub(sign, word)
    return word[:12]


class Terms:
    """Counts hashed terms of texts. Codes of words are remembered, a bounded number of them."""

    def __init__(self, remembered: int = 300_000):
        self.codes: dict[str, int] = {}
        self.limit = remembered

    def _code(self, word: str) -> int:
        code = crc32(word.lower().encode()) % WORDS * SHAPES + crc32(shape(word).encode()) % (SHAPES - 2)
        if len(word) <= 40:
            if len(self.codes) >= self.limit:
                self.codes.clear()
            self.codes[word] = code
        return code

    def row(self, text: str) -> np.ndarray:
        """One row of the term matrix: damped word counts of length 1, and root frequencies of shapes.

        Two more shapes tell how often a word repeats the one before, and how often it is new in the text.
        """
        out = np.zeros(TERMS, dtype=np.float32)
        words = _SPLIT(text)
        if not words:
            return out
        get = self.codes.get
        codes = np.array([c if (c := get(w)) is not None else self._code(w) for w in words])
        counts = np.log1p(np.bincount(codes // SHAPES, minlength=WORDS))
        out[:WORDS] = counts / np.linalg.norm(counts)
        shapes = np.bincount(codes % SHAPES, minlength=SHAPES).astype(float)
        shapes[SHAPES - 2] = (codes[1:] == codes[:-1]).sum()
        shapes[SHAPES - 1] = len(set(words))
        out[WORDS:] = 2 * np.sqrt(shapes / len(words))
        return out


def latent(x: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """Term loadings (terms x width) of the leading singular vectors, by randomised subspace iteration."""
    basis = np.random.default_rng(seed).standard_normal((x.shape[1], width)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, values, rows = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ rows.T).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def vote(queries: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int) -> np.ndarray:
    """Similarity-weighted mean label of each row's nearest known vectors; exact cosine products, in blocks."""
    similar = queries @ known.T
    k = min(neighbours, known.shape[0])
    at = np.argpartition(-similar, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(similar, at, axis=1), 0) ** 8 + 1e-9
    return (weight * labels[at]).sum(axis=1) / weight.sum(axis=1)


def sampled_labels(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, fit_rows: int, training) -> DataFrame:
    """Texts of at most fit_rows labelled rows with ids that `training` accepts, chosen by a hash of the id.

    Repeated labels of an id count as the largest, and of rows that share an id one teaches, so that no more come
    back; null ids and null labels teach nothing.
    """
    chosen = (
        labels.select(F.col(id_col).alias("__lid"), F.col(label_col).cast("int").alias("__label"))
        .where("__lid is not null and __label is not null")
        .where(training("__lid"))
        .groupBy("__lid")
        .agg(F.max("__label").alias("__label"))
        .orderBy(F.xxhash64("__lid"), "__lid")
        .limit(fit_rows)
    )
    # at most fit_rows rows of two numbers
    found = docs.select(F.col(id_col).alias("__lid"), text_of().alias("__text")).join(F.broadcast(chosen), "__lid")
    first = F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("t"), F.col("__label").alias("l")))
    return found.groupBy("__lid").agg(first.alias("m")).select(F.col("m.t").alias("__text"), F.col("m.l").alias("__label"))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    modulus: int = 5,
    held: int = 0,
    fit_rows: int = 6000,
    width: int = 32,
    neighbours: int = 15,
    threshold: float = 0.3,
) -> DataFrame:
    """Scores every whole text by the labels of its nearest labelled texts.

    At most `fit_rows` labelled rows outside the held-out fold are read (a bound on the fit, not on what is
    scored). Their terms give latent-semantic loadings; the labelled vectors (fit_rows x width floats) are
    broadcast, and every document's cosine with each of them is computed in blocks. No shuffle of documents.

    Returned: the carried columns (default: all) with held_out (crc32 of the id mod `modulus` equals `held`), score
    (0 to 1) and predicted, which replace input columns of such names. A null text counts as empty; texts without words score the mean label; without any label all
    score 1. A null id is hashed as the empty text.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    rows = docs.select(packed(carry), F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    named = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    sample = sampled_labels(docs, named, "doc_id", "label", fit_rows, lambda c: fold(c, modulus) != held)

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Terms()
        for b in batches:
            rows = [counter.row(t) for t in b["__text"]]
            at = [np.flatnonzero(r) for r in rows]
            yield pd.DataFrame(
                {"label": b["__label"], "at": [a.astype(np.int32) for a in at], "v": [r[a] for r, a in zip(rows, at)]}
            )

    known = sample.mapInPandas(terms, "label int, at array<int>, v array<float>").collect()
    known.sort(key=lambda r: (r["label"], r["at"], r["v"]))
    spark = docs.sparkSession
    if known:
        x = np.zeros((len(known), TERMS), dtype=np.float32)
        for i, r in enumerate(known):
            x[i, r["at"]] = r["v"]
        y = np.array([r["label"] for r in known], dtype=np.float32)
        loadings = latent(x, min(width, len(known)))
        model = (loadings, unit(x @ loadings), y, float(y.mean()))
        del x
    else:
        model = None
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Terms()
        for batch in batches:
            scores = np.ones(len(batch))
            if shared.value is None:
                yield pd.Series(scores)
                continue
            loadings, vectors, y, mean = shared.value
            texts = batch.tolist()
            for lo in range(0, len(texts), 256):
                x = np.stack([counter.row(t) for t in texts[lo : lo + 256]])
                got = vote(unit(x @ loadings), vectors, y, neighbours)
                scores[lo : lo + 256] = np.where(x.any(axis=1), got, mean)
            yield pd.Series(scores.clip(0, 1))

    return (
        rows.withColumn("__score", score("__text"))
        .withColumn("__out", fold("__id", modulus) == held)
        .select(
            *unpacked(carry),
            F.col("__out").alias("held_out"),
            F.col("__score").alias("score"),
            (F.col("__score") >= threshold).cast("int").alias("predicted"),
        )
    )
