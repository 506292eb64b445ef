"""Toxicity by weak supervision: many voters, a label model of their accuracies and correlations, a linear model."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut, fold, packed, text_of, unpacked
from tessera.llm.quality import _SPLIT, sampled_labels

#: Generic English insults: one voter that no label has touched.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "pathetic", "worthless", "disgusting", "trash", "clown")
LISTS = 6  # learned lexicons of each kind
KINDS = ("word", "stem4", "stem5")
VOTERS = 1 + LISTS * len(KINDS) + 2
HASHED = 1024  # buckets of the words that the linear model sees besides the lexicons' terms
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
RESULT = ["held_out", "score", "predicted"]


def plain(token: str) -> str:
    """A token (a run of anything but the contract's white space) as lexicons look at it."""
    return token.lower().strip(STRIP)


def units(word: str) -> list[tuple[str, str]]:
    """What lexicons look at in a word: the word itself and its first four and five letters."""
    return [("word", word), *[(f"stem{n}", word[:n]) for n in (4, 5) if len(word) > n]]


def learn_lexicons(sample: DataFrame, per_kind: int, precision: float, least: int) -> dict[tuple[str, str], int]:
    """Words and stems that occur almost only in documents labelled toxic, dealt to LISTS voters of each kind.

    Document frequencies are counted by Spark; at most per_kind terms of a kind come back.
    """

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, label in zip(b["__text"], b["__label"]):
                found = sorted({u for w in {plain(t) for t in _SPLIT(text)} if w for u in units(w)})
                yield pd.DataFrame(found, columns=["kind", "term"]).assign(label=label)

    top = Window.partitionBy("kind").orderBy(F.col("toxic").desc(), "term")
    found = (
        sample.mapInPandas(terms, "kind string, term string, label int")
        .groupBy("kind", "term")
        .agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n"))
        .where((F.col("toxic") >= least) & (F.col("toxic") >= precision * F.col("n")))
        .withColumn("i", F.row_number().over(top))
        .where(F.col("i") <= per_kind)
        .collect()
    )
    return {(r["kind"], r["term"]): 1 + KINDS.index(r["kind"]) * LISTS + crc32(r["term"].encode()) % LISTS for r in found}


class Voters:
    """What a text shows: its votes, which terms of the lexicons it has, its hashed words. Words are remembered."""

    def __init__(self, lexicons: dict[tuple[str, str], int], remembered: int = 300_000):
        self.voter_of = lexicons
        self.index = {term: i for i, term in enumerate(sorted(lexicons))}
        self.known: dict[str, int] = {}
        self.hits: dict[str, tuple[set[int], set[int]]] = {}
        self.long: list[str] = []
        self.limit = remembered

    def _look(self, token: str) -> int:
        """The token's bucket; tokens that hit a lexicon are kept as well."""
        word = plain(token)
        voters, terms = {0} if word in INSULTS else set(), set()
        for unit in units(word):
            if unit in self.voter_of:
                voters.add(self.voter_of[unit])
                terms.add(self.index[unit])
        if len(token) > 40:
            self.long.append(token)
        if voters:
            self.hits[token] = (voters, terms)
        self.known[token] = crc32(word.encode()) % HASHED
        return self.known[token]

    def __call__(self, text: str) -> tuple[np.ndarray, list[int], np.ndarray]:
        """The votes, the terms found, and the hashed words (distinct ones a bucket, over the root of all)."""
        tokens = set(_SPLIT(text))
        if len(self.known) >= self.limit:
            self.known.clear()
            self.hits.clear()
        known, look = self.known, self._look
        buckets = [b if (b := known.get(t)) is not None else look(t) for t in tokens]
        votes, terms, hits = np.zeros(VOTERS, dtype=bool), set(), 0
        for t in self.hits.keys() & tokens:
            hits += 1
            votes[list(self.hits[t][0])] = True
            terms |= self.hits[t][1]
        votes[VOTERS - 2] = hits >= 2  # pattern: several different hits
        votes[VOTERS - 1] = hits >= 1 and len(tokens) <= 40  # pattern: a hit in a short text
        hashed = np.bincount(np.array(buckets, dtype=np.int64), minlength=HASHED) / np.sqrt(max(1, len(tokens)))
        while self.long:
            token = self.long.pop()
            known.pop(token, None)
            self.hits.pop(token, None)
        return votes, sorted(terms), hashed.astype(np.float32)


def dependence(votes: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Mutual information of every two voters, given the class; weights are each row's shares of the classes."""
    total = np.zeros((votes.shape[1], votes.shape[1]))
    for w in weights:
        n = w.sum() + 2
        one = (w @ votes + 1) / n
        both = ((votes * w[:, None]).T @ votes + 2 * np.outer(one, one)) / n  # smoothed towards independence
        for a, b, joint in (
            (one, one, both),
            (one, 1 - one, one[:, None] - both),
            (1 - one, one, one[None, :] - both),
            (1 - one, 1 - one, 1 - one[:, None] - one[None, :] + both),
        ):
            joint = np.maximum(joint, 1e-12)
            total += w.mean() * joint * np.log(joint / np.outer(a, b))
    return total


def tree(information: np.ndarray, least: float) -> list[int]:
    """Parents of the maximum spanning forest (-1: none), grown from the first voter; edges under `least` are left out."""
    n = len(information)
    parent, best = [-1] * n, np.full(n, -1.0)
    source, left = [-1] * n, set(range(n))
    while left:
        at = max(sorted(left), key=lambda i: best[i])
        left.remove(at)
        if best[at] >= least:
            parent[at] = source[at]
        for i in left:
            if information[at, i] > best[i]:
                best[i], source[i] = information[at, i], at
    return parent


def label_model(
    votes: np.ndarray, prior: float, rounds: int = 60, least: float = 0.002, given: np.ndarray | None = None, trust: float = 0.95
) -> np.ndarray:
    """Posterior of the positive class for each row of votes; labels, if `given`, are one more voter.

    The generative model draws the class, then each voter given the class and one other voter: accuracies are the
    rates of firing in each class, correlations a tree of the voters that depend most on each other within the
    classes (so a copy of a voter adds nothing, and a cause of many voters counts once). Expectation maximisation
    starts from the labels, else from any vote; the tree is drawn anew every tenth round, voters are taken to be better
    than chance, and a voter's rates given its parent are smoothed towards its rate in the class.

    Labels are taken to be right at the rate `trust`, which is not learned: where the positive class has kinds that set
    off different voters, as each language has, the tree of the negative class can hold all kinds but one, and rates
    that follow the votes alone would take that one for the class.
    """
    v = votes.astype(float)
    likely = v.any(axis=1) if given is None else given > 0
    posterior = np.where(likely, 0.9, prior / 10)
    said = 0.0 if given is None else np.where(likely, 1, -1) * np.log(trust / (1 - trust))
    parent: list[int] = []
    for turn in range(rounds):
        if turn % 10 == 0:
            parent = tree(dependence(v, [posterior, 1 - posterior]), least)
        share = np.clip(posterior.mean(), 1e-3, 0.5)
        pos = np.clip((posterior @ v + 0.1) / (posterior.sum() + 1), 1e-3, 1 - 1e-3)
        neg = np.clip(((1 - posterior) @ v + 0.01) / ((1 - posterior).sum() + 1), 1e-5, pos)
        margin = np.full(len(v), np.log(share / (1 - share))) + said
        for i, j in enumerate(parent):
            odds = []
            for w, rate in ((posterior, pos[i]), (1 - posterior, neg[i])):
                if j < 0:
                    p = np.full(len(v), rate)
                else:
                    given = [((w * u) @ v[:, i] + 2 * rate) / ((w * u).sum() + 2) for u in (1 - v[:, j], v[:, j])]
                    p = np.where(v[:, j] > 0, given[1], given[0])
                p = np.clip(p, 1e-5, 1 - 1e-5)
                odds.append(np.where(v[:, i] > 0, np.log(p), np.log(1 - p)))
            margin += odds[0] - odds[1]
        posterior = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
    return posterior


def linear_model(x: np.ndarray, target: np.ndarray, rounds: int = 8, ridge: float = 0.3) -> np.ndarray:
    """Logistic weights (the last is the bias, without penalty) by Newton steps on soft labels."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * np.maximum(p * (1 - p), 1e-4)[:, None].astype(x.dtype)).T @ x
        w = w + np.linalg.solve(curve + np.diag(penalty), x.T @ (target - p) - penalty * w)
    return w


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    modulus: int = 4,
    held: int = 2,
    fit_rows: int = 8000,
    per_kind: int = 400,
    precision: float = 0.95,
    least: int = 4,
    threshold: float = 0.3,
) -> DataFrame:
    """Scores every whole text with a linear model trained on the label model's posteriors.

    At most `fit_rows` labelled rows outside the held-out fold are read, one for each id. Their labels choose which
    words and stems the learned lexicons hold (at most `per_kind` of a kind) and are one more voter of the label model;
    the voters' accuracies and correlations come from the votes, and the linear model learns the posteriors from the votes, the
    lexicons' terms and all words, hashed. Scoring is a map without shuffle.

    Returned, one row for each row: the carried columns (default: all) with held_out (crc32 of the id mod `modulus`
    equals `held`), score and predicted, which replace input columns of such names. A null text counts as empty.
    Without labels only the fixed list votes. A null id is hashed as the empty text.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    rows = docs.select(packed(carry), F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    named = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    sample = cut(sampled_labels(texts, named, "doc_id", "label", fit_rows, lambda c: fold(c, modulus) != held))
    lexicons = learn_lexicons(sample, per_kind, precision, least)
    lexicons |= {("word", w): 0 for w in INSULTS if ("word", w) not in lexicons}

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voters = Voters(lexicons)
        for b in batches:
            got = [voters(t) for t in b["__text"]]
            yield pd.DataFrame(
                {
                    "votes": [np.flatnonzero(g[0]).astype(np.int32) for g in got],
                    "terms": [g[1] for g in got],
                    "x": [g[2].tobytes() for g in got],
                    "label": b["__label"],
                }
            )

    seen = sample.mapInPandas(show, "votes array<int>, terms array<int>, x binary, label int").collect()
    seen.sort(key=lambda r: (r["votes"], r["terms"], bytes(r["x"]), r["label"]))
    width = len(lexicons)

    def matrix(found: list[list[int]], columns: int) -> np.ndarray:
        out = np.zeros((len(found), columns), dtype=np.float32)
        for i, r in enumerate(found):
            out[i, r] = 1
        return out

    if seen:
        votes = matrix([r["votes"] for r in seen], VOTERS)
        posterior = label_model(votes, prior=0.1, given=np.array([r["label"] for r in seen]))
        hashed = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in seen])
        weights = linear_model(np.hstack([matrix([r["terms"] for r in seen], width), votes, hashed]), posterior)
    else:
        weights = np.array([0.0] * width + [4.0] + [0.0] * (VOTERS - 1 + HASHED) + [-3.0])
    shared = docs.sparkSession.sparkContext.broadcast((lexicons, weights))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, w = shared.value
        voters = Voters(terms)
        of_votes, of_words = w[width : width + VOTERS], w[width + VOTERS : -1]
        for batch in batches:
            out = np.empty(len(batch))
            for i, t in enumerate(batch.tolist()):
                votes, found, hashed = voters(t)
                margin = w[found].sum() + of_votes @ votes + of_words @ hashed + w[-1]
                out[i] = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pd.Series(out)

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
