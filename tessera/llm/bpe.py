"""Byte-level BPE encoding and decoding; merges are chosen by a segment tree over byte positions."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import packed, text_of, unpacked

FAR = 1 << 60
FAN = 32


def load_ranks(path: str) -> dict[bytes, int]:
    """Reads a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: the leftmost pair of the smallest rank merges until no pair has a rank.

    Leaf i of the tree holds the rank of the pair that begins at byte i (FAR: none, or i begins no token); a node
    holds the least of its FAN children, so a short piece is one node. The root names the least rank, the way down
    its leftmost leaf. A merge kills the right token, so it changes the leaves of the merged token, of the token
    before it and of the dead one: three updates of logarithmic cost.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    leaves = [get(piece[i : i + 2], FAR) for i in range(n - 1)] + [FAR]
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    top, inner = levels[-1], levels[-2::-1] if len(levels) > 1 else ()
    while (least := min(top)) < FAR:
        left = top.index(least)
        for level in inner:
            left = level.index(least, left * FAN)
        dead = after[left]
        right = after[left] = after[dead]
        earlier = before[left]
        leaves[dead] = FAR
        if right < n:
            before[right] = left
            leaves[left] = get(piece[left : after[right]], FAR)
        else:
            leaves[left] = FAR
        if earlier >= 0:
            leaves[earlier] = get(piece[earlier:right], FAR)
        if inner:
            for i in {dead // FAN, left // FAN, max(earlier, 0) // FAN}:
                for below, level in zip(levels, levels[1:]):
                    level[i] = min(below[i * FAN : (i + 1) * FAN])
                    i //= FAN
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class Codec:
    """Encoder and decoder of one worker. The last short pieces are remembered, at most twice `remembered`."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = 400_000):
        import regex

        self.ranks, self.split, self.limit = ranks, regex.compile(pattern).findall, remembered
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older = self.known

    def piece(self, piece: str) -> tuple[str, bytes]:
        """The ids written down, and the bytes they decode to."""
        found = self.older.get(piece)
        if found is None:
            ids = merge(piece.encode("utf-8"), self.ranks)
            found = (" ".join(map(str, ids)), self.decode(ids))
        if len(piece) <= 64:
            if len(self.known) >= self.limit:
                self.older, self.known = self.known, {}
            self.known[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in merge(piece.encode("utf-8"), self.ranks)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        from hashlib import sha256

        get, piece = self.known.get, self.piece
        found = [get(p) or piece(p) for p in self.split(text)]
        ids = " ".join([x[0] for x in found])
        back = b"".join([x[1] for x in found])
        count = ids.count(" ") + 1 if found else 0
        return count, sha256(ids.encode()).hexdigest(), sha256(back).hexdigest()


_CODECS: dict[tuple[str, str], Codec] = {}


def shared_codec(spark: SparkSession, path: str, pattern: str) -> Callable[[], Codec]:
    """Gives each Python worker one codec. The ranks are broadcast; a vocabulary does not grow with the data."""
    ranks = spark.sparkContext.broadcast(load_ranks(path))

    def codec() -> Codec:
        if (path, pattern) not in _CODECS:
            _CODECS[path, pattern] = Codec(ranks.value, pattern)
        return _CODECS[path, pattern]

    return codec


def encode_texts(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """Adds (or replaces) the token ids of each whole text; a null text counts as empty."""
    codec = shared_codec(docs.sparkSession, path, pattern)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(codec().encode)

    return docs.withColumn(ids_col, ids(text_of(text_col)))


def decode_ids(docs: DataFrame, path: str, pattern: str, *, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """Adds (or replaces) the bytes that token ids stand for; null ids stay null."""
    codec = shared_codec(docs.sparkSession, path, pattern)

    @F.pandas_udf(T.BinaryType())
    def back(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else codec().decode(x))

    return docs.withColumn(text_col, back(F.col(ids_col)))


RESULT = ["n_tokens", "ids_sha256", "decoded_sha256"]


def round_trip(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Encodes each whole text, decodes the ids, and keeps the count and digests of both.

    A map without shuffle. Returned: the carried columns (default: all) with n_tokens, ids_sha256 and
    decoded_sha256, which replace input columns of such names. A null text counts as empty (0 tokens).
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    codec = shared_codec(docs.sparkSession, path, pattern)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        digest = codec().digest
        for texts in batches:
            yield pd.DataFrame([digest(t) for t in texts], columns=RESULT)

    rows = docs.select(packed(carry), digests(text_of(text_col)).alias("__d"))
    return rows.select(*unpacked(carry), *[F.col("__d")[c].alias(c) for c in RESULT])
