"""SimHash near-duplicates: fingerprints of whole texts, linked by pigeonring filtering."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import attach, cut, packed, text_of, unpacked
from tessera.llm.components import components

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
_SHIFTS = np.arange(64, dtype=np.uint64)
BITS, ALLOWED = 64, 3


def fingerprint(text: str, shingle: int) -> int:
    """Majority of the bits of the XXH64 (seed 42) of all word shingles; 0 without words."""
    # A-Z only: bytes.lower() leaves every byte of other characters alone
    words = _WORDS(text.encode("utf-8").lower())
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = starts[shingle:] + [at]
    hashes = np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, ends)], dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(hashes), 4096):
        part = np.unpackbits(hashes[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _SHIFTS[counts * 2 > len(hashes)]).sum(dtype=np.uint64))


#: Ring of 16 segments of 4 bits. A pair that differs in at most 3 bits has a start from which the first l segments
#: hold at most 3*l/16 differences, for every l: none in 5 segments (20 bits), 1 in 10, 2 in 15, 3 in all.
RING, SEGMENT, EXACT = 16, 4, 20
_BUDGETS = [(np.uint64(24), 1), (np.uint64(4), 2), (np.uint64(0), 3)]
SMALL, LEAF = 16, 256
LAST = 12


def on_the_chain(x: np.ndarray) -> np.ndarray:
    """Which differences (rotated so that the chain starts on top) keep to the budget after every segment."""
    keep = np.ones(len(x), dtype=bool)
    for shift, budget in _BUDGETS:
        at = np.flatnonzero(keep)
        keep[at] = np.bitwise_count(x[at] >> shift) <= budget
    return keep


def _blocks(left: list[int]) -> list[list[int]]:
    """Four even parts of the bits that are not known to be equal; at most 3 differences leave one part clean."""
    return [p.tolist() for p in np.array_split(np.array(left), ALLOWED + 1) if len(p)]


def spanning_links(group: np.ndarray, left: list[int]) -> list[tuple[int, int]]:
    """Links that connect what a group's linked pairs connect, without listing the pairs.

    `group` are distinct rotated fingerprints with equal bits outside `left`. A large group splits by one of four
    blocks of its remaining bits, which every linked pair shares at least once, until its parts are small; there a
    breadth-first walk takes each fingerprint once and compares it with those not yet reached.
    """
    if len(group) > LEAF and len(left) > ALLOWED + 1:
        found = []
        for block in _blocks(left):
            mask = np.uint64(sum(1 << b for b in block))
            order = np.argsort(group & mask, kind="stable")
            cuts = np.flatnonzero(np.diff((group & mask)[order])) + 1
            rest = [b for b in left if b not in set(block)]
            for part in np.split(group[order], cuts):
                if len(part) > 1:
                    found += spanning_links(part, rest)
        return found
    found, todo = [], group
    while len(todo) > 1:
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            at = queue.pop()
            near = on_the_chain(todo ^ at)
            found += [(int(at), int(x)) for x in todo[near]]
            queue += list(todo[near])
            todo = todo[~near]
    return found


def chain_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside a partition sorted by (key, rotated fingerprint); the low bits of key are rotation * 2^20 + the first 20 bits."""

    def rotated_back(key: np.ndarray, x: np.ndarray) -> np.ndarray:
        shift = (key >> EXACT & (RING - 1)).astype(np.uint64) * np.uint64(SEGMENT)
        back = (np.uint64(BITS) - shift) % np.uint64(BITS)
        return ((x << back) | (x >> shift)).view(np.int64) if len(x) else x.view(np.int64)

    def linked(key: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], dtype=int)
        sizes = np.diff(np.r_[starts, len(key)])
        ks, us, vs = [], [], []
        place = np.repeat(starts + sizes, sizes)  # where each row's group ends
        small = np.repeat(sizes <= SMALL, sizes)
        for d in range(1, int(min(SMALL, sizes.max(initial=1)))):
            at = np.flatnonzero(small[: len(key) - d] & (np.arange(len(key) - d) + d < place[: len(key) - d]))
            if not len(at):
                break
            at = at[on_the_chain(x[at] ^ x[at + d])]
            ks.append(key[at]), us.append(x[at]), vs.append(x[at + d])
        for g in np.flatnonzero(sizes > SMALL):
            got = spanning_links(x[starts[g] : starts[g] + sizes[g]], list(range(BITS - EXACT)))
            if got:
                pair = np.array(got, dtype=np.uint64)
                ks.append(np.full(len(pair), key[starts[g]])), us.append(pair[:, 0]), vs.append(pair[:, 1])
        if not ks:
            return pd.DataFrame({"a": np.array([], dtype=np.int64), "b": np.array([], dtype=np.int64)})
        k, u, v = np.concatenate(ks), np.concatenate(us), np.concatenate(vs)
        return pd.DataFrame({"a": rotated_back(k, u), "b": rotated_back(k, v)})

    held_key, held = np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
    for b in batches:
        key = np.r_[held_key, b["key"].to_numpy()]
        x = np.r_[held, b["turned"].to_numpy().view(np.uint64)]
        last = np.searchsorted(key, key[-1]) if len(key) else 0  # the last key may go on in the next batch
        held_key, held = key[last:], x[last:]
        yield linked(key[:last], x[:last])
    yield linked(held_key, held)


def split_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, turned, known: bits that the key's fingerprints share) under four new keys each.

    The unknown bits fall into four even blocks. A linked pair differs in at most three bits, so it agrees on one of
    the blocks at least and meets under that block's key.
    """
    for b in batches:
        key, x, known = (b[c].to_numpy().view(np.uint64) for c in ("key", "turned", "known"))
        low = key & np.uint64((RING << EXACT) - 1)
        for mask in np.unique(known):
            at = np.flatnonzero(known == mask)
            for block in _blocks([i for i in range(BITS - EXACT) if not int(mask) >> i & 1]):
                bits = np.uint64(sum(1 << i for i in block))
                path = (key[at] ^ (mask | bits)) * np.uint64(0x9E3779B97F4A7C15) + (x[at] & bits)
                path = (path ^ (path >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                new = (path >> np.uint64(29)) << np.uint64(EXACT + 4) | low[at]
                yield pd.DataFrame(
                    {"key": new.view(np.int64), "turned": x[at].view(np.int64), "known": np.full(len(at), mask | bits).view(np.int64)}
                )


def fingerprint_links(prints: DataFrame, crowd: int) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints `fp` at ALLOWED differing bits or fewer.

    Each goes to 16 keys, its rotation and the 20 bits of the first five segments there. Keys with more than `crowd`
    fingerprints split by further bits, again and again, so no task gets a crowd, whatever its size: at most 2^LAST
    fingerprints share all but LAST bits.
    """
    keys = F.array(
        *[
            F.struct(
                F.shiftrightunsigned(turned("fp", r * SEGMENT), BITS - EXACT).bitwiseOR(F.lit(r << EXACT)).alias("key"),
                turned("fp", r * SEGMENT).alias("turned"),
                F.lit(0).cast("long").alias("known"),
            )
            for r in range(RING)
        ]
    )
    dealt, found = prints.select(F.inline(keys)), None
    while True:
        # with fewer unknown bits a key cannot hold more, and three differences could touch every block
        open_keys = dealt.where(F.bit_count("known") <= BITS - EXACT - LAST)
        crowded = cut(open_keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd))
        none = crowded.isEmpty()
        tagged = dealt if none else attach(dealt, crowded, ["key"], "n", dealt.count())
        calm = tagged if none else tagged.where("n is null")
        links = calm.select("key", "turned").repartition("key").sortWithinPartitions("key", "turned").mapInPandas(chain_links, "a long, b long")
        found = links if found is None else found.unionByName(links)
        if none:
            return found
        dealt = cut(tagged.where("n is not null").select("key", "turned", "known").mapInPandas(split_keys, "key long, turned long, known long"))


def turned(name: str, by: int):
    """The fingerprint rotated left by some bits."""
    c = F.col(name)
    return F.shiftleft(c, by).bitwiseOR(F.shiftrightunsigned(c, BITS - by)) if by else c


def fingerprint_column(text, shingle: int):
    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return fingerprints(text)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, crowd: int = 4096
) -> DataFrame:
    """Fingerprint and component of each document: equal or similar texts, over any chain of links.

    Equal fingerprints are one from the start, so copies are never compared. Each distinct fingerprint goes to 16
    keys (its rotation and the 20 bits of the first five segments there); within a key the chain of segments is
    checked against its budgets, which includes the full Hamming check at its end. The chain theorem makes this
    exact: no link is lost, none is added.

    Returned, one row for each row: the id, fingerprint (hex), component_id (smallest id that links reach, nulls
    aside), row_key (hash of id and text), group (the component's smallest fingerprint as a number; unlike ids,
    which rows may share, it tells components apart). Null and empty texts and those of white space have fingerprint 0 and
    link like any other. Raises if chains of links are so long that components do not settle in 60 rounds.
    """
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            fingerprint_column(text_of(text_col), shingle).alias("fp"),
            F.xxhash64(F.col(id_col), text_of(text_col)).alias("row_key"),
        )
    )
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")))
    roots = components(fingerprint_links(prints, crowd))
    whose = cut(
        prints.join(roots, F.col("fp") == F.col("node"), "left").select(
            "fp", "low", "n", F.coalesce("root", "fp").alias("root")
        )
    )
    least = cut(whose.groupBy("root").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("prints")))
    whose = cut(attach(whose, least, ["root"], "prints", whose.count()).select("fp", "n", "component", "root"))
    return attach(rows, whose, ["fp"], "n", rows.count()).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
        "row_key",
        F.col("root").alias("group"),
    )


def drop_near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similarity: float | None = None
) -> DataFrame:
    """The documents without near-duplicates: of each component the smallest id stays, of its repetitions one row.

    Links are those of the fingerprints or, with a `similarity`, all pairs whose shingles have that Jaccard similarity.
    """
    if similarity is None:
        found = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle)
    else:
        from tessera.llm.set_join import similar_documents

        found = similar_documents(docs, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity)
    stay = found.groupBy("group").agg(
        F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "row_key")).alias("best")
    )
    stay = cut(stay.select(F.col("best.row_key").alias("__key")).distinct())
    names = docs.columns
    keyed = docs.select(packed(names), F.xxhash64(F.col(id_col), text_of(text_col)).alias("__key"))
    # repetitions of a row meet in a map-side aggregate before anything shuffles
    return keyed.dropDuplicates(["__key"]).join(stay, "__key", "left_semi").select(*unpacked(names))
