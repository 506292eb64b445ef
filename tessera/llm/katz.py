"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, any order.

A token is scored by P(w|h), which falls back to the history without its first word, and in the end to one unknown
class. Counts never exist as one row a token: documents are coded into blocks of about two million tokens, and what
shuffles are a block's distinct grams, packed. The blocks are a bucketed table in the shared folder, so that answers
come to them and they never shuffle.

Grams and histories are told apart by 64-bit hashes, so all orders ask for their counts at once, and a hot history is
spread over all tasks like any other; sums over what follows a history are asked for in the same way, one order after
the other. `exchange` does both: everyone who asks about a hash learns the sums over all who did.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fold, new_path, release, store, text_of

CUTOFF = 5  # counts above it are not discounted
FAN_BITS = 8  # a node of the exchange hears at most about 2^FAN_BITS others and speaks to as many
BEGIN, END = b"\n<s>", b"\n</s>"  # no word can hold white space
BEGIN_HASH = np.uint64(xxhash.xxh64_intdigest(BEGIN, 42))
_RAW = 5  # the low bytes of differences between sorted hashes are noise, which does not deflate


def pack(values: np.ndarray) -> bytes:
    """Byte planes, deflated, in the smallest type: small numbers cost about their entropy."""
    flat = np.ascontiguousarray(values)
    if flat.dtype.kind != "f":
        flat = flat.astype(np.min_scalar_type(int(flat.max(initial=0))))
    planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, flat.itemsize).T)
    return flat.dtype.str[1:].encode() + zlib.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    """Floats as they were, whole numbers as int64."""
    kind = np.dtype(data[:2].decode())
    planes = np.frombuffer(zlib.decompress(data[2:]), dtype=np.uint8).reshape(kind.itemsize, -1)
    flat = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
    return flat if kind.kind == "f" else flat.astype(np.int64)


def pack_hashes(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the byte planes of their differences."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return planes[:_RAW].tobytes() + zlib.compress(planes[_RAW:].tobytes(), 1)


def unpack_hashes(data: bytes, n: int) -> np.ndarray:
    planes = np.empty((8, n), dtype=np.uint8)
    planes[:_RAW] = np.frombuffer(data[: _RAW * n], dtype=np.uint8).reshape(_RAW, n)
    planes[_RAW:] = np.frombuffer(zlib.decompress(data[_RAW * n :]), dtype=np.uint8).reshape(8 - _RAW, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


# ---- the exchange

ASK = "kind int, prefix long, grp int, node string, child string, n int, hashes binary, values array<binary>"
ANSWER = "kind int, prefix long, child string, values array<binary>, first binary, stats array<long>"


def node_name(kind: int, prefix: int, group: int) -> str:
    return f"{kind}/{prefix}/{group}"


def questions(kind: int, hashes: np.ndarray, values: list[np.ndarray], child: str, prefix: int, group: int, at: int, bits: int) -> list[tuple]:
    """A child's sorted hashes, which share their first `at` bits, in slices by the next `bits` bits; no empty ones."""
    part = (hashes >> np.uint64(64 - at - bits)).astype(np.int64) & ((1 << bits) - 1)
    border = np.searchsorted(part, np.arange((1 << bits) + 1))
    out = []
    for s in np.flatnonzero(np.diff(border)):
        lo, hi = border[s], border[s + 1]
        to = prefix << bits | int(s)
        packed = [pack(v[lo:hi]) for v in values]
        out.append((kind, to, group, node_name(kind, to, group), child, int(hi - lo), pack_hashes(hashes[lo:hi]), packed))
    return out


def heard(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """A node's questions by child, all different hashes, each question's place among them, who was first, the sums."""
    rows = rows.sort_values("child", ignore_index=True)
    hashes = np.concatenate([unpack_hashes(h, n) for h, n in zip(rows["hashes"], rows["n"])])
    own, at, place = np.unique(hashes, return_index=True, return_inverse=True)
    first = np.zeros(len(hashes), dtype=bool)
    first[at] = True
    sums = []
    for i in range(len(rows["values"][0])):
        v = np.concatenate([unpack(x[i]) for x in rows["values"]])
        total = np.bincount(place, weights=v, minlength=len(own))
        sums.append(total if v.dtype.kind == "f" else np.rint(total).astype(np.int64))
    return rows, own, place, first, sums


def replies(rows: pd.DataFrame, place: np.ndarray, first: np.ndarray, sums: list[np.ndarray]) -> list[tuple]:
    out, lo = [], 0
    for kind, prefix, child, n in zip(rows["kind"], rows["prefix"], rows["child"], rows["n"]):
        mine = place[lo : lo + n]
        packed = [pack(s[mine]) for s in sums]
        out.append((int(kind), int(prefix), child, packed, np.packbits(first[lo : lo + n]).tobytes(), None))
        lo += n
    return out


def settle(rows: pd.DataFrame) -> pd.DataFrame:
    """The last node for its hashes: answers, and for grams (kind above 0) their totals, types and counts of counts."""
    rows, _, place, first, sums = heard(rows)
    out = replies(rows, place, first, sums)
    kind = int(rows["kind"][0])
    if kind > 0:
        seen = sums[0][sums[0] > 0]
        out.append((kind, None, None, None, None, [int(seen.sum()), len(seen), *of_counts(seen)]))
    return pd.DataFrame(out, columns=["kind", "prefix", "child", "values", "first", "stats"]).astype({"prefix": "Int64"})


def pass_up(at: int, bits: int, groups: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        kind, prefix, group, node = rows["kind"].iat[0], rows["prefix"].iat[0], rows["grp"].iat[0], rows["node"].iat[0]
        _, own, _, _, sums = heard(rows)
        asked = questions(int(kind), own, sums, node, int(prefix), int(group) % groups, at, bits)
        return pd.DataFrame(asked, columns=["kind", "prefix", "grp", "node", "child", "n", "hashes", "values"])

    return combine


def collected(answers: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """One asker's answers put together in the order of its hashes."""
    answers = answers.sort_values("prefix")
    sums = [np.concatenate([unpack(v[i]) for v in answers["values"]]) for i in range(len(answers["values"].iat[0]))]
    sizes = [len(unpack(v[0])) for v in answers["values"]]
    bits = [np.unpackbits(np.frombuffer(f, dtype=np.uint8), count=n) for f, n in zip(answers["first"], sizes)]
    return sums, np.concatenate(bits).astype(bool)


def pass_down(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    rows, _, place, first, _ = heard(rows)
    sums, mine = collected(answers)
    out = replies(rows, place, first & mine[place], sums)
    return pd.DataFrame(out, columns=["kind", "prefix", "child", "values", "first", "stats"])


def fan(blocks: int) -> tuple[int, list[int]]:
    """Bits of a slice, and into how many groups the askers of a slice fall at each step; the last has one."""
    bits = min(FAN_BITS, max(1, math.ceil(math.log2(max(blocks, 16)))))
    groups = [math.ceil(blocks / (1 << bits)) or 1]
    while groups[-1] > 1:
        groups.append(math.ceil(groups[-1] / (1 << bits)))
    return bits, groups


def exchange(asked: DataFrame, bits: int, groups: list[int], tasks: int) -> DataFrame:
    """Answers to all questions, each with the sums over every asker of a hash, and whether this asker is its first.

    An asker speaks to at most 2^bits nodes and a node to as many, whatever the number of blocks: with more blocks the
    tree gets deeper, as nodes merge what they heard and pass it on, and answers come back the same way. Rows a block
    and the size of a task's group stay as they are.
    """
    keys = ["kind", "prefix", "grp"]
    by_node = lambda df: df.repartition(tasks, *keys).groupBy(*keys)
    heard_at = []
    for depth, more in enumerate(groups[1:], 1):
        asked = store(asked)
        heard_at.append(asked)
        asked = by_node(asked).applyInPandas(pass_up(depth * bits, bits, more), ASK)
    answers = store(by_node(asked).applyInPandas(settle, ANSWER))
    for table in reversed(heard_at):
        stats = answers.where("stats is not null")
        down = table.groupBy("node").cogroup(answers.where("stats is null").withColumnRenamed("child", "node").groupBy("node"))
        answers = store(down.applyInPandas(pass_down, ANSWER).unionByName(stats))
    return answers


# ---- the model


def discounts(of_counts: list[int]) -> np.ndarray:
    """Katz's ratios for counts 1..CUTOFF from the numbers of types seen 1..CUTOFF+1 times; 1 for higher counts.

    Where the estimate is not a proper discount (too little data), the count loses one half instead.
    """
    n = [0, *of_counts]
    ratio = np.ones(CUTOFF + 2)
    excess = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUTOFF + 1):
        good = n[r] and excess < 1
        value = ((r + 1) * n[r + 1] / (r * n[r]) - excess) / (1 - excess) if good else 0.0
        ratio[r] = value if 0 < value < 1 else (r - 0.5) / r
    return ratio


def discounted(counts: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    return counts * ratio[np.minimum(counts, CUTOFF + 1)]


def of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2].tolist()


def backoff_weights(spread: list[np.ndarray], lower: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Divisor and backoff weight of histories, so that each history's probabilities sum to one.

    spread: how many followers were seen 1..CUTOFF times, and the count of the rest; lower: the followers' summed
    lower-order probability. A history without discounted followers gets one more token in its divisor; so does one
    that was never seen, which leaves its whole mass to the lower order.
    """
    total, kept = spread[CUTOFF].astype(float), spread[CUTOFF].astype(float)
    for r in range(1, CUTOFF + 1):
        total = total + r * spread[r - 1]
        kept = kept + r * ratio[r] * spread[r - 1]
    divisor = np.where(kept < total, total, total + 1)
    return divisor, (1 - kept / divisor) / np.maximum(1 - lower, 1e-300)


class Counts:
    """Scalars of one order: tokens, types, the discounts."""

    def __init__(self, stats: list[int]):
        self.total, self.types, self.of_counts = stats[0], stats[1], stats[2:]
        self.ratio = discounts(self.of_counts)

    def empty_history(self) -> tuple[float, float]:
        """Divisor and backoff weight of the history without words, below which is one unknown class."""
        rest = self.total - sum(r * n for r, n in enumerate(self.of_counts[:CUTOFF], 1))
        spread = [np.array([n]) for n in self.of_counts[:CUTOFF]] + [np.array([rest])]
        divisor, weight = backoff_weights(spread, np.zeros(1), self.ratio)
        return float(divisor[0]), float(weight[0])


def mix(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of histories, each longer by a word."""
    x = (history ^ (history >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


BLOCK = "block long, ids array<string>, held array<boolean>, lengths binary, tokens binary, words binary"


def encode_blocks(batches: Iterator[pd.DataFrame], block_tokens: int) -> Iterator[pd.DataFrame]:
    """Blocks of whole documents: codes of words by their frequency in the block, and the words' hashes."""
    codes: dict[bytes, int] = {}
    ids, held, parts, size = [], [], [], 0

    def block() -> pd.DataFrame:
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in codes], dtype=np.uint64)
        tokens = np.concatenate(parts)
        by_frequency = np.argsort(-np.bincount(tokens, minlength=len(codes)), kind="stable")
        rank = np.empty(len(codes), dtype=np.int64)
        rank[by_frequency] = np.arange(len(codes))
        row = {
            "block": [uuid.uuid4().int >> 65],
            "ids": [ids],
            "held": [held],
            "lengths": [pack(np.array([len(p) for p in parts]))],
            "tokens": [pack(rank[tokens])],
            "words": [hashes[by_frequency].tobytes()],
        }
        return pd.DataFrame(row)

    for b in batches:
        for doc_id, out, text in zip(b["id"].tolist(), b["held"].tolist(), b["text"].tolist()):
            if not codes:
                codes[END] = 0
            # A-Z only, and exactly the six white space characters of the contract
            words = text.encode("utf-8").lower().split()
            ids.append(doc_id)
            held.append(bool(out))
            parts.append(np.array([codes.setdefault(w, len(codes)) for w in words] + [0], dtype=np.int32))
            size += len(parts[-1])
            if size >= block_tokens:
                yield block()
                codes, ids, held, parts, size = {}, [], [], [], 0
    if parts:
        yield block()


class Level:
    """A block's distinct grams of one length, sorted: where each token's is (of), their histories and shorter grams."""

    def __init__(self, grams: np.ndarray, of: np.ndarray):
        self.grams, self.of = grams, of

    def longer(self, words: np.ndarray, starts: np.ndarray, begin: np.uint64) -> Level:
        """The grams that are one word longer; begin is the history of a document's first word."""
        before = np.r_[self.of[:1], self.of[:-1]]
        before[starts] = len(self.grams)
        known = np.r_[self.grams, begin]
        grams, at, of = np.unique(mix(known[before], words), return_index=True, return_inverse=True)
        found = Level(grams, of)
        found.shorter = self.of[at]
        used = np.flatnonzero(np.bincount(before[at], minlength=len(known)))
        used = used[np.argsort(known[used])]
        place = np.empty(len(known), dtype=np.int64)
        place[used] = np.arange(len(used))
        found.histories, found.history_of = known[used], place[before[at]]
        return found


class Block:
    def __init__(self, row: pd.Series, order: int):
        self.lengths, self.held = unpack(row["lengths"]), np.array(row["held"], dtype=bool)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        codes, hashes = unpack(row["tokens"]), np.frombuffer(row["words"], dtype=np.uint64)
        by_hash = np.argsort(hashes)
        place = np.empty(len(hashes), dtype=np.int64)
        place[by_hash] = np.arange(len(hashes))
        self.levels, begin = [Level(hashes[by_hash], place[codes])], BEGIN_HASH
        for _ in range(1, order):
            self.levels.append(self.levels[-1].longer(hashes[codes], self.starts, begin))
            begin = mix(np.array([begin]), np.array([BEGIN_HASH]))[0]

    def trained(self, level: Level) -> np.ndarray:
        weight = np.repeat(~self.held, self.lengths)
        return np.rint(np.bincount(level.of, weights=weight, minlength=len(level.grams))).astype(np.int64)


def ask_grams(order: int, bits: int, groups: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, row in b.iterrows():
                block = Block(row, order)
                for k, level in enumerate(block.levels, 1):
                    asked = questions(k, level.grams, [block.trained(level)], str(row["block"]), 0, row["block"] % groups, 0, bits)
                    yield pd.DataFrame(asked, columns=["kind", "prefix", "grp", "node", "child", "n", "hashes", "values"])

    return ask


class Evaluated:
    """Probabilities of a block's grams, order by order: the answered counts, or the shorter gram's by backoff."""

    def __init__(self, block: Block, answers: pd.DataFrame, counts: list[Counts], order: int):
        self.block, self.totals, self.first = block, [], []
        for k in range(1, len(block.levels) + 1):
            (total,), first = collected(answers[answers["kind"] == k])
            self.totals.append(total)
            self.first.append(first)
        divisor, weight = counts[0].empty_history()
        self.p = np.where(self.totals[0] > 0, discounted(self.totals[0], counts[0].ratio) / divisor, weight)
        for k in range(2, order + 1):
            level, ratio, total = block.levels[k - 1], counts[k - 1].ratio, self.totals[k - 1]
            (*spread, lower), _ = collected(answers[answers["kind"] == -k])
            divisor, weight = backoff_weights(spread, lower, ratio)
            backed = weight[level.history_of] * self.p[level.shorter]
            self.p = np.where(total > 0, discounted(total, ratio) / divisor[level.history_of], backed)


def ask_histories(k: int, order: int, counts: list[Counts], bits: int, groups: int) -> Callable[..., pd.DataFrame]:
    """Each block reports, for its histories of order k, the followers of which it is the first asker."""

    def ask(_, row: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = row.iloc[0]
        block = Block(row, order)
        found, level = Evaluated(block, answers, counts, k - 1), block.levels[k - 1]
        total, mine = found.totals[k - 1], found.first[k - 1] & (found.totals[k - 1] > 0)
        n = len(level.histories)
        spread = [np.bincount(level.history_of[mine & (total == r)], minlength=n) for r in range(1, CUTOFF + 1)]
        often = mine & (total > CUTOFF)
        spread.append(np.rint(np.bincount(level.history_of[often], weights=total[often], minlength=n)).astype(np.int64))
        lower = np.bincount(level.history_of[mine], weights=found.p[level.shorter[mine]], minlength=n)
        asked = questions(-k, level.histories, [*spread, lower], str(row["block"]), 0, row["block"] % groups, 0, bits)
        return pd.DataFrame(asked, columns=["kind", "prefix", "grp", "node", "child", "n", "hashes", "values"])

    return ask


def score_block(order: int, counts: list[Counts]) -> Callable[..., pd.DataFrame]:
    def score(_, row: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = row.iloc[0]
        block = Block(row, order)
        found = Evaluated(block, answers, counts, order)
        count = found.totals[0][block.levels[0].of]
        base = np.log10((count + 0.5) / (counts[0].total + 0.5 * (counts[0].types + 1)))
        score = np.log10(found.p)[block.levels[-1].of]
        return pd.DataFrame(
            {
                "id": list(row["ids"]),
                "held_out": block.held,
                "n_tokens": block.lengths,
                "n_known": np.add.reduceat((count > 0).astype(np.int64), block.starts),
                "base_score": np.add.reduceat(base, block.starts),
                "score": np.add.reduceat(score, block.starts),
            }
        )

    return score


def tasks_for(rows: DataFrame, size: int) -> int:
    """The session's number of shuffle partitions, or more if the texts' bytes need them at this size each."""
    held = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(100_000, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), held // size))


def bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """df as a bucketed table in the shared folder: grouping by the column needs no shuffle. The catalog forgets it."""
    spark, name = df.sparkSession, f"tessera_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", new_path(spark)).bucketBy(buckets, by).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def score_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: Column | None = None,
    order: int = 2,
    block_tokens: int = 2_000_000,
) -> DataFrame:
    """Trains on the documents that are not held out (default: crc32 of the id mod 5 is 1) and scores all.

    Returned, one row for each row: the id, held_out, n_tokens, n_known (tokens seen in training), train_tokens,
    base_score (additive unigrams), score (log10 probability). A null text counts as empty and has the end token
    only; repeated rows count as rows; null ids are hashed as the empty text; an empty table gives an empty result.
    Ids travel as strings, so that none loses digits.
    """
    spark = docs.sparkSession
    held = fold(id_col, 5) == 1 if held_out is None else held_out
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), held.alias("held"), text_of(text_col).alias("text"))
    tasks = tasks_for(rows, 64 << 20)
    blocks = bucketed(rows.mapInPandas(lambda batches: encode_blocks(batches, block_tokens), BLOCK), "block", tasks)
    bits, groups = fan(blocks.count())
    answers = exchange(blocks.mapInPandas(ask_grams(order, bits, groups[0]), ASK), bits, groups, tasks)
    release(spark)
    sums = [F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(CUTOFF + 3)]
    by_kind = {r["kind"]: list(r[1:]) for r in answers.where("stats is not null").groupBy("kind").agg(*sums).collect()}
    counts = [Counts(by_kind.get(k, [0] * (CUTOFF + 3))) for k in range(1, order + 1)]

    def to_blocks(found: DataFrame) -> DataFrame:
        return found.where("stats is null").select(F.col("child").cast("long").alias("block"), "kind", "prefix", "values", "first")

    answers = to_blocks(answers)
    by_block = blocks.groupBy("block")
    for k in range(2, order + 1):
        asked = by_block.cogroup(answers.groupBy("block")).applyInPandas(ask_histories(k, order, counts, bits, groups[0]), ASK)
        answers = answers.unionByName(to_blocks(exchange(asked, bits, groups, tasks)))
        release(spark)
    scored = by_block.cogroup(answers.groupBy("block")).applyInPandas(
        score_block(order, counts),
        "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.select(
        F.col("id").cast(kind).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(counts[0].total).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
