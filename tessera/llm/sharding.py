"""Sharding by balanced label propagation: linked documents gather in shards that stay equally large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import attach, cut, ranked, text_of

SLICES = 64


def _requests(state: DataFrame, capacity: int, open_shards: list[int], turn: int, linked: int) -> DataFrame:
    """The state with, for each document that wants to move, where to (to), how much it gains (prio), its place (piece)."""
    counts = state.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct("n", F.xxhash64("hub", "shard", F.lit(turn)).alias("tie"), "shard")
    hubs = counts.groupBy("hub").agg(F.sort_array(F.collect_list(entry), asc=False).alias("held"), F.sum("n").alias("hub_n"))
    scattered = hubs.where(F.size("held") > 1)
    room_in = F.array(*[F.lit(s) for s in open_shards])
    wanted = F.greatest(F.ceil(F.col("hub_n") / F.lit(capacity)), F.lit(1)).cast("int")
    pulls = scattered.select(
        "hub",
        "hub_n",
        "held",
        F.slice(F.filter("held", lambda x: F.array_contains(room_in, x["shard"])), F.lit(1), wanted).alias("goals"),
    )
    moves = pulls.select("hub", "hub_n", "goals", F.explode("held").alias("own")).where(
        ~F.exists("goals", lambda g: g["shard"] == F.col("own.shard"))
    )
    better = F.filter("goals", lambda g: g > F.col("own"))
    moves = cut(
        moves.select(
            "hub",
            F.col("own.shard").alias("shard"),
            F.col("own.n").alias("own_n"),
            "hub_n",
            F.transform(better, lambda g: F.struct(g["shard"].alias("to"), (g["n"] - F.col("own.n")).alias("gain"))).alias("goals"),
        ).where(F.size("goals") > 0)
    )
    joined = attach(state, moves, ["hub", "shard"], "own_n", linked)
    goal = F.get("goals", F.pmod(F.xxhash64("h", F.lit(turn)), F.greatest(F.size("goals"), F.lit(1))).cast("int"))
    # a hub that is small against a shard moves as a whole, a large one in slices of its documents
    whole = F.col("hub_n") * SLICES <= capacity
    piece = F.when(whole, F.xxhash64("hub", F.lit(turn))).otherwise(F.xxhash64("h", F.lit(-turn)))
    return cut(
        joined.withColumn("goal", F.when(F.col("own_n").isNotNull(), goal)).select(
            *state.columns,
            F.col("goal.to").alias("to"),
            F.floor(F.log2(F.col("goal.gain") + 1)).cast("int").alias("prio"),
            F.when(F.col("goal").isNotNull(), piece).alias("piece"),
        )
    )


def grants_of(asked: dict[tuple[int, int, int], int], free: list[int]) -> dict[tuple[int, int, int], int]:
    """How many of the asked moves (from, to, prio) are granted, so that no shard exceeds its quota.

    Moves into free room come first, by gain; each leaves room behind. Then equal counts go around cycles of
    shards, exchanges between two first, until no cycle is left: full shards swap and keep their counts.
    """
    left, free, granted = dict(asked), list(free), {}
    ways = {}
    for way in sorted(asked, key=lambda w: -w[2]):
        ways.setdefault(way[:2], []).append(way)

    def grant(a: int, b: int, n: int) -> None:
        for way in ways[a, b]:
            k = min(n, left[way])
            left[way] -= k
            granted[way] = granted.get(way, 0) + k
            n -= k

    moved = True
    while moved:
        moved = False
        for a, b, prio in sorted(asked, key=lambda w: (-w[2], w[1], w[0])):
            k = min(left[a, b, prio], free[b])
            if k > 0:
                left[a, b, prio] -= k
                granted[a, b, prio] = granted.get((a, b, prio), 0) + k
                free[a], free[b], moved = free[a] + k, free[b] - k, True
    open_ways = lambda: {e: n for e, w in ways.items() if (n := sum(left[x] for x in w))}
    now = open_ways()
    for a, b in now:
        if a < b and (b, a) in now:
            k = min(now[a, b], now[b, a])
            grant(a, b, k), grant(b, a, k)
    while True:
        now = open_ways()
        nodes = {x for e in now for x in e}
        while ends := [x for x in nodes if not any(a == x and b in nodes for a, b in now)]:
            nodes -= set(ends)
        if not nodes:
            return {w: n for w, n in granted.items() if n}
        path = [min(nodes)]  # every node left has a way on, so the path comes back to itself
        while (step := max((b for a, b in now if a == path[-1] and b in nodes), key=lambda b: now[path[-1], b])) not in path:
            path.append(step)
        cycle = path[path.index(step) :] + [step]
        k = min(now[e] for e in zip(cycle, cycle[1:]))
        for a, b in zip(cycle, cycle[1:]):
            grant(a, b, k)


def shard_documents(
    docs: DataFrame,
    *,
    shards: int = 24,
    rounds: int = 60,
    id_col: str = "doc_id",
    text_col: str = "text",
    hub: Column | None = None,
) -> DataFrame:
    """Deals documents to shards whose row counts differ by at most one, keeping linked documents together.

    Documents with an equal, not null `hub` value are linked (default: equal texts), every one with every other.
    Linked documents start dealt out evenly over the room that shards have. In each round every hub names the shards
    where it is strongest and that have room (one, or as many as its size needs), and its documents elsewhere ask
    to move there. Requests are counted by (from, goal, gain), at most shards x shards x 40 numbers; each shard accepts
    the largest gains first while they fit its quota, and full shards exchange equal counts. Large hubs gather first, then the small ones in the room left;
    unlinked documents cut no edge, so they fill the shards up at the end. Rounds end early when nobody moves.
    Links are never expanded into pairs.

    Returned, one row for each row: the id, size (UTF-8 bytes + 8), text_crc32, law ('rows'), shard, slot (gapless
    in a shard), grown_shard (null: this law does not grow), linked. A null text has 0 bytes and crc 0 and equals
    the empty text; null ids and repeated rows are rows like others; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            (F.unhex(F.sha2(text, 256)) if hub is None else hub).alias("hub"),
        ).withColumn("h", F.xxhash64("id", "crc", F.when(F.col("id").isNull(), F.monotonically_increasing_id())))
    )
    total = rows.count()
    sizes = cut(
        rows.where("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    rows = cut(attach(rows, sizes, ["hub"], "n", total, nulls=True))
    buckets = min(4096, max(32, total // 50_000))
    names = ["id", "size", "crc", "h", "hub"]
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    capacity = max(1, total // shards)
    held = [0] * shards
    large = F.col("n") * 8 > capacity

    def deal(part: DataFrame) -> DataFrame:
        """Adds shard: a share of the rows for each shard in proportion to its room."""
        room, count = [q - n for q, n in zip(quota, held)], part.count()
        ends = [sum(room[: s + 1]) * count // max(1, sum(room)) for s in range(shards)]
        spans = spark.createDataFrame(list(zip(range(shards), [0, *ends], ends)), "shard int, lo long, hi long")
        rank = ranked(part.select(*names), [], ["h", "id"], "r", buckets)
        return rank.join(F.broadcast(spans), (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))).select(*names, "shard")

    def load(df: DataFrame) -> list[int]:
        found = {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()}
        return [found.get(s, 0) for s in range(shards)]

    settled = []
    for tier in (large, ~large):
        state = cut(deal(rows.where(F.col("n").isNotNull() & tier)))
        own = load(state)
        idle = 0
        for turn in range(1, rounds + 1):
            free = [q - h - n for q, h, n in zip(quota, held, own)]
            with_room = [s for s in range(shards) if free[s] > 0]
            # every other turn any shard may be named, as full shards exchange
            narrow = turn % 2 == 1 and bool(with_room)
            if not sum(own):
                break
            asking = _requests(state, capacity, with_room if narrow else list(range(shards)), turn, sum(own))
            counted = asking.where("to is not null").groupBy("shard", "to", "prio").count().collect()
            granted = grants_of({(r["shard"], r["to"], r["prio"]): r["count"] for r in counted}, free)
            if not granted:
                # ties fall another way each turn, so rounds end when several turns in a row grant nothing
                idle += 1
                if idle < 4:
                    continue
                break
            idle = 0
            # at most shards x shards x 40 rows
            grants = spark.createDataFrame([(*w, n) for w, n in granted.items()], "shard int, to int, prio int, most long")
            moving = ranked(asking.where("to is not null"), ["shard", "to", "prio"], ["piece"], "place", SLICES)
            moving = moving.join(F.broadcast(grants), ["shard", "to", "prio"], "left")
            moving = moving.select(*names, F.when(F.col("place") < F.col("most"), F.col("to")).otherwise(F.col("shard")).alias("shard"))
            state = asking.where("to is null").select(*names, "shard").unionByName(moving)
            state = cut(state)
            own = load(state)
        settled.append(state.withColumn("linked", F.lit(True)))
        held = [h + n for h, n in zip(held, own)]

    loose = deal(rows.where("n is null")).withColumn("linked", F.lit(False))
    dealt = cut(settled[0].unionByName(settled[1]).unionByName(loose))
    return ranked(dealt, ["shard"], ["h", "id"], "slot", buckets).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "linked",
    )
