"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative of each group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import attach, cut, scratch, store
from tessera.llm.components import components

WAYS, DEPTH = 64, 10  # a cell splits into at most so many, so often; 65^10 paths fit a long
BROADCAST = 100_000  # sizes of cells, some 50 bytes each; more join by shuffling
CHUNK = 4096  # members of a cell that one task places at a time


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Unit centres; a cell that runs empty keeps its centre."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            total = x[nearest == c].sum(axis=0)
            size = np.linalg.norm(total)
            if size > 0:
                centres[c] = total / size
    return centres


def units(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def visits(x: np.ndarray, centres: np.ndarray, cosine: float) -> list[np.ndarray]:
    """The cells where each unit vector takes part: its own, first, and all later ones that can hold a partner.

    A partner in another cell lies beyond the plane through the origin between both centres, and within the angle:
    the vector's distance to that plane is at most the sine. Of two cells the vector of the earlier visits the later.
    """
    reach = np.sqrt(1 - cosine**2) + 1e-9
    near = x @ centres.T
    own = near.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    close = (near[np.arange(len(x)), own][:, None] - near) <= reach * gap[own] + 1e-12
    later = np.arange(len(centres))[None, :] > own[:, None]
    return [np.r_[o, np.flatnonzero(c)] for o, c in zip(own, close & later)]


def fit_cell(rows: pd.DataFrame, cosine: float, cell_rows: int, depth: int) -> pd.DataFrame:
    """Centres for a crowded cell from a sample of it; none if splitting would not save a third of the comparisons.

    Visitors are copies that travel, and each split copies the copies, so further splits must save that much more.
    """
    x = units(rows["vec"])
    cells = int(min(WAYS, len(x), rows["in_cell"][0] // cell_rows + 1))
    centres = spherical_kmeans(x, cells)
    found = visits(x, centres, cosine)
    members = np.bincount(np.concatenate(found), minlength=cells)
    living = np.bincount([f[0] for f in found], minlength=cells)
    cost = (members.astype(float) * living).sum() * (members.sum() / len(x) if depth else 1)
    worth = cost <= len(x) ** 2 * 2 / 3
    out = rows[["label", "dim", "cell", "in_cell"]].iloc[:1]
    return out.assign(centres=[centres.tobytes() if worth else b""])


def place(members: pd.DataFrame, model: pd.DataFrame, depth: int, cosine: float) -> pd.DataFrame:
    """Members in the cells below theirs, with a bit of `visitor` for the depth where they do not live; or as they are."""
    data = model["centres"].iloc[0] if len(model) else b""
    if not len(members) or not data:
        return members.drop(columns="chunk").assign(split=False)
    centres = np.frombuffer(data).reshape(-1, int(members["dim"].iat[0]))
    found = visits(units(members["vec"]), centres, cosine)
    at = np.repeat(np.arange(len(members)), [len(f) for f in found])
    out = members.drop(columns="chunk").iloc[at].reset_index(drop=True)
    guest = np.concatenate([np.arange(len(f)) > 0 for f in found])
    out["cell"] = out["cell"] * (WAYS + 1) + np.concatenate(found) + 1
    out["visitor"] = out["visitor"].to_numpy() | (guest.astype(np.int32) << depth).astype(np.int32)
    return out.assign(split=True)


def settled(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest position that links (a, b) reach, for each of n positions."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def spanning(linked: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what a tile of the matrix connects, one for each row and column; its rows start at `at`."""
    rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    dense, label = linked[np.ix_(rows, columns)], np.arange(len(rows))
    while len(rows):
        least = np.where(dense, label[:, None], len(rows)).min(axis=0)
        new = np.where(dense, least[None, :], len(rows)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return np.r_[rows + at, columns], np.r_[rows[label], rows[least]] + at
        label = new
    return rows, columns


def fitting(cosine: float, cell_rows: int, depth: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: fit_cell(rows, cosine, cell_rows, depth)


def placing(depth: int, cosine: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    return lambda members, model: place(members, model, depth, cosine)


def compare(block: pd.DataFrame, cosine: float, tile: int = 256) -> pd.DataFrame:
    """Links of one pair of blocks: for each vector that has any, their number (by weight) and one peer.

    The rows are at most two blocks; their products are formed a tile of rows at a time. Two visitors of the same depth
    are not compared (their own cells do that), and of two different blocks only pairs across count.
    """
    block = block.sort_values("uid", ignore_index=True)
    x, part, n = units(block["vec"]), block["part"].to_numpy(), len(block)
    visitor, weight, uid = (block[c].to_numpy() for c in ("visitor", "n", "uid"))
    across = block["i"][0] != block["j"][0]
    counts, ends = np.zeros(n, dtype=np.int64), [(np.zeros(0, dtype=int), np.zeros(0, dtype=int))]
    for lo in range(0, n, tile):
        mine = np.arange(lo, min(lo + tile, n))
        linked = x[mine] @ x.T >= cosine
        linked[np.arange(len(mine)), mine] = False
        some = linked.any(axis=0)
        if not some.any():
            continue
        linked &= (visitor[mine, None] & visitor[None, :]) == 0
        if across:
            linked &= part[mine, None] != part[None, :]
        counts[mine] = np.rint(linked[:, some].astype(float) @ weight[some].astype(float))
        if linked.any():
            ends.append(spanning(linked, lo))
    root = settled(*(np.concatenate(e) for e in zip(*ends)), n)
    found = np.flatnonzero(counts)
    return pd.DataFrame({"uid": uid[found], "links": counts[found], "peer": uid[root[found]]})


def cells_of(distinct: DataFrame, cosine: float, fit_rows: int, cell_rows: int, block_rows: int) -> DataFrame:
    """(label, dim, cell, uid, n, vec, visitor, in_cell): everyone in the cells where partners meet, each pair once.

    A label is one cell at first. Labels of more than cell_rows vectors split by spherical k-means, with centres
    fitted on about fit_rows of them, and cells of more than block_rows members again while that pays (`fit_cell`); a cell
    is placed by tasks of at most about CHUNK members, whatever its size.
    """
    spark, key = distinct.sparkSession, ["label", "dim", "cell"]
    kinds = {f.name: f.dataType.simpleString() for f in distinct.schema.fields}
    schema = f"label {kinds['label']}, dim int, cell long, uid long, n long, vec {kinds['vec']}, visitor int, in_cell long"

    def with_sizes(members: DataFrame) -> DataFrame:
        sizes = cut(members.groupBy(*key).agg(F.count(F.lit(1)).alias("in_cell")))
        if sizes.count() <= BROADCAST:
            return members.join(F.broadcast(sizes), key)
        return attach(members, sizes, key, "in_cell", members.count())

    members = distinct.select(
        "label", F.size("vec").alias("dim"), F.lit(0).cast("long").alias("cell"), "uid", "n", "vec", F.lit(0).alias("visitor")
    )
    done = []
    for depth in range(DEPTH + 1):
        crowded = F.col("in_cell") > (block_rows if depth else cell_rows)
        members = with_sizes(members)
        if depth == DEPTH or members.where(crowded).isEmpty():
            done.append(members)
            break
        done.append(members.where(~crowded))
        crowd = members.where(crowded)
        chosen = F.pmod(F.xxhash64("uid", F.lit(depth)), F.col("in_cell")) < fit_rows
        model = store(
            crowd.where(chosen).groupBy(*key).applyInPandas(
                fitting(cosine, cell_rows, depth), f"label {kinds['label']}, dim int, cell long, in_cell long, centres binary"
            )
        )
        chunks = F.ceil(F.col("in_cell") / F.lit(CHUNK)).cast("int")
        dealt = crowd.withColumn("chunk", F.pmod(F.xxhash64("uid", F.lit(-depth)), chunks).cast("int"))
        copies = model.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select(*key, "chunk", "centres")

        split = store(
            dealt.groupBy(*key, "chunk").cogroup(copies.groupBy(*key, "chunk")).applyInPandas(
                placing(depth, cosine), f"{schema}, split boolean"
            )
        )
        done.append(split.where("not split").drop("split"))
        members = split.where("split").drop("split", "in_cell")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def near_duplicate_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    fit_rows: int = 4096,
    cell_rows: int = 1024,
    block_rows: int = 8192,
) -> DataFrame:
    """Direct links and components of vectors with equal labels and a cosine of at least `cosine`.

    Equal vectors of a label become one with a weight. Every vector takes part in its own cell and in those that can
    hold a partner, so the search is exact whatever the centres are (`cells_of`); a cell that no split makes
    smaller, a dense ball, falls into blocks of about block_rows, and each pair of blocks is one group of at most about
    twice that many rows. Sums of links and the smallest id of a component are all that leaves a group.

    Returned, one row for each row: the id, n_links (other vectors linked directly, equal ones included),
    component_id (smallest id reachable, itself included), kept (id equals component_id). Vectors that are null, of
    length 0, all zero, or hold null or non-finite numbers, and null labels, link with nothing; so do vectors of
    different lengths. A null id reaches itself only as null and is kept when null is all its component has. Raises
    if chains of links are so long that components do not settle in 60 rounds.
    """
    vec = F.col("vec")
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    given = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    sound = F.forall(vec, finite) & F.exists(vec, lambda v: v != 0)
    rows = cut(
        vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), given.alias("vec"))
        .withColumn("ok", F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull())
        .withColumn("k1", F.xxhash64("vec"))
        .withColumn("k2", F.xxhash64("vec", F.lit("second")))
    )
    # equal vectors have equal hashes of 128 bits; labels tell the rest apart
    same = ["label", "k1", "k2"]
    lone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    with scratch(vectors.sparkSession):
        usable = rows.where("ok").select("id", *same)
        # the checkpoint fixes the numbers
        distinct = cut(
            rows.where("ok").groupBy(*same)
            .agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
            .withColumn("uid", F.monotonically_increasing_id())
        )
        members = cells_of(distinct, cosine, fit_rows, cell_rows, block_rows)
        parts = F.ceil(F.col("in_cell") / F.lit(block_rows)).cast("int")
        tasks = (
            members.withColumn("parts", parts)
            .withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("i", F.least("part", "other"))
            .withColumn("j", F.greatest("part", "other"))
            .drop("parts", "other", "in_cell")
        )
        compared = tasks.groupBy("label", "dim", "cell", "i", "j").applyInPandas(lambda b: compare(b, cosine), "uid long, links long, peer long")
        linked = cut(compared)
        roots = components(linked.select(F.col("uid").alias("a"), F.col("peer").alias("b")))
        counts = linked.groupBy(F.col("uid").alias("cuid")).agg(F.sum("links").alias("links"))
        whose = cut(
            distinct.join(roots, F.col("uid") == F.col("node"), "left")
            .join(counts, F.col("uid") == F.col("cuid"), "left")
            .select(*same, "n", "low", F.coalesce("root", "uid").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
        )
        least = cut(whose.groupBy("root").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("of_root")))
        whose = attach(whose, least, ["root"], "of_root", whose.count()).select(*same, "n", "links", "component")
        whose = cut(whose, outlive=True)
    found = attach(usable, whose, same, "n", usable.count()).select(
        "id", (F.col("links") + F.col("n") - 1).cast("long").alias("n_links"), "component"
    )
    return found.unionByName(lone).select(
        F.col("id").alias(id_col),
        "n_links",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
