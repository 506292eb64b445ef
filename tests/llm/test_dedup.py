import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm.embedding_dedup import near_duplicate_vectors, settled, spanning, spherical_kmeans, visits
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.simhash import chain_links, drop_near_duplicates, fingerprint_links, near_duplicates, spanning_links


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


# ---- exact


def brute_exact(rows):
    groups = {}
    for doc_id, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(key, []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for key, members in groups.items():
        members.sort()
        for i, (_, _, _, doc_id) in enumerate(members):
            out.append((doc_id, members[0][3], len(members), i == 0, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("support", [1 / 512, 1 / 5])
def test_exact_dedup(documents, support):
    random.seed(1)
    texts = ["", None, " \t", "a b", "ab", "a\nb ", "\x0b", "é b", "éb", "longer text " * 3000]
    rows = [(i, random.choice(texts)) for i in range(300)] + [(400 + i, "hot text") for i in range(200)]
    rows += [(None, "ab"), (None, None), (5, "hot text"), (5, "hot text"), (7, "same"), (7, "same"), (None, "n"), (None, "n")]
    got = exact_dedup(documents(rows), carry=["doc_id"], support=support)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_exact(rows)


def test_exact_dedup_repeated_winner_of_a_frequent_group(documents):
    got = exact_dedup(documents([(1, "hot")] * 50 + [(2, "hot")] * 50), carry=["doc_id"], support=0.3).collect()
    assert len(got) == 100 and sum(r["kept"] for r in got) == 1


def test_exact_dedup_null_ids_of_one_frequent_text(documents):
    rows = [(None, "hot")] * 200 + [(2**53 + 1, "cold"), (None, "cold"), (2**53 + 3, "other")]
    got = exact_dedup(documents(rows), carry=["doc_id"]).collect()
    assert sum(r["kept"] for r in got if r["group_size"] == 200) == 1
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in got if r["doc_id"]) == [(2**53 + 1, 2**53 + 1, True), (2**53 + 3, 2**53 + 3, True)]


def test_exact_dedup_clashing_names_and_empty(documents, clashing):
    got = exact_dedup(clashing(documents([(1, "a"), (2, "a ")])))
    assert [(r["doc_id"], r["hub"], r["fp"]) for r in got.where("kept").collect()] == [(2, "x", "x")]
    assert exact_dedup(documents([(1, "a")]).limit(0)).count() == 0


# ---- SimHash


def brute_fingerprint(text, shingle=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_simhash(documents, rows):
    got = {r["doc_id"]: r for r in near_duplicates(documents(rows)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = sorted(prints)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {i: r["component_id"] for i, r in got.items()} == components(ids, links)
    return links


def test_simhash(documents):
    random.seed(3)
    pool = [f"w{i}" for i in range(60)] + ["Ünï", "ÀB", "İ"]
    base = [" ".join(random.choices(pool, k=random.randrange(1, 250))) for _ in range(60)]
    near = []
    for t in base[:30]:
        words = t.split()
        words[random.randrange(len(words))] = "Edited"
        near.append(" ".join(words))
    texts = base + near + base[:5] + ["", None, " \t\n", "One", "one two", "ONE\x0bTWO", "x" * 50_000, "long words " * 20_000]
    assert check_simhash(documents, list(enumerate(texts)))


def test_links_of_fingerprints_against_all_pairs():
    """Dense balls, sparse noise, and group sizes on both sides of the limits; also split over batches."""
    import pandas as pd

    rng = np.random.default_rng(4)
    prints = {0}
    for _ in range(4):
        centre = int(rng.integers(0, 2**63))
        for _ in range(400):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            prints.add(x)
    prints |= {int(x) for x in rng.integers(0, 2**63, 300)}
    all_prints = np.array(sorted(prints), dtype=np.uint64)
    rows = []
    for r in range(16):
        s = np.uint64(4 * r)
        turned = (all_prints << s) | (all_prints >> (np.uint64(64) - s)) if r else all_prints
        rows.append(pd.DataFrame({"key": (turned >> np.uint64(44)).astype(np.int64) | (r << 20), "turned": turned.view(np.int64)}))
    table = pd.concat(rows)
    table = table.sort_values(["key", "turned"], ignore_index=True)
    batches = [table.iloc[i : i + 97] for i in range(0, len(table), 97)]
    found = pd.concat(chain_links(iter(batches)))
    pairs = list(zip(found["a"].to_numpy().view(np.uint64).tolist(), found["b"].to_numpy().view(np.uint64).tolist()))
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    nodes = all_prints.tolist()
    want = [(a, nodes[i + 1 + j]) for i, a in enumerate(nodes) for j in np.flatnonzero(np.bitwise_count(all_prints[i + 1 :] ^ np.uint64(a)) <= 3)]
    assert components(nodes, pairs) == components(nodes, want)


@pytest.mark.parametrize("crowd", [4096, 30, 3])
def test_crowded_keys_split(spark, crowd):
    """A third of all fingerprints share 20 bits in every rotation that holds the noise; links stay exact."""
    rng = np.random.default_rng(6)
    noise = np.unique(rng.integers(0, 2**18, 900).astype(np.uint64))
    prints = np.unique(np.r_[noise, rng.integers(0, 2**63, 600).astype(np.uint64), noise[:50] ^ np.uint64(1 << 60)])
    table = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in fingerprint_links(table, crowd).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    nodes = prints.tolist()
    want = [(a, nodes[i + 1 + j]) for i, a in enumerate(nodes) for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ np.uint64(a)) <= 3)]
    assert components(nodes, pairs) == components(nodes, want)


def test_large_groups_split(monkeypatch):
    import tessera.llm.simhash as module

    monkeypatch.setattr(module, "LEAF", 20)
    rng = np.random.default_rng(8)
    group = np.unique(rng.integers(0, 2**12, 600).astype(np.uint64))
    links = spanning_links(group, list(range(44)))
    nodes = group.tolist()
    got = components(nodes, links)
    # a chain starts at the top bits, so only pairs on this rotation's chain count
    want = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if module.on_the_chain(np.array([a ^ b], dtype=np.uint64))[0]]
    assert got == components(nodes, want)


def test_near_duplicates_keep_large_ids_beside_nulls(documents):
    rows = [(2**53 + 1, "one two three"), (None, "one two three"), (2**53 + 3, "ONE two three"), (None, None), (None, None)]
    got = near_duplicates(documents(rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(2**53 + 1, 2**53 + 1), (2**53 + 3, 2**53 + 1)]
    assert len(got) == 5 and len({r["fingerprint"] for r in got}) == 2


def test_drop_near_duplicates(documents, clashing):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(3, text), (1, text + " more"), (2, "something else entirely"), (9, None), (8, ""), (2, "another thing"), (7, text), (7, text)]
    kept = drop_near_duplicates(clashing(documents(rows)))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, text + " more"), (2, "another thing"), (2, "something else entirely"), (8, "")])
    assert drop_near_duplicates(documents(rows).limit(0)).count() == 0


# ---- embeddings


def check_vectors(spark, rows, **options):
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), **options).collect()
    sound = {}
    for i, v, l in rows:
        if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(np.float64)
            sound[i] = (x / np.linalg.norm(x), l)
    ids = [r[0] for r in rows]
    ok = lambda a, b: a in sound and b in sound and sound[a][1] == sound[b][1] and len(sound[a][0]) == len(sound[b][0]) and sound[a][0] @ sound[b][0] >= 0.98
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if ok(a, b)]
    count = {i: 0 for i in ids}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    root = components(ids, links)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (count[i], root[i], root[i] == i) for i in ids}
    return links


@pytest.mark.parametrize(("cell_rows", "block_rows"), [(1024, 1024), (8, 16)])
def test_vectors(spark, cell_rows, block_rows):
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for _ in range(25):
        centre, label = rng.standard_normal(8), int(rng.integers(0, 2))
        for _ in range(12):
            rows.append((i, [float(x) for x in (centre + 0.08 * rng.standard_normal(8)).astype(np.float32)], label))
            i += 1
    hot = rows[0][1]
    for bad in (None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None] * 4, [float("inf")] + [1.0] * 7, hot[:4], hot, hot, [2 * x for x in hot]):
        rows.append((i, bad, 0))
        i += 1
    rows.append((i, hot, None))
    assert check_vectors(spark, rows, cell_rows=cell_rows, block_rows=block_rows)


def test_one_label_holds_nearly_all(spark):
    """A hot label splits like any other: loose vectors, a chain, and a dense ball that no split makes smaller."""
    rng = np.random.default_rng(12)
    loose = rng.standard_normal((400, 16))
    angles = np.arange(60) * 0.15
    chain = np.zeros((60, 16))
    chain[:, 0], chain[:, 1] = np.cos(angles), np.sin(angles)
    ball = rng.standard_normal(16) + 0.02 * rng.standard_normal((150, 16))
    vectors = np.r_[loose, chain, ball].astype(np.float32)
    rows = [(int(i), [float(x) for x in v], 0) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    rows += [(1000 + i, rows[i][1], 1) for i in range(6)]
    assert len(check_vectors(spark, rows, cell_rows=40, block_rows=32, fit_rows=100)) > 150 * 149 / 2


def test_visits_hold_every_partner():
    rng = np.random.default_rng(13)
    x = rng.standard_normal((2000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.03 * rng.standard_normal(x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    centres = spherical_kmeans(x, 40)
    here, there = visits(x, centres, 0.98), visits(y, centres, 0.98)
    pairs = np.flatnonzero((x * y).sum(axis=1) >= 0.98)
    assert len(pairs) > 500 and any(here[i][0] != there[i][0] for i in pairs)
    for i in pairs:
        low, high = (here[i], there[i]) if here[i][0] <= there[i][0] else (there[i], here[i])
        assert high[0] in low


def test_spanning_links_keep_components():
    rng = np.random.default_rng(14)
    for n in (1, 30, 200):
        matrix = rng.random((n, n)) < 1.2 / n
        matrix |= matrix.T
        np.fill_diagonal(matrix, False)
        ends = [spanning(matrix[lo : lo + 16], lo) for lo in range(0, n, 16)]
        a, b = (np.concatenate(e).astype(int) for e in zip(*ends))
        assert settled(a, b, n).tolist() == list(components(range(n), np.argwhere(matrix).tolist()).values())


def test_vectors_empty_and_repeated(spark):
    large = [(2**53 + 1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2**53 + 3, [0.0, 1.0], 0)]
    found = near_duplicate_vectors(spark.createDataFrame(large, "vec_id long, embedding array<float>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == {2**53 + 1: (1, 2**53 + 1), None: (1, 2**53 + 1), 2**53 + 3: (0, 2**53 + 3)}
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [0.0, 1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, near_duplicate_vectors(table).collect()), key=repr)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]
    assert near_duplicate_vectors(table.limit(0)).count() == 0
    assert near_duplicate_vectors(table.where("vec_id is null").selectExpr("vec_id", "cast(null as array<float>) embedding", "label")).count() == 1
