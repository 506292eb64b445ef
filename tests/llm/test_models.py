import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import katz, quality
from tessera.llm.quality import sampled_labels, score_quality
from tessera.llm.toxicity import INSULTS, label_model, score_toxicity

WORDS = "lorem ipsum dolor sit amet elit sed magna aliqua erat nulla vita".split()


def crc(i):
    return zlib.crc32(str("" if i is None else i).encode())


@pytest.fixture
def corpus(documents, spark):
    """Clean prose, junk of one repeated word, and prose with insults; odd cases at the end."""
    random.seed(6)
    rows, labels = [], []
    for i in range(400):
        words = random.choices(WORDS, k=random.randrange(10, 60))
        junk, toxic = i % 6 == 0, i % 9 == 1
        if junk:
            words = [words[0]] * 20 + [words[1]] * 20
        if toxic:
            for _ in range(3):
                words.insert(random.randrange(len(words)), random.choice(["idiot", "zorgluxian", "zorgluxoid", "bramble!"]))
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(not junk), int(toxic)))
        elif i % 4 == 0:
            labels += [(i, int(not junk), int(toxic))] * 2
    rows += [(400, ""), (401, None), (None, "lorem ipsum"), (403, "word " * 30_000), (5, rows[5][1]), (404, "\t \n")]
    labels += [(401, None, None), (None, 1, 0), (999, 1, 1)]
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_quality(corpus, clashing):
    docs, labels, rows = corpus
    got = score_quality(clashing(docs, "predicted", "__score"), labels, carry=["doc_id", "text", "h"]).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert sum(r["predicted"] == int(r["doc_id"] % 6 != 0) for r in held) >= 0.95 * len(held)
    assert score_quality(docs.limit(0), labels).count() == 0
    assert all(r["score"] == 1 for r in score_quality(docs, labels.limit(0), carry=["doc_id"]).collect())


def test_toxicity(corpus, clashing):
    docs, labels, rows = corpus
    got = score_toxicity(clashing(docs), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert sum(r["predicted"] == int(r["doc_id"] % 9 == 1) for r in held) >= 0.95 * len(held)
    assert score_toxicity(docs.limit(0), labels).count() == 0
    plain = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, labels.limit(0)).collect()}
    texts = dict(rows)
    assert all(plain[i] == int("idiot" in (texts[i] or "")) for i in range(400))


def test_ids_keep_their_digits_beside_nulls(documents, spark):
    rows = [(2**53 + 1, "lorem ipsum dolor"), (None, "sit amet"), (2**53 + 3, "idiot"), (2**53 + 1, "elit sed")]
    labels = spark.createDataFrame([(2**53 + 1, 1, 0), (2**53 + 3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    want = sorted((i for i, _ in rows), key=repr)
    docs = documents(rows, 1)
    for found in (score_quality(docs, labels, carry=["doc_id"]), score_toxicity(docs, labels, carry=["doc_id"]), katz.score_documents(docs)):
        got = found.collect()
        assert sorted((r["doc_id"] for r in got), key=repr) == want
        assert all(r["held_out"] in (True, False) for r in got)


def test_repeated_ids_teach_once(documents, spark):
    """A third of the rows share one labelled id: one of them is read."""
    rows = [(1, f"text {i}") for i in range(100)] + [(2, "a"), (3, "b")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1)] * 3, "doc_id long, quality int")
    found = sampled_labels(documents(rows), labels, "doc_id", "quality", 10, lambda c: F.lit(True)).collect()
    assert len(found) == 3 and sorted(r["__label"] for r in found) == [0, 1, 1]


def brute_vote(query, known, labels, neighbours):
    cos = lambda a, b: math.fsum(x * y for x, y in zip(a, b)) / (math.sqrt(math.fsum(x * x for x in a) * math.fsum(x * x for x in b)) or 1)
    near = sorted(((cos(query, k), y) for k, y in zip(known, labels)), key=lambda n: -n[0])[:neighbours]
    weights = [max(c, 0) ** 8 + 1e-9 for c, _ in near]
    return sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights)


def test_quality_against_brute_force(corpus):
    """Every score is the vote of the nearest labelled vectors, by plain loops over the same loadings."""
    docs, labels, rows = corpus
    named = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None and crc(r["doc_id"]) % 5:
            named[r["doc_id"]] = max(named.get(r["doc_id"], 0), r["quality"])
    counter = quality.Terms()
    known = sorted((named[i], counter.row(t or "").tolist()) for i, t in dict(rows).items() if i in named)
    x = np.array([k for _, k in known], dtype=np.float32)
    # the operator sorts its rows by label and nonzero terms; singular vectors do not depend on the order but for signs
    loadings = quality.latent(x, min(32, len(known)))
    vectors, y = (x @ loadings).tolist(), [k for k, _ in known]
    got = {r["text"]: r["score"] for r in score_quality(docs, labels).collect()}
    close = 0
    for _, text in rows:
        v = (counter.row(text or "") @ loadings).tolist()
        want = brute_vote(v, vectors, y, 15) if any(v) else sum(y) / len(y)
        close += abs(got[text] - want) < 0.02
    assert close >= 0.98 * len(rows)  # neighbours at a tie may differ


def test_vote_against_brute_force():
    rng = np.random.default_rng(3)
    known, labels, queries = rng.standard_normal((40, 6)), rng.integers(0, 2, 40).astype(float), rng.standard_normal((25, 6))
    got = quality.vote(quality.unit(queries), quality.unit(known), labels, 7)
    assert got == pytest.approx([brute_vote(q.tolist(), known.tolist(), labels.tolist(), 7) for q in queries])


def brute_label_model(votes, prior, rounds, least):
    """The same model in plain Python: dictionaries of counts, Prim's algorithm, no matrices."""
    n, m = len(votes), len(votes[0])
    post = [0.9 if any(v) else prior / 10 for v in votes]
    parent = []
    for turn in range(rounds):
        classes = [post, [1 - p for p in post]]
        if turn % 10 == 0:
            info = [[0.0] * m for _ in range(m)]
            for w in classes:
                total = sum(w) + 2
                one = [(sum(w[r] * votes[r][i] for r in range(n)) + 1) / total for i in range(m)]
                for i in range(m):
                    for j in range(m):
                        both = (sum(w[r] * votes[r][i] * votes[r][j] for r in range(n)) + 2 * one[i] * one[j]) / total
                        for a, b, joint in ((one[i], one[j], both), (one[i], 1 - one[j], one[i] - both), (1 - one[i], one[j], one[j] - both), (1 - one[i], 1 - one[j], 1 - one[i] - one[j] + both)):
                            joint = max(joint, 1e-12)
                            info[i][j] += sum(w) / n * joint * math.log(joint / (a * b))
            parent, best, source, left = [-1] * m, [-1.0] * m, [-1] * m, list(range(m))
            while left:
                at = max(left, key=lambda i: best[i])
                left.remove(at)
                if best[at] >= least:
                    parent[at] = source[at]
                for i in left:
                    if info[at][i] > best[i]:
                        best[i], source[i] = info[at][i], at
        share = min(max(sum(post) / n, 1e-3), 0.5)
        margins = [math.log(share / (1 - share))] * n
        for i, j in enumerate(parent):
            rates = [(sum(p * v[i] for p, v in zip(post, votes)) + 0.1) / (sum(post) + 1), 0.0]
            rates[0] = min(max(rates[0], 1e-3), 1 - 1e-3)
            rates[1] = min(max((sum((1 - p) * v[i] for p, v in zip(post, votes)) + 0.01) / (n - sum(post) + 1), 1e-5), rates[0])
            for r, v in enumerate(votes):
                for sign, w, rate in ((1, classes[0], rates[0]), (-1, classes[1], rates[1])):
                    p = rate
                    if j >= 0:
                        same = [q for q in range(n) if votes[q][j] == v[j]]
                        p = (sum(w[q] * votes[q][i] for q in same) + 2 * rate) / (sum(w[q] for q in same) + 2)
                    p = min(max(p, 1e-5), 1 - 1e-5)
                    margins[r] += sign * math.log(p if v[i] else 1 - p)
        post = [1 / (1 + math.exp(-min(max(x, -30), 30))) for x in margins]
    return post


def test_label_model_against_brute_force():
    rng = np.random.default_rng(5)
    truth = rng.random(90) < 0.3
    votes = np.stack([rng.random(90) < np.where(truth, a, b) for a, b in ((0.7, 0.1), (0.6, 0.05), (0.8, 0.2))], axis=1)
    votes = np.hstack([votes, votes[:, :1] ^ (rng.random((90, 1)) < 0.1)])
    for rounds in (1, 12):
        got = label_model(votes, 0.2, rounds, 0.002)
        assert got == pytest.approx(brute_label_model(votes.astype(int).tolist(), 0.2, rounds, 0.002), abs=1e-6)


def test_label_model_finds_classes_without_labels():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.1
    rates = [(0.6, 0.01), (0.5, 0.02), (0.4, 0.005), (0.7, 0.03)]
    votes = np.stack([rng.random(4000) < np.where(truth, a, b) for a, b in rates], axis=1)
    votes = np.hstack([votes, votes[:, :1]])  # one voter repeats another
    right = lambda guess: (guess == truth).mean()
    assert right(label_model(votes, 0.1) > 0.5) > max([right(votes.any(axis=1)), *(right(v) for v in votes.T)]) + 0.01


def test_linear_model_sees_words_that_no_voter_knows(documents, spark):
    """A word in half of the labelled toxic texts, in too few clean ones to matter, weighs even where no voter fires."""
    random.seed(10)
    rows, labels = [], []
    for i in range(600):
        words, toxic = random.choices(WORDS, k=20), i % 4 == 1
        if toxic:
            words[3:5] = [random.choice(["idiot", "moron"]), "grubly"]
        elif i % 8 == 0:
            words[3] = "grubly"  # too often clean for a lexicon
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, " ".join(WORDS + ["grubly"])), (1001, " ".join(WORDS))]
    got = {r["doc_id"]: r["score"] for r in score_toxicity(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[1000] > got[1001]


def test_kinds_of_toxic_texts_that_set_off_different_voters(documents, spark):
    """Insults on one hand, made-up words of a few stems in three other languages on the other: all are toxic."""
    random.seed(11)
    ends = ["schaft", "ung", "ei", "an", "te", "isch", "ando", "aire", "mo", "ille", "or", "ux"]
    stems = [["lowei", "lostra"], ["vequ", "veju"], ["chlla"]]
    rows, labels = [], []
    for i in range(2400):
        words = random.choices(WORDS, k=60)
        if i % 8 == 1:
            words[5:10] = random.choices(INSULTS, k=5)
        elif i % 16 == 2:
            words[5:20] = [random.choice(stems[i // 16 % 3]) + random.choice(ends) + random.choice(ends) for _ in range(15)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 8 == 1 or i % 16 == 2)))
    found = score_toxicity(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    assert {r["predicted"] == dict(labels)[r["doc_id"]] for r in found} == {True}


def test_label_model_keeps_all_kinds_and_sees_wrong_labels():
    rng = np.random.default_rng(3)
    kind = rng.choice(5, size=4000, p=[0.9, 0.05, 0.02, 0.02, 0.01])  # 0 is the negative class
    rates = np.vstack([np.zeros(12), np.r_[0.9 * np.ones(4), np.zeros(8)], *[np.r_[np.zeros(4), rng.choice([0.2, 0.95], 8)] for _ in range(3)]])
    votes = rng.random((4000, 12)) < rates[kind]
    said = (kind > 0) ^ (rng.random(4000) < 0.02)
    guess = label_model(votes, 0.1, given=said.astype(int)) > 0.5
    assert (guess[kind > 0]).mean() > 0.98
    assert (~guess[kind == 0]).mean() > 0.998


# ---- Katz


def good_turing(counts):
    """Ratios r*/r of counts 1..5, scaled so that what is taken away is the Good-Turing mass of the unseen."""
    n = Counter(counts)
    common = 6 * n[6] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, 6):
        star = (r + 1) * n[r + 1] / n[r] if n[r] and common < 1 else 0.0
        d = (star / r - common) / (1 - common) if star else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def brute_katz(rows, held, order):
    """P(w|h) by recursion over plain dictionaries of counts."""
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["\n"] for _, t in rows]
    padded = [["\t"] * (order - 1) + w for w in tokens]
    follow = [defaultdict(Counter) for _ in range(order)]
    for w, h in zip(padded, held):
        for i in range(order - 1, len(w) if not h else 0):
            for k in range(order):
                follow[k][tuple(w[i - k : i])][w[i]] += 1
    ratios = [good_turing([c for f in t.values() for c in f.values()]) for t in follow]
    memory = {}

    def kept(k, r):
        return r * ratios[k].get(r, 1.0)

    def history(h):
        if h not in memory:
            k, f = len(h), follow[len(h)].get(h, {})
            n, left = sum(f.values()), math.fsum(kept(k, r) for r in f.values())
            divisor = n if left < n - 1e-9 else n + 1
            below = math.fsum(p(w, h[1:]) for w in f) if k else 0.0
            memory[h] = divisor, (1 - left / divisor) / (1 - below)
            if k and f:
                assert math.fsum(kept(k, r) / divisor for r in f.values()) + memory[h][1] * (1 - below) == pytest.approx(1)
        return memory[h]

    def p(w, h):
        k, r = len(h), follow[len(h)].get(h, {}).get(w, 0)
        divisor, weight = history(h)
        if r:
            return kept(k, r) / divisor
        return weight * (p(w, h[1:]) if k else 1.0)

    uni = follow[0][()]
    total, types = sum(uni.values()), len(uni)
    out = []
    for (i, _), w, pad, h in zip(rows, tokens, padded, held):
        score = math.fsum(math.log10(p(pad[j], tuple(pad[j - order + 1 : j]))) for j in range(order - 1, len(pad)))
        plain = sum(math.log10((uni[t] + 0.5) / (total + 0.5 * (types + 1))) for t in w)
        out.append((i, h, len(w), sum(uni[t] > 0 for t in w), total, round(plain, 6), round(score, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "fan_bits", "order"), [(2_000_000, 8, 2), (700, 8, 3), (400, 1, 2), (200, 2, 1)])
def test_katz(documents, monkeypatch, block, fan_bits, order):
    random.seed(9)
    pool = [f"w{int(random.expovariate(0.05))}" for _ in range(400)] + ["É", "é", "ABC", "abc"]
    rows = [(i, " ".join(random.choices(pool, k=random.randrange(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "never seen words here"), (203, "w1 " * 5000), (3, rows[3][1]), (None, "w1 w2"), (204, "a b\x0bc")]
    rows += [(2**53 + 1, "w3 w4"), (2**53 + 3, "w5")]
    held = [crc(i) % 5 == 1 for i, _ in rows]
    monkeypatch.setattr(katz, "FAN_BITS", fan_bits)
    got = katz.score_documents(documents(rows, 4).withColumn("score", F.lit(1)), order=order, block_tokens=block)
    got = [(r[0], r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6)) for r in got.collect()]
    want = brute_katz(rows, held, order)
    got.sort(key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=1e-5)


def test_rows_of_the_exchange_do_not_grow_with_the_blocks():
    for blocks in (1, 100, 10_000, 1_000_000, 100_000_000):
        bits, groups = katz.fan(blocks)
        assert bits <= 8 and groups[-1] == 1 and len(groups) <= 4
        assert all(a <= b << bits for a, b in zip([blocks, *groups], groups))


def test_packing():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (katz.unpack_hashes(katz.pack_hashes(hashes), len(hashes)) == hashes).all()
    for values in (np.array([], dtype=np.int64), np.array([0, 1, 255]), np.array([2**40, 3]), rng.random(9)):
        assert (katz.unpack(katz.pack(values)) == values).all()


def test_katz_without_training_or_rows(documents):
    rows = [(1, "a b"), (2, None)]
    got = katz.score_documents(documents(rows), held_out=F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 for r in got) and len(got) == 2
    assert katz.score_documents(documents(rows).limit(0)).count() == 0
