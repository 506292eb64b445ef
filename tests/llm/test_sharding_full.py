import random
from collections import Counter

from tessera.llm.sharding import grants_of, shard_documents


def test_grants_keep_quotas():
    rng = random.Random(3)
    for _ in range(200):
        asked = {(a, b, rng.randrange(3)): rng.randrange(1, 9) for a in range(5) for b in range(5) if a != b and rng.random() < 0.5}
        free = [rng.choice([0, 0, 3]) for _ in range(5)]
        got = grants_of(asked, free)
        assert all(0 < n <= asked[w] for w, n in got.items())
        for s in range(5):
            assert sum(n for w, n in got.items() if w[1] == s) - sum(n for w, n in got.items() if w[0] == s) <= free[s]


def test_groups_gather_when_every_text_has_a_copy(documents):
    rows = [(i, f"text {i // 3}") for i in range(600)]
    found = shard_documents(documents(rows), shards=6).collect()
    assert set(Counter(r["shard"] for r in found).values()) == {100}
    where = {}
    for r in found:
        where.setdefault(r["doc_id"] // 3, set()).add(r["shard"])
    whole = sum(len(s) == 1 for s in where.values())
    assert whole >= 150
