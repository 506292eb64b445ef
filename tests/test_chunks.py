import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.functions import text as tx
from tessera.operators import chunks

SEGMENT = "video_id string, pos int, start string, end string, text string"


def frame(spark, videos):
    rows = [(v, i, *s) for v, segments in videos.items() for i, s in enumerate(segments)]
    return spark.createDataFrame(rows, SEGMENT)


def run(spark, videos, **options):
    got = chunks.chunk_transcripts(frame(spark, videos), **options).orderBy("video_id", "chunk_index").collect()
    return {v: [r for r in got if r["video_id"] == v] for v in videos}


def model(texts, target, overlap, least):
    """Step by step: cut, merge, trim; gives the segment numbers of each block."""
    n, w = len(texts), [len(t.split()) for t in texts]
    stops = [t.rstrip()[-1:] in ".!?…" for t in texts]
    blocks, at = [], 0
    while at < n:
        total, q = 0, None
        for i in range(at, n):
            total += w[i]
            if total >= target:
                q = i
                break
        if q is not None and q + 1 < n:
            end = q + 1
        else:
            ends = [i for i in range(at + 1, n) if stops[i]]
            end = ends[-1] + 1 if ends else at + 1
        blocks.append(list(range(at, end)))
        at = end
    words = lambda b: sum(w[i] for i in b)
    if least > 0 and len(blocks) > 1:
        merged = []
        for b in blocks:
            if merged and words(b) < least:
                merged[-1] = merged[-1] + b
            else:
                merged.append(b)
        while len(merged) > 1 and words(merged[0]) < least:
            merged[:2] = [merged[0] + merged[1]]
        blocks = merged
    if overlap > 0 and len(blocks) > 1:
        for k in range(1, len(blocks)):
            b, total, stop = blocks[k], 0, len(blocks[k])
            for i, s in enumerate(b):
                total += w[s]
                if total >= overlap:
                    stop = i + 1
                    break
            first = texts[b[0]].split()[0].lower().strip(",.;:")
            if stop < len(b) and stop > 1 and first in tx.LINKING_WORDS:
                blocks[k] = b[1:]
    return blocks


def test_against_step_by_step(spark):
    random.seed(11)
    pool = ["e", "você,", "vida", "tempo.", "casa", "De", "sol!", "mar", "então"]
    videos = {}
    for v in range(120):
        texts = [" ".join(random.choices(pool, k=random.randrange(1, 14))) for _ in range(random.randrange(1, 40))]
        texts = [t if len(set(t.split())) > 1 or len(t.split()) < 4 else t + " fim" for t in texts]
        videos[f"v{v}"] = [(str(10.0 * i), str(10.0 * i + 9), t) for i, t in enumerate(texts)]
    for target, overlap, least in ((20, 8, 6), (40, 15, 25), (30, 0, 0), (25, 5, 12)):
        got = run(spark, videos, target_words=target, overlap_words=overlap, min_chunk_words=least)
        for v, segments in videos.items():
            texts = [s[2] for s in segments]
            want = model(texts, max(20, target), overlap, least)
            assert [r["document"] for r in got[v]] == [" ".join(texts[i] for i in b) for b in want], v
            assert [(r["start_time"], r["end_time"]) for r in got[v]] == [(10.0 * b[0], 10.0 * b[-1] + 9) for b in want]


def test_dirty_segments(spark):
    videos = {
        "untimed": [(None, None, "portas"), (None, None, "abertas")],
        "swap": [("31", "8.5", "anda para trás")],
        "bad": [("ontem", "", "sem relógio")],
        "noise": [("0", "1", "(som)"), ("0", "1", "\n"), ("0", "1", None)],
    }
    got = run(spark, videos)
    assert [len(got[v]) for v in videos] == [1, 1, 1, 0]
    assert (got["swap"][0]["start_time"], got["swap"][0]["end_time"]) == (8.5, 31.0)
    assert got["bad"][0]["start_time"] == 0.0
    row = got["untimed"][0].asDict()
    assert row["id"] == "untimed_chunk_0000" and row["title"] == "Vídeo sem título" and row["total_chunks"] == 1
    assert row["timestamp_url"] == "https://www.youtube.com/watch?v=untimed&t=0s"


def test_invariants(spark):
    random.seed(31)
    stations = [f"parada{i}" for i in range(75)]
    videos = {"m": [(str(6 * i), str(6 * i + 5), f"{s}, " + " ".join(random.choices(["sul", "norte", "praia"], k=5)) + ".") for i, s in enumerate(stations)]}
    got = run(spark, videos, target_words=70, overlap_words=0, min_chunk_words=0)["m"]
    said = " ".join(r["document"] for r in got).split()
    assert [w for w in said if w.startswith("parada")] == [f"{s}," for s in stations]
    assert all(a["end_time"] <= b["start_time"] for a, b in zip(got, got[1:]))
    short = {"r": [("0", "1", "uma volta inteira pela linha.") for _ in range(33)] + [("0", "1", "fim")]}
    assert all(r["word_count"] >= 30 for r in run(spark, short, min_chunk_words=30)["r"])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a norte", "praia.", "e mais sul agora", "já"]), min_size=1, max_size=30))
def test_every_word_is_kept_without_overlap(spark, texts):
    got = run(spark, {"v": [("0", "1", t) for t in texts]}, target_words=20, overlap_words=0)["v"]
    assert " ".join(r["document"] for r in got) == " ".join(texts)
