import json
import os
from dataclasses import astuple

import pytest
from pyspark.sql import functions as F

from tessera.functions import models
from tessera.operators import incremental
from tessera.operators.indexing import Library
from tessera.sources import transcripts as io
from tessera.sources.collection import Collection
from tessera.streaming.ingest import ingest


def transcript(folder, name, **fields):
    (folder / f"{name}.json").write_text(json.dumps(fields, indent=2, ensure_ascii=False), encoding="utf-8")


def speech(n):
    return [{"start": 10 * i, "end": 10 * i + 9, "text": f"Parada {i} da linha, troca para o ramal {i % 7}."} for i in range(n)]


def test_transcripts(spark, tmp_path):
    transcript(tmp_path, "one", id="v1", title="T", segments=speech(3))
    transcript(tmp_path, "no id", segments=[7, {"text": ""}, "avulso", None, {"text": "na doca", "start": "?"}])
    (tmp_path / "broken.json").write_text("{nope", encoding="utf-8")
    rows = io.read_transcripts(spark, str(tmp_path))
    assert {r["video_id"] for r in rows.collect()} == {"v1", "no id"}
    segments = io.segment_rows(rows).collect()
    assert {(r["pos"], r["text"], r["start"]) for r in segments if r["video_id"] == "no id"} == {(1, "", None), (4, "na doca", "?")}


def test_lines_and_logs(spark, tmp_path):
    (tmp_path / "done.txt").write_text("k1\n \t\nk2\n\nk1\n")
    assert {r["id"] for r in io.read_lines(spark, str(tmp_path / "done.txt")).collect()} == {"k1", "k2"}
    io.append_done(spark.createDataFrame([("q",)], "id string"), str(tmp_path / "done"))
    assert [r["id"] for r in io.read_lines(spark, str(tmp_path / "done")).collect()] == ["q"]
    errors = spark.createDataFrame([("v", "ValueError", "a\nb")], "id string, kind string, message string").withColumn("at", F.current_timestamp())
    io.append_errors(errors, str(tmp_path / "errors"))
    assert spark.read.text(str(tmp_path / "errors")).first()[0].split("\t")[1:] == ["v", "ValueError: a b"]


def test_captions_and_exports(spark, tmp_path):
    (tmp_path / "v.pt.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\numa fala\n", encoding="utf-8")
    (tmp_path / "v.en.vtt").write_bytes("WEBVTT\n\n00:01.000 --> 00:02.000\numa só\n\n00:03.000 --> 00:04.000\noutra\n".encode("latin-1"))
    best = io.best_captions(io.read_captions(spark, str(tmp_path)), F.lit("v")).collect()
    assert len(best) == 1 and [s["text"] for s in best[0]["segments"]] == ["uma só", "outra"]
    rows = spark.createDataFrame([(best[0]["segments"],)], "segments array<struct<start:double,end:double,text:string>>")
    vtt, txt = rows.select(io.as_vtt(F.col("segments")), io.as_text(F.col("segments"))).first()
    assert vtt == "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\numa só\n\n00:00:03.000 --> 00:00:04.000\noutra\n"
    assert txt == "uma só\noutra\n"
    row = rows.withColumn("id", F.lit("v")).withColumn("title", F.lit(None).cast("string"))
    assert json.loads(row.select(io.as_json(row)).first()[0])["title"] is None


def test_asr(spark):
    raw = json.dumps({"transcription": [{"offsets": {"from": 1500, "to": 2000}, "text": " oi "}, {"offsets": {"from": 0, "to": 1}, "text": " "}]})
    rows = spark.createDataFrame([(raw, "auto"), (None, " PT ")], "r string, l string").coalesce(1)
    got = rows.select(io.asr_segments(F.col("r")).alias("s"), io.asr_language(F.col("l")).alias("l")).collect()
    assert [tuple(s) for s in got[0]["s"]] == [(1.5, 2.0, "oi")] and got[0]["l"] is None and got[1]["l"] == "pt"


SPEC = models.ModelSpec("stub", 8, document_prefix="p: ")
OTHER = models.ModelSpec("other", 8)
ENCODE = models.hashed_words(8)


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    library = Library(spark, str(tmp_path / "library"))
    transcript(source, "a", id="a", segments=speech(60))
    transcript(source, "b", id="b", segments=speech(5))

    def run():
        ingest(spark, str(source), library.path, str(tmp_path / "state"), SPEC, ENCODE, target_words=80).awaitTermination()
        held = Collection.open(spark, library.collection_path).read().groupBy("video_id").count().collect()
        return {r["video_id"]: r["count"] for r in held}

    first = run()
    assert set(first) == {"a", "b"} and first["a"] > 1
    transcript(source, "c", id="a", segments=speech(5))
    assert run() == {"a": 1, "b": 1}
    assert {r["video_id"]: r["chunks"] for r in library.manifest().collect()} == {"a": 1, "b": 1}


def test_index_from_end_to_end(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, n in (("v1", 30), ("v2", 4), ("v3", 4), ("v4", 0)):
        transcript(source, name, id=name, title=name.upper(), segments=speech(n))
        os.utime(source / f"{name}.json", (1000, 1000))
    library = Library(spark, str(tmp_path / "library"))
    files = lambda: io.read_transcripts(spark, str(source))
    index = lambda **options: astuple(library.index(files(), SPEC, ENCODE, target_words=60, **options))

    to_process, ignored, altered, processed, empty, chunks = index(limit=2)
    assert (to_process, ignored, altered, processed, empty) == (4, 0, 0, 2, 0) and chunks > 2
    assert {r["video_id"] for r in library.manifest().collect()} == {"v1", "v2"}
    assert index()[:5] == (2, 2, 0, 1, 1)  # v4 has no passages, so it is tried again
    assert index()[:5] == (1, 3, 0, 0, 1)
    rows = Collection.open(spark, library.collection_path, SPEC).read().collect()
    assert all(len(r["embedding"]) == 8 and sum(x * x for x in r["embedding"]) == pytest.approx(1, abs=1e-5) for r in rows)

    transcript(source, "v1", id="v1", title="V1", segments=speech(3))  # shrinks, and is newer
    assert index()[:5] == (2, 2, 1, 1, 1)
    now = Collection.open(spark, library.collection_path).read()
    assert now.where("video_id = 'v1'").count() == 1 and now.select("video_id").distinct().count() == 3
    assert index(force=True)[:5] == (4, 0, 0, 3, 1)

    with pytest.raises(models.IncompatibleModel):
        library.index(files(), OTHER, ENCODE)
    assert library.index(files(), OTHER, ENCODE, reindex=True, export=str(tmp_path / "export")).processed == 3
    assert Collection.open(spark, library.collection_path).meta()["fingerprint"] == OTHER.fingerprint
    assert set(spark.read.json(str(tmp_path / "export")).columns) == {"id", "embedding", "document", "metadata"}


def test_library_without_or_with_broken_manifest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    transcript(source, "v1", id="v1", segments=speech(4))
    library = Library(spark, str(tmp_path / "library"))
    assert library.manifest().count() == 0
    library.index(io.read_transcripts(spark, str(source)), SPEC, ENCODE)
    for log in (tmp_path / "library" / "manifest" / "_log").glob("*.json"):
        log.write_text("{broken")
    assert [tuple(r) for r in library.manifest().collect()] == [("v1", 1, None, None, None)]
    assert library.index(io.read_transcripts(spark, str(source)), SPEC, ENCODE).altered == 1  # of an unknown chunker


def test_lexical_index_follows_the_collection(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    transcript(source, "v1", id="v1", segments=speech(4))
    library = Library(spark, str(tmp_path / "library"))
    library.index(io.read_transcripts(spark, str(source)), SPEC, ENCODE)
    first = library.lexical()
    built = lambda: os.stat(tmp_path / "library" / "lexical" / "corpus" / "_SUCCESS").st_mtime_ns
    then = built()
    assert first.terms.where("term = 'ramal'").count() == 1
    library.lexical()
    assert built() == then
    transcript(source, "v2", id="v2", segments=[{"start": 0, "end": 1, "text": "Outro cais."}])
    library.index(io.read_transcripts(spark, str(source)), SPEC, ENCODE, min_chunk_words=0)
    assert library.lexical().terms.where("term = 'cais'").count() == 1 and built() != then


def test_collection_versions(spark, tmp_path):
    path = str(tmp_path / "c")
    with pytest.raises(FileNotFoundError):
        Collection.open(spark, path)
    held = Collection.open(spark, path, create=True)
    assert held.read() is None
    rows = lambda *r: spark.createDataFrame(r, "id string, video_id string, n int")
    held.delete(rows(("x", "x", 1)))
    held.replace(rows(("a0", "a", 1), ("a1", "a", 1), ("b0", "b", 1), ("n0", None, 1)))
    before = held.read()
    held.replace(rows(("a0", "a", 2), ("a0", "a", 2)))
    now = lambda: sorted((r["id"], r["n"]) for r in held.read().collect())
    assert now() == [("a0", 2), ("b0", 1), ("n0", 1)]
    assert before.count() == 4  # an earlier reader still finds its files
    (tmp_path / "c" / "v3").mkdir()
    (tmp_path / "c" / "v3" / "half").write_text("")  # left by a crash
    held.delete(rows(("", "b", 0)))
    assert now() == [("a0", 2), ("n0", 1)]
    for i in range(4):
        held.replace(rows((f"z{i}", "z", i)))
    assert now() == [("a0", 2), ("n0", 1), ("z3", 3)]
    assert len(list((tmp_path / "c" / "_log").glob("*.json"))) == 2
    assert not (tmp_path / "c" / "v4").exists()
    held.remove()
    assert not (tmp_path / "c").exists()


def test_missing_done_list(spark, tmp_path):
    assert io.read_lines(spark, str(tmp_path / "none")).count() == 0


def test_bot_runs(spark):
    bot, other = "HTTP Error 403", "timeout"
    seen = [("a", None), ("a", bot), ("a", other), ("a", bot), ("a", None), ("a", bot), ("a", bot), ("a", bot), ("a", None), ("b", bot)]
    rows = spark.createDataFrame([(r, i, m is None, m) for i, (r, m) in enumerate(seen)], "run string, pos int, ok boolean, message string")
    got = {r["pos"]: (r["failures"], r["stop"]) for r in incremental.bot_runs(rows, 3).collect()}
    assert got == {0: (0, False), 1: (1, False), 2: (1, False), 3: (2, False), 4: (0, False), 5: (1, False), 6: (2, False), 7: (3, True), 9: (1, False)}
