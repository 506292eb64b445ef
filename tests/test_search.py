import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import models
from tessera.functions import text as tx
from tessera.operators import hybrid, incremental, lexical, vectors

DOCS = [
    ("a", "O bonde 7 sobe a ladeira da estação e volta vazio", [2.0, 0.0, 0.0, 0.5], "v0"),
    ("b", "Barca 40 40 atravessa a baía com chuva e vento", [0.0, 3.0, 0.0, 0.5], "v1"),
    ("c", "Onde trocar de trem sem pagar outra passagem", [0.0, 0.0, 1.0, 0.0], "v2"),
    ("d", "Barca 8 da ilha sai da doca", [0.1, 0.0, 0.0, 1.0], "v3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id string, document string, embedding array<double>, video_id string").cache()


def ids(found):
    return [r["id"] for r in found.orderBy("rank").collect()]


def test_bm25(spark, docs):
    assert ids(lexical.bm25(docs, "bonde 7"))[0] == "a"
    assert set(ids(lexical.bm25(docs, "barca"))) == {"b", "d"}
    assert len(ids(lexical.bm25(docs, "barca ladeira trem", 2))) == 2
    assert ids(lexical.bm25(docs, "estacao")) == ["a"]
    for nothing in ("a de da que e", "metropolitano", "", "  "):
        assert ids(lexical.bm25(docs, nothing)) == []
    assert lexical.bm25(docs.limit(0), "barca").count() == 0


def test_bm25_formula_and_index(spark, docs):
    tokens = {r["id"]: r["t"] for r in docs.select("id", tx.tokens(F.col("document")).alias("t")).collect()}
    avg = sum(map(len, tokens.values())) / 4

    def score(doc, terms):
        out = 0.0
        for t, q in terms.items():
            df, tf = sum(t in x for x in tokens.values()), Counter(tokens[doc])[t]
            out += q * math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens[doc]) / avg)) if tf else 0
        return out

    got = {r["id"]: r["score"] for r in lexical.bm25(docs, "barca 40 40").collect()}
    terms = {"barca": 1, "40": 2}
    assert got == pytest.approx({d: score(d, terms) for d in ("b", "d")})
    index = lexical.LexicalIndex.build(docs)
    asked = spark.createDataFrame([(1, "barca 40 40"), (2, "a de"), (3, "bonde")], "qid int, query string")
    many = {(r["qid"], r["id"]): r["score"] for r in lexical.bm25_many(index, asked).collect()}
    assert {k[0] for k in many} == {1, 3} and many[1, "b"] == pytest.approx(score("b", terms))


def test_saved_index(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    first = lexical.LexicalIndex.open(docs, path)
    assert first.terms.count() > 10 and first.corpus.first()["n"] == 4
    made = (tmp_path / "index" / "corpus" / "_SUCCESS").stat().st_mtime_ns
    lexical.LexicalIndex.open(docs.repartition(3), path)
    assert (tmp_path / "index" / "corpus" / "_SUCCESS").stat().st_mtime_ns == made
    changed = docs.withColumn("document", F.regexp_replace("document", "ilha", "praia"))
    assert lexical.LexicalIndex.open(changed, path).terms.where("term = 'praia'").count() == 1
    none = lexical.LexicalIndex.build(docs.limit(0))
    assert none.corpus.first()["n"] == 0
    assert lexical.bm25_many(none, spark.createDataFrame([(1, "barca")], "qid int, query string")).count() == 0


def test_texts_are_tokenised_once(docs):
    from contextlib import redirect_stdout
    from io import StringIO

    out = StringIO()
    with redirect_stdout(out):
        lexical.scan_scores(docs, "barca 40 ladeira").explain("extended")
    # the scores come from the stored counts
    assert "regexp_extract_all" not in out.getvalue()


def test_vectors(spark, docs):
    assert ids(vectors.cosine_top_k(docs, [0, 1, 0, 0], 2))[0] == "b"
    zero = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "e array<double>").coalesce(1)
    assert [r[0] for r in zero.select(vectors.l2_normalize(F.col("e"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]
    assert vectors.wrong_dimension(docs, 4).count() == 0


def test_vectors_without_direction(spark, docs):
    rows = [("z", [0.0, 0.0]), ("o", [-1.0, 0.0]), ("p", [5.0, 0.0]), ("n", None), ("h", [1.0, None]), ("l", [1.0])]
    table = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = [(r["id"], r["distance"], r["rank"]) for r in vectors.cosine_top_k(table, [2.0, 0.0], 5).orderBy("rank").collect()]
    assert got == [("p", 0.0, 0), ("z", 1.0, 1), ("o", 2.0, 2)]
    assert [(r["id"], r["distance"]) for r in vectors.cosine_top_k(table, [0.0, 0.0], 5).collect()] == [("o", 1.0), ("p", 1.0), ("z", 1.0)]
    blank = docs.withColumn("embedding", F.transform("embedding", lambda x: x * 0))
    assert len(search(blank, "barca")) == 4


def search(docs, text, **options):
    return hybrid.hybrid_search(docs, [0, 0, 1, 0], text, **options).orderBy("pos").collect()


def test_hybrid(docs):
    got = {r["id"]: r for r in search(docs, "barca")}
    assert got["b"]["lexical_rank"] is not None and got["d"]["lexical_rank"] is not None
    assert got["c"]["vector_rank"] == 0 and got["c"]["score"] == pytest.approx(1 / 61)
    assert got["d"]["score"] == pytest.approx(1 / (61 + got["d"]["vector_rank"]) + 1 / (61 + got["d"]["lexical_rank"]))


def test_vector_only_is_one_rank_more_generous(docs):
    for options in ({"lexical_weight": 0.0}, {"hybrid": False}):
        assert [r["score"] for r in search(docs, "barca", **options)] == pytest.approx([1 / (60 + i) for i in range(4)])
    assert search(docs, "metropolitano")[0]["score"] == pytest.approx(1 / 60)
    # the filter leaves the lexical side empty
    assert [(r["id"], r["score"]) for r in search(docs, "barca", where=F.col("video_id") == "v2")] == [("c", pytest.approx(1 / 60))]


def test_filter_threshold_weight(docs):
    assert [r["id"] for r in search(docs, "barca", where=F.col("video_id") == "v3")] == ["d"]
    assert all(r["score"] >= 0.02 for r in search(docs, "barca", min_score=0.02))
    assert search(docs, "barca", lexical_weight=5.0)[0]["id"] in ("b", "d")
    assert len(search(docs, "barca", top_k=2)) == 2


def test_diversify(spark):
    rows = spark.createDataFrame([("x", "a", 0), ("y", "a", 1), ("z", "b", 2), ("w", None, 3), ("u", "a", 4)], "id string, video_id string, pos int")
    order = lambda most: [r["id"] for r in hybrid.diversify(rows, most).orderBy("pos").collect()]
    assert order(1) == ["x", "z", "w", "y", "u"]
    assert order(0) == ["x", "y", "z", "w", "u"]
    assert order(2) == ["x", "y", "z", "w", "u"]


def test_labels(docs):
    got = {r["id"]: r for r in hybrid.labels(hybrid.hybrid_search(docs, [0, 0, 1, 0], "barca")).collect()}
    assert got["c"]["origin"] == "vetorial #1" and got["c"]["distance_label"] == "cosseno 0.000" and got["c"]["score_label"] == "RRF 0.0164"
    assert " + lexical #" in got["b"]["origin"]


def test_rendered(spark, docs):
    about = docs.select("id", "document", F.lit("Linhas").alias("title"), F.lit("20230405").alias("upload_date"), F.lit("00:10").alias("start_str"),
                        F.lit(None).cast("string").alias("end_str"), F.lit(1).alias("chunk_index"), F.lit(3).alias("total_chunks"), F.lit("u").alias("timestamp_url"))
    got = {r["id"]: r["block"] for r in hybrid.rendered(hybrid.hybrid_search(docs, [0, 0, 1, 0], "barca"), about).collect()}
    assert len(got) == 4
    lines = got["c"].split("\n")
    assert lines[0].endswith("cosseno 0.000 | RRF 0.0164 | vetorial #1") and lines[0].startswith("[")
    assert lines[1:] == ["  Vídeo:  Linhas", "  Data:   20230405", "  Momento: 00:10 → ??:??  (bloco 2 de 3)", "  Link:   u", "  Trecho:", f"    {DOCS[2][1]}"]


def test_selection(spark):
    files = spark.createDataFrame([(i, 10.0) for i in range(6)], "video_id int, mtime double")
    manifest = spark.createDataFrame([(1, 20.0, 2), (2, 5.0, 2), (3, 20.0, 1), (4, None, None), (5, None, 2)], "video_id int, mtime double, chunker int")
    got = {r["video_id"]: (r["action"], r["altered"]) for r in incremental.select_videos(files, manifest).collect()}
    assert got == {0: ("process", False), 1: ("skip", False), 2: ("process", True), 3: ("process", True), 4: ("process", True), 5: ("process", True)}
    forced = {r["video_id"]: (r["action"], r["altered"]) for r in incremental.select_videos(files, manifest, force=True).collect()}
    assert forced[1] == ("process", False) and forced[3] == ("process", True)
    assert incremental.counters(incremental.select_videos(files, manifest)).first().asDict() == {"to_process": 5, "ignored": 1, "altered": 4}


def test_collections(spark):
    old = spark.createDataFrame([("a0", "a"), ("a1", "a"), ("b0", "b"), ("n0", None), ("e0", "")], "id string, video_id string")
    new = spark.createDataFrame([("a0", "a")], "id string, video_id string")
    assert {r["id"] for r in incremental.replace_videos(old, new).collect()} == {"a0", "b0", "n0", "e0"}
    assert incremental.upsert(old, new).count() == 5
    assert {r["video_id"]: r["chunks"] for r in incremental.rebuild_manifest(old).collect()} == {"a": 2, "b": 1}
    assert incremental.pending(old, spark.createDataFrame([("a0",), ("a0",)], "id string")).count() == 4


def test_listing(spark):
    rows = [("p", 95.5, None), ("q", 59.9, False), ("r", 60.0, False), ("s", 7200.0, True), ("t", None, None), ("u", 0.0, None)]
    videos = spark.createDataFrame(rows, "id string, duration double, is_live boolean")
    kept = lambda least: {r["id"] for r in videos.where(incremental.listed(F.col("duration"), F.col("is_live"), least)).collect()}
    assert kept(60) == {"p", "r", "t", "u"}
    assert kept(0) == {r[0] for r in rows}


def test_models(spark):
    assert models.MODELS["BAAI/bge-m3"].fingerprint == "644c5ecc5cb0d23b"
    assert models.resolve("infly/inf-retriever-v1-5b").name == "infly/inf-retriever-v1-1.5b"
    assert models.resolve("x/new").dimension == 1536
    for bad in ("", None):
        with pytest.raises(ValueError):
            models.resolve(bad)
    with pytest.raises(ValueError):
        models.provider_kind("nowhere")
    spec, other = models.MODELS["BAAI/bge-m3"], models.MODELS["text-embedding-3-small"]
    models.check_compatible(models.contract_of(spec), spec)
    models.check_compatible({}, spec)
    models.check_compatible({"model": spec.name, "dimensions": None}, spec)
    for recorded in (models.contract_of(other), {"model": other.name}, {"model": spec.name, "dimensions": 3}, {"fingerprint": "0" * 16}):
        with pytest.raises(models.IncompatibleModel):
            models.check_compatible(recorded, spec)
    with pytest.warns(UserWarning):
        models.check_compatible(models.contract_of(other), spec, permit=True)


def test_default_models():
    name = lambda *a: models.model_for(*a).name
    assert name() == name("local") == name("HF") == "Alibaba-NLP/gte-Qwen2-1.5B-instruct"
    assert name("stella") == "dunzhang/stella_en_1.5B_v5" and name("infini") == "infly/inf-retriever-v1-1.5b"
    assert name("openai") == "text-embedding-3-small" and name("api", None, "own") == "own" and name("gte", None, "own") != "own"
    assert name("stella", "BAAI/bge-m3") == "BAAI/bge-m3"


def test_encoder(spark):
    spec = models.ModelSpec("stub", 16, "q: ", "p: ", lowercase=True)
    rows = spark.createDataFrame([("  Olá Mundo ",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in rows.select(models.query_input(F.col("t"), spec)).collect()] == ["p: olá mundo", "p: "]
    encode = models.encoder(spec, models.hashed_words(16))
    for r in rows.select(encode(models.document_input(F.col("t"), spec)).alias("e")).collect():
        assert len(r["e"]) == 16 and sum(x * x for x in r["e"]) == pytest.approx(1, abs=1e-5)
