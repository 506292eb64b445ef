import random

from pyspark.sql import functions as F

from tessera.operators import captions


def parse(spark, *contents):
    rows = spark.createDataFrame(list(enumerate(contents)), "path int, content string")
    got = {r["path"]: [(s["start"], s["end"], s["text"]) for s in r["segments"]] for r in captions.parse_captions(rows).collect()}
    return [got.get(i, []) for i in range(len(contents))]


def cue(a, b, text):
    return f"{a} --> {b}\n{text}\n\n"


def test_simple_and_srt(spark):
    vtt = "WEBVTT\n\n00:10.250 --> 00:12.000 line:0\no trem\npara aqui\n\n00:20.000 --> 00:19.000\ndesce\n"
    srt = "7\r\n00:01:00,500 --> 00:01:02,000\r\n44\r\nna plataforma\r\n\r\n"
    first, second = parse(spark, vtt, srt)
    assert first == [(10.25, 12.0, "o trem para aqui"), (20.0, 20.0, "desce")]
    assert second == [(60.5, 62.0, "na plataforma")]


def test_notes_and_empty(spark):
    text = "WEBVTT\n\nNOTE 00:10.000 --> 00:11.000\n\nSTYLE\n::cue(b) {}\n\nREGION\nid:r\n\n" + cue("00:12.000", "00:13.000", "Bom dia a bordo") + cue("00:14.000", "00:15.000", "-- ?")
    assert parse(spark, text, "", None) == [[(12.0, 13.0, "Bom dia a bordo")], [], []]


def test_rolling(spark):
    again = "".join(cue(f"00:0{i}.000", "00:09.000", "porta fechando") for i in range(4))
    sliding = cue("00:01.000", "00:02.000", "linha dois sentido norte") + cue("00:02.000", "00:03.000", "sentido norte sai agora")
    word = cue("00:01.000", "00:02.000", "sobe e desce") + cue("00:02.000", "00:03.000", "desce já")
    got = parse(spark, again, sliding, word)
    # one shared word is no repetition
    assert [[t for *_, t in g] for g in got] == [["porta fechando"], ["linha dois sentido norte", "sai agora"], ["sobe e desce", "desce já"]]


def test_clean(spark):
    texts = ["<v Ana>p&atilde;o &lt;&eacute;&gt; caf&eacute;</v>", r"{\i1}embaixo{\i0}", "00:10.000 --> 00:11.500", "<b>um</b>\u00a0 <00:01.000>dois"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in rows.select(captions.clean_caption(F.col("t"))).collect()] == ["pão <é> café", "embaixo", "", "um dois"]


def test_fold_against_a_loop(spark):
    random.seed(2)
    files, want = [], []
    for _ in range(60):
        cues = [[random.choice("abc") for _ in range(random.randrange(1, 7))] for _ in range(12)]
        files.append("WEBVTT\n\n" + "".join(cue(f"00:{i:02d}.000", f"00:{i + 1:02d}.000", " ".join(c)) for i, c in enumerate(cues)))
        last, out = [], []
        for c in cues:
            size = next((n for n in range(min(len(last), len(c)), 1, -1) if last[-n:] == c[:n]), 0)
            new = c[size:] if size or c != last else []
            if new:
                out.append(" ".join(new))
                last = new
        want.append(out)
    assert [[t for *_, t in g] for g in parse(spark, *files)] == want


def test_bytes(spark):
    rows = spark.createDataFrame([(bytearray("ção".encode()),), (bytearray("ção".encode("latin-1")),)], "c binary").coalesce(1)
    assert [r[0] for r in rows.select(captions.decode_bytes(F.col("c"))).collect()] == ["ção", "ção"]
