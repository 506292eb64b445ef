import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def one(spark, texts, column):
    return values(spark, [(t,) for t in texts], "t string", column)


def notes():
    """Bracketed remarks made from the fixed vocabulary of sounds, in every kind of bracket and in either case."""
    pairs = ["[]", "()", "{}", "**", "<>"]
    # one word of each alternative: optional parts taken, of choices the first
    sounds = [re.sub(r"\[(.)[^\]]*\]", r"\1", w).replace("?", "") for w in tx.NOT_SPEECH.split("|")]
    for i, word in enumerate(sounds):
        opening, closing = pairs[i % len(pairs)]
        yield f"{opening}{word.upper() if i % 2 else word}{closing}"
        yield f"{opening} de longe: {word}, de novo {closing}"


NOISE = ["", "\t ", "?!", "-- --", "((", "tic tic tic tic", "7 7 7 7 7", "[[ruído: som]]"]
SPEECH = ["O vento virou.", "risonha ela saiu", "(volto às 9)", "[ata da reunião]", "(intro) e depois o resto", "8", "sim sim sim",
          "não não sim não", "A orquestra: trilha curta", "ok"]


def test_noise(spark):
    heard = NOISE + list(notes())
    assert one(spark, heard, tx.is_noise(F.col("t"))) == [True] * len(heard)
    assert one(spark, SPEECH, tx.is_noise(F.col("t"))) == [False] * len(SPEECH)


def test_ends_of_sentences(spark):
    texts = ["Chegou.", "Foi?» ", 'Disse "sim!" ', "pausa…)", "sem fim", "3.5 km", ""]
    assert one(spark, texts, tx.ends_sentence(F.col("t"))) == [True, False, True, True, False, False, False]


def test_tokens_match_unicode_rules(spark):
    random.seed(5)
    pool = "aZ09 _-éÉãÇñüẍßŒ中и٣ ́ẞ" + "".join(chr(random.randrange(0xA0, 0x530)) for _ in range(300))
    texts = ["".join(random.choices(pool, k=40)) for _ in range(200)] + ["", "PÖRTAL 12-12_x"]

    def tokens(t):
        plain = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn")
        return re.findall("[a-z0-9]+", unicodedata.normalize("NFC", plain))

    assert one(spark, texts, tx.tokens(F.col("t"))) == [tokens(t) for t in texts]
    assert one(spark, [None], tx.tokens(F.col("t"))) == [[]]


def test_query_terms():
    assert tx.query_terms("o e a por") == []
    assert tx.query_terms("Trem trem quando CHUVA? também Ônibus") == [("trem", 2), ("chuva", 1), ("onibus", 1)]


def clock(seconds):
    """Half seconds to even; hours only when there are any."""
    whole = round(max(seconds or 0.0, 0.0))
    minutes, rest = divmod(whole, 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours:02d}:{minutes:02d}:{rest:02d}" if hours else f"{minutes:02d}:{rest:02d}"


def test_format_seconds(spark):
    random.seed(21)
    times = [None, -0.4, -77.0, 3599.5, 3598.5, 4e5] + [random.randrange(0, 40_000) / 2 for _ in range(200)]
    assert values(spark, [(t,) for t in times], "t double", tx.format_seconds(F.col("t"))) == [clock(t) for t in times]


def test_vtt_timestamp(spark):
    random.seed(22)
    times = [None, -3.0, 0.0125, 0.0135] + [random.randrange(0, 50_000_000) / 1000 for _ in range(200)]
    want = []
    for t in times:
        ms = round(max(t or 0.0, 0.0) * 1000)
        want.append(f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}")
    assert values(spark, [(t,) for t in times], "t double", tx.vtt_timestamp(F.col("t"))) == want


def test_caption_seconds(spark):
    random.seed(23)
    texts, want = ["", "nada", "::", "9:8:7:6", "a:59"], [0.0] * 5
    for _ in range(100):
        h, m, ms = random.randrange(0, 30), random.randrange(0, 99), random.randrange(0, 60_000)
        second = f"{ms // 1000:02d}{random.choice('.,')}{ms % 1000:03d}"
        long = random.random() < 0.5
        texts.append(f" {h:02d}:{m:02d}:{second}" if long else f"{m:02d}:{second} ")
        want.append((h * 3600 if long else 0) + m * 60 + ms / 1000)
    assert one(spark, texts, tx.caption_seconds(F.col("t"))) == pytest.approx(want)


URLS = [
    ("https://www.youtube.com/watch?v=Qz7", 12.99, "https://www.youtube.com/watch?v=Qz7&t=12s"),
    ("https://example.org/clip/9", 41.0, "https://example.org/clip/9?t=41s"),
    ("HTTPS://example.org/", 0.0, "https://example.org/?t=0s"),
    ("https://example.org/w?t=99s&k=1&t=3s", 8.0, "https://example.org/w?t=8s&k=1"),
    ("https://h/p?a=1&a=2&b=", 1.0, "https://h/p?a=2&b=&t=1s"),
    ("https://h/p?q=a%20b+c&x=%7E*#frag", 1.0, "https://h/p?q=a+b+c&x=~%2A&t=1s#frag"),
    ("\t", 3.0, "https://www.youtube.com/watch?v=&t=3s"),
    (None, None, "https://www.youtube.com/watch?v=&t=0s"),
]


def test_timestamp_url(spark):
    rows = [(u, s) for u, s, _ in URLS]
    got = values(spark, rows, "u string, s double", tx.timestamp_url(F.col("u"), F.col("s")))
    assert got == [want for *_, want in URLS]
