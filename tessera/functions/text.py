"""Scalar text operators as column expressions; they all stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, which results depend on.
STOPWORDS = """
a o as os um uma uns umas de do da dos das em no na nos nas por pelo pela pelos pelas para pra com sem sob sobre
entre ate até que se ao aos e ou mas porem porém porque pois entao então ja já mais muito tambem também so só ser
estar ter fazer ir vao vão voce você eu tu ele ela isso isto aquilo qual quais quando como onde qualquer todos todas
cada seu sua meu minha nosso nossa dele dela deles delas the and for you are with this that from have not but was
will
""".split()
LINKING_WORDS = """
a o as os um uma uns umas de do da dos das em no na nos nas por pelo pela para pra com sem que se ao aos à às e é
mas ou onde quando como porque pois então já mais muito também você eu isso isto aquilo entender
""".split()
NOT_SPEECH = (
    r"m[úu]sica|music|aplaussos|aplausos|ris[ao]s?|laughter|sil[êe]ncio|silence|barulho|noise|som|[âa]udio|intro|"
    r"outro|vinheta|jingle|cantarola|cantarolando|humming|hum|murm[úu]rio|murmur|shhh|efeito|trilha|ambiente|"
    r"transi[çc][ãa]o|sonora|sonoro|instrumental|fundo"
)
WATCH_URL = "https://www.youtube.com/watch?v="
TIMING = (
    r"(\d{1,2}:\d{2}:\d{2}[.,]\d{1,3}|\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*"
    r"(\d{1,2}:\d{2}:\d{2}[.,]\d{1,3}|\d{1,2}:\d{2}[.,]\d{1,3})"
)


def _accent_pairs() -> tuple[str, str]:
    """Single characters whose decomposition, less its marks, is one of a-z or 0-9."""
    plain = set("abcdefghijklmnopqrstuvwxyz0123456789")
    pairs = []
    for code in range(0x80, 0x20000):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if base in plain and base:
            pairs.append((char, base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTED, PLAIN = _accent_pairs()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def normalize(text: Column) -> Column:
    """Lower case without accents; null counts as empty."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_replace(F.translate(lower, ACCENTED, PLAIN), r"\p{Mn}", "")


def tokens(text: Column) -> Column:
    """All runs of a-z and 0-9 in the normalised text."""
    return F.regexp_extract_all(normalize(text), F.lit("([a-z0-9]+)"), F.lit(1))


def query_terms(query: str) -> list[tuple[str, int]]:
    """(term, frequency) of a query in order of first occurrence, without stopwords."""
    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if unicodedata.category(c) != "Mn")
    counts: dict[str, int] = {}
    for term in re.findall("[a-z0-9]+", plain):
        if term not in STOPWORDS:
            counts[term] = counts.get(term, 0) + 1
    return list(counts.items())


def is_noise(text: Column) -> Column:
    """Blank, without a letter or digit, a bracketed note on sound, or one token four times or more."""
    clean = strip(text)
    inside = F.regexp_extract(clean, r"(?s)^[\[\(*{<]+\s*([^\n]*?)\s*[\]\)}*>]+$", 1)
    wrapped = clean.rlike(r"^[\[\(*{<]+\s*[^\n]*?\s*[\]\)}*>]+$")
    parts = words(clean)
    return (
        (clean == "")
        | ~clean.rlike(r"[\p{L}\p{N}]")
        | (wrapped & inside.rlike(rf"(?iuU)\b({NOT_SPEECH})\b"))
        | ((F.size(parts) >= 4) & (F.size(F.array_distinct(parts)) == 1))
    )


def ends_sentence(text: Column) -> Column:
    return text.rlike(r"""(?U)[.!?…]+["'”’)\]]*\s*$""")


def is_useful(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def format_seconds(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from one hour on; halves round to even, negative counts as 0."""
    whole = F.rint(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0))).cast("long")
    hours = F.floor(whole / 3600)
    minutes = F.floor((whole % 3600) / 60)
    rest = whole % 60
    short = F.format_string("%02d:%02d", minutes, rest)
    return F.when(hours > 0, F.format_string("%02d:%02d:%02d", hours, minutes, rest)).otherwise(short)


def vtt_timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm; halves round to even, negative counts as 0."""
    ms = F.rint(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0)) * 1000).cast("long")
    return F.format_string(
        "%02d:%02d:%02d.%03d",
        F.floor(ms / 3_600_000),
        F.floor((ms % 3_600_000) / 60_000),
        F.floor((ms % 60_000) / 1000),
        ms % 1000,
    )


def caption_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS.mmm or MM:SS.mmm with a point or comma; anything else is 0."""
    parts = F.split(F.replace(strip(text), F.lit(","), F.lit(".")), ":")
    numbers = F.transform(parts, lambda p: strip(p).try_cast("double"))
    sound = F.forall(numbers, lambda n: n.isNotNull())
    minutes = F.get(numbers, F.size(numbers) - 2) * 60 + F.get(numbers, F.size(numbers) - 1)
    return (
        F.when(sound & (F.size(numbers) == 3), F.get(numbers, F.lit(0)) * 3600 + minutes)
        .when(sound & (F.size(numbers) == 2), minutes)
        .otherwise(F.lit(0.0))
    )


def _encoded(text: Column) -> Column:
    """Form encoding that leaves A-Z a-z 0-9 _ . - ~ alone."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def timestamp_url(url: Column, seconds: Column) -> Column:
    """The URL with its query's t set to the whole second, in place if it is there; keys keep their last value."""
    clean = strip(F.coalesce(url, F.lit("")))
    at = F.concat(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0)).cast("long").cast("string"), F.lit("s"))
    body, fragment = F.regexp_extract(clean, r"(?s)^([^#]*)", 1), F.regexp_extract(clean, r"(?s)(#.+)$", 1)
    base, query = F.regexp_extract(body, r"(?s)^([^?]*)", 1), F.regexp_extract(body, r"(?s)\?(.*)$", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    base = F.concat(F.lower(scheme), F.substring(base, F.char_length(scheme) + 1, F.char_length(base)))
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decoded(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"),
            _decoded(F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("v"),
        ),
    )
    keys = F.array_distinct(F.concat(F.transform(pairs, lambda p: p["k"]), F.array(F.lit("t"))))
    value = lambda k: F.try_element_at(F.filter(pairs, lambda p: p["k"] == k), F.lit(-1))["v"]
    fields = F.transform(
        keys, lambda k: F.concat(_encoded(k), F.lit("="), F.when(k == "t", at).otherwise(_encoded(value(k))))
    )
    return F.when(clean == "", F.concat(F.lit(f"{WATCH_URL}&t="), at)).otherwise(
        F.concat(base, F.lit("?"), F.array_join(fields, "&"), fragment)
    )


def without_markup(text: Column) -> Column:
    """Caption text without cursor marks and tags."""
    marks = F.regexp_replace(text, r"(?i)</?c[^>]*>|</?v[^>]*>|\{\\[^}]*\}", "")
    return F.regexp_replace(marks, "<[^>]+>", "")


def tidy_caption(text: Column) -> Column:
    """Caption text with single spaces and without timings inside it."""
    flat = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return strip(F.regexp_replace(flat, TIMING, ""))


def start_linking(text: Column) -> Column:
    """Whether the first word, lower-cased and without , . ; : around it, links to what came before."""
    first = F.lower(F.get(words(text), F.lit(0)))
    return F.coalesce(F.btrim(first, F.lit(",.;:")).isin(LINKING_WORDS), F.lit(False))
