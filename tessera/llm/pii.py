r"""Personal data: strict spans, and looser ones that boosted trees accept, in DataFrame operations only.

Positions come from splitting: split() gives the texts between matches and regexp_extract_all() the matches, so
running lengths give starts and ends in code points. The patterns are the contract's own with three changes that
don't alter what they match: repeats are possessive (Java then loops instead of recursing), a match may only begin
where a run of its first class begins (or the last match ended), so that long runs are scanned once, and cards
have their digit count in the pattern, as every match is a maximal run of digits and single separators.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.boosting import BoostedTrees, Platt
from tessera.llm.common import packed, store, text_of, unpacked

KINDS = ["email", "ip", "card", "phone"]
RESULT = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"]

#: kind -> (text that must occur, pattern)
STRICT = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_AT = r"(?:\x20?@\x20?|\x20?[\(\[{<]\x20?(?i:at)\x20?[\)\]}>]\x20?|\x20(?i:at)\x20)"
_DOT = r"(?:\.|\x20\.\x20|\x20?[\(\[{<]\x20?(?:\.|(?i:dot))\x20?[\)\]}>]\x20?|\x20(?i:dot)\x20)"
_GAP = r"[\x20._/-]{0,3}"
#: High-recall generators: what people write when they don't write the strict form, and much that isn't meant. A kind
#: may have several, whose proposals overlap.
LOOSE = {
    "email": [rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"],
    "ip": [rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\x20?[,_-]\x20?|{_DOT})[0-9]{{1,3}}){{3}}(?![0-9])"],
    "card": [
        rf"(?<![0-9])[0-9](?:{_GAP}[0-9]){{12,18}}+(?![0-9])",
        rf"(?<![0-9])(?:[0-9]{{4}}(?:{_GAP}[0-9]{{4}}){{3}}|3[47][0-9]{{2}}{_GAP}[0-9]{{6}}{_GAP}[0-9]{{5}})(?![0-9])",
    ],
    "phone": [r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20./-]{0,3}\(?[0-9]{2,4}\)?){2,5}(?![0-9])"],
}
#: Words near a span that speak for a kind.
CUES = {
    "email": r"(?i)mail|contact|write|reach",
    "ip": r"(?i)\bip\b|host|server|address|ping",
    "card": r"(?i)card|visa|amex|pay|iban|credit",
    "phone": r"(?i)phone|tel|call|mobile|fax|whatsapp|dial",
}
REACH = 24  # code points of context that features see on either side
FEATURES = 15


def luhn(digits: Column) -> Column:
    """True when a string of digits passes the Luhn check."""
    last = F.char_length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), last),
        F.lit(0),
        lambda acc, i: acc
        + F.when((last - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            (F.substring(digits, i, F.lit(1)).cast("int") * 2).cast("int") % 10
            + F.floor(F.substring(digits, i, F.lit(1)).cast("int") * 2 / 10).cast("int")
        ),
    )
    return F.when(last > 0, total % 10 == 0).otherwise(False)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def octets(match: Column) -> Column:
    """True when no number is over 255; numbers of over 3 digits count by value, leading zeros aside."""
    parts = F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))
    return F.forall(parts, lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def located(text: Column, needed: str, pattern: str) -> Column:
    """All matches as array<struct<s: start, e: end, m: text>>, in code points, end exclusive."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")

    def add(acc: Column, both: Column) -> Column:
        start = acc["at"] + F.char_length(both["gap"])
        end = start + F.char_length(both["hit"])
        return F.struct(
            end.alias("at"),
            F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), both["hit"].alias("m")))).alias("out"),
        )

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])
    occurs = text.rlike(pattern) if not needed else text.contains(needed)
    return F.when(occurs, found).otherwise(empty)


def strict_matches(text: Column) -> dict[str, Column]:
    return {k: located(text, *STRICT[k]) for k in KINDS}


def valid(kind: str, x: Column) -> Column:
    """The contract's check of a match; failing matches are dropped without a retry."""
    count = F.char_length(digits_of(x["m"]))
    if kind == "ip":
        return octets(x["m"])
    if kind == "card":
        return luhn(digits_of(x["m"]))
    return (count >= 10) & (count <= 15) if kind == "phone" else F.lit(True)


def features(text: Column, kind: int, x: Column) -> list[Column]:
    """Small ints that describe the format and the context of a proposal."""
    match = x["m"]
    digits = digits_of(match)
    start = F.greatest(x["s"] - REACH, F.lit(0))
    left = F.substring(text, start + 1, x["s"] - start)
    right = F.substring(text, x["e"] + 1, F.lit(REACH))
    marks = F.regexp_extract_all(match, F.lit("[^A-Za-z0-9]+"), F.lit(0))
    flag = lambda c: F.when(c, 1).otherwise(0)
    name = KINDS[kind]
    shapes = {
        "email": r"(?i)(?:com|org|net|edu|io|info|de|fr|es|example)$",
        "card": r"^[0-9]{4}([^0-9]{0,3})[0-9]{4}\1[0-9]{4}\1[0-9]{4}$",
        "phone": r"[0-9]{3}[^0-9]{1,3}[0-9]{3}[^0-9]{1,3}[0-9]{4}$",
        "ip": r"^[0-9]+([^0-9]+)[0-9]+\1[0-9]+\1[0-9]+$",
    }
    return [
        F.lit(kind),
        F.least(F.char_length(digits), F.lit(20)),
        flag(F.char_length(digits).between(13, 19) & luhn(digits)) if name == "card" else F.lit(0),
        flag(octets(match)) if name == "ip" else F.lit(0),
        flag(match.rlike(r"^(?:\+|00)")),
        flag(left.rlike(r"[\p{L}\p{N}_]$")),
        flag(right.rlike(r"^[\p{L}\p{N}_]")),
        flag(left.rlike("[=\"'#/:]$")),
        flag(left.rlike(CUES[name])),
        flag(right.rlike(CUES[name])),
        flag(left.rlike(r"[0-9][\x20.,_/-]{1,3}$")),
        flag(right.rlike(r"^[\x20.,_/-]{1,3}[0-9]")),
        F.least(F.size(marks), F.lit(8)),
        F.least(F.size(F.array_distinct(marks)), F.lit(4)),
        flag(match.rlike(shapes[name])),
    ]


def of_kind(spans: Column, kind: int) -> Column:
    """Spans with their kind: array<struct<s, k, e, m>>."""
    return F.transform(
        spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), x["m"].alias("m"))
    )


def candidates(text: Column) -> Column:
    """Overlapping proposals of all generators: array<struct<s, k, e, m>>."""
    return F.array_distinct(F.concat(*[of_kind(located(text, "", p), i) for i, k in enumerate(KINDS) for p in LOOSE[k]]))


def feature_array(text: Column, x: Column) -> Column:
    chosen = F.when(x["k"] == 0, F.array(*features(text, 0, x)))
    for i in range(1, len(KINDS)):
        chosen = chosen.when(x["k"] == i, F.array(*features(text, i, x)))
    return chosen


def overlaps(base: Column, x: Column) -> Column:
    return F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))


def base_of(matches: dict[str, Column]) -> Column:
    """The strict spans of all kinds by start and kind: array<struct<s, k, e>>."""

    def sound(kind: str) -> Column:
        return F.filter(matches[kind], lambda x: valid(kind, x))

    kept = [of_kind(sound(k), i) for i, k in enumerate(KINDS)]
    return F.array_sort(F.transform(F.concat(*kept), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))


def rewritten(kind: Column, match: Column) -> Column:
    """A strict match as people obscure it: array<string>."""
    local, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    dots = lambda d: F.replace(domain, F.lit("."), F.lit(d))
    digits = digits_of(match)
    fours = lambda sep: F.concat_ws(sep, *[F.substring(digits, i, 4) for i in (1, 5, 9)], F.substring(digits, 13, 7))
    bare = F.replace(match, F.lit("+"), F.lit(""))
    plain = lambda sep: F.regexp_replace(bare, r"[\x20().-]+", sep)
    return (
        F.when(
            kind == 0,
            F.array(
                F.concat(local, F.lit(" @ "), domain),
                F.concat(local, F.lit("(at)"), domain),
                F.concat(local, F.lit(" [at] "), dots(" [dot] ")),
                F.concat(local, F.lit(" at "), dots(" dot ")),
                F.concat(local, F.lit("@"), dots("(dot)")),
            ),
        )
        .when(kind == 1, F.array(*[F.replace(match, F.lit("."), F.lit(d)) for d in (" . ", "[.]", "(.)", " dot ", "[dot]")]))
        .when(kind == 2, F.array(*[fours(sep) for sep in (".", "/", "_", "  ", " / ")]))
        .otherwise(F.array(F.concat(F.lit("00"), bare), bare, plain(" "), plain("."), F.concat(F.lit("+"), plain("/"))))
    )


def prepared(rows: DataFrame) -> DataFrame:
    """Each row of rows (with __text) with all that is looked up in its text, so that texts are read once.

    __held: whether the text is held out (a quarter is); __base: the sound strict spans; __marked: every strict match,
    sound (y = 1) or not, in its context; __fresh: proposals away from strict spans, with their features.
    """
    text = F.col("__text")
    matches = {k: F.col(f"__m_{k}") for k in KINDS}

    def judged(i: int, kind: str) -> Column:
        start = lambda x: F.greatest(x["s"] - 2 * REACH, F.lit(0))
        return F.transform(
            matches[kind],
            lambda x: F.struct(
                F.lit(i).alias("k"),
                x["m"].alias("m"),
                valid(kind, x).cast("int").alias("y"),
                F.substring(text, start(x) + 1, x["s"] - start(x)).alias("left"),
                F.substring(text, x["e"] + 1, F.lit(2 * REACH)).alias("right"),
            ),
        )

    found = rows.withColumns({f"__m_{k}": m for k, m in strict_matches(text).items()} | {"__cand": candidates(text)})
    found = found.withColumns(
        {
            "__held": F.pmod(F.xxhash64("__text", F.lit("part")), F.lit(4)) == 0,
            "__base": base_of(matches),
            "__marked": F.concat(*[judged(i, k) for i, k in enumerate(KINDS)]),
        }
    )
    fresh = F.transform(
        F.filter(F.col("__cand"), lambda x: ~overlaps(F.col("__base"), x)),
        lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), feature_array(text, x).alias("f")),
    )
    return found.withColumn("__fresh", fresh).drop("__cand", *[f"__m_{k}" for k in KINDS])


def examples(rows: DataFrame) -> DataFrame:
    """(held, natural, f, y) of the proposals that the trees learn from; rows are prepared.

    The validators' verdict on a span must not label that span, or the trees would only learn the validators. So
    every strict match, sound or not, is rewritten in the ways of `rewritten` and put back into its context; what the
    generators then propose there is labelled by what the match was before. A proposal of its kind that covers four
    fifths of a rewritten sound match is positive, all else that touches one is not, nor are proposals of its kind at
    an unsound match. What else the generators propose, in the texts as they are, away from strict spans, or of
    another kind at an unsound match, is natural: not known to be either. A quarter of the texts is held out.
    """
    text, held = F.col("__text"), F.col("__held").alias("held")
    spans = rows.select(held, F.explode("__marked").alias("x")).select(
        "held",
        F.col("x.k").alias("kind"),
        F.col("x.y").alias("sound"),
        F.col("x.left").alias("left"),
        F.col("x.right").alias("right"),
        F.explode(rewritten(F.col("x.k"), F.col("x.m"))).alias("v"),
    )
    window = spans.select(
        "held", "kind", "sound", F.concat("left", "v", "right").alias("__text"),
        F.char_length("left").alias("from"), (F.char_length("left") + F.char_length("v")).alias("to"),
    )
    touched = F.filter(candidates(text), lambda x: (x["s"] < F.col("to")) & (F.col("from") < x["e"]))
    covered = lambda x: F.least(x["e"], F.col("to")) - F.greatest(x["s"], F.col("from"))
    right_one = lambda x: (x["k"] == F.col("kind")) & (covered(x) * 5 >= (F.col("to") - F.col("from")) * 4)
    learned = window.select(
        "held",
        F.inline(
            F.transform(
                touched,
                lambda x: F.struct(
                    ((F.col("sound") == 0) & (x["k"] != F.col("kind"))).alias("natural"),
                    feature_array(text, x).alias("f"),
                    F.when(right_one(x), F.col("sound")).otherwise(0).alias("y"),
                ),
            )
        ),
    )
    unknown = F.transform(F.col("__fresh"), lambda x: F.struct(x["f"].alias("f"), F.lit(0).alias("y")))
    natural = rows.select(held, F.lit(True).alias("natural"), F.inline(unknown))
    return learned.unionByName(natural)


@dataclass
class Chooser:
    """Trees over all kinds, and for each kind a calibration and the calibrated score from which a proposal counts."""

    trees: BoostedTrees
    platt: list[Platt]
    thresholds: list[float]


def choose(histogram: list[tuple[bool, bool, list[int], int, int]], precision: float, spies: float = 0.05) -> Chooser:
    """Fits trees on (held, natural, features, positives, all) that are not held out; the rest sets thresholds.

    Natural proposals may be personal data that somebody wrote loosely. Known positives are the spies among them:
    trees are first fitted with all natural ones as negatives; those that then score like the known positives of
    their kind (all but the lowest share `spies`) are no evidence either way and go. The final trees, calibrations
    and thresholds do without them. A kind's threshold is its smallest calibrated held-out score from which on at
    least `precision` of the held-out proposals are positive; where there is none, it is `precision` itself, as
    calibrated scores estimate just that.
    """
    histogram = sorted(histogram)
    x = np.array([f for _, _, f, _, _ in histogram], dtype=int).reshape(-1, FEATURES)
    held, natural = (np.array([r[i] for r in histogram], dtype=bool) for i in (0, 1))
    good, n = (np.array([r[i] for r in histogram], dtype=float) for i in (3, 4))

    def fitted() -> BoostedTrees:
        return BoostedTrees().fit(x[~held], good[~held], n[~held])

    margin = fitted().margin(x)
    for k in range(len(KINDS)):
        known = np.flatnonzero((x[:, 0] == k) & ~held & (good > 0))
        known = known[np.argsort(margin[known], kind="stable")]
        if len(known):
            least = margin[known[np.searchsorted(np.cumsum(good[known]), spies * good[known].sum())]]
            n[natural & (x[:, 0] == k) & (margin >= least)] = 0
    trees = fitted()
    platt, thresholds = [], []
    for k in range(len(KINDS)):
        at = np.flatnonzero(held & (x[:, 0] == k) & (n > 0))
        margin = trees.margin(x[at])
        platt.append(Platt(margin, good[at], n[at]))
        score = platt[k](margin)
        order = np.argsort(-score, kind="stable")
        right, seen, score = np.cumsum(good[at][order]), np.cumsum(n[at][order]), score[order]
        last = np.r_[score[1:] < score[:-1], True] if len(score) else np.array([], dtype=bool)
        enough = np.flatnonzero(last & (right >= precision * seen) & (right > 0))
        thresholds.append(float(score[enough[-1]]) - 1e-9 if len(enough) else precision)
    return Chooser(trees, platt, thresholds)


def histogram_of(rows: DataFrame, most: int) -> list[tuple[bool, bool, list[int], int, int]]:
    """Counts of the distinct feature vectors of the examples in all rows, which are prepared or have __text.

    Features are small ints, so that texts share few vectors; more than `most` of them raise an error.
    """
    rows = rows if "__fresh" in rows.columns else prepared(rows)
    counts = examples(rows).groupBy("held", "natural", "f").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    found = counts.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} distinct feature vectors")
    return [(r["held"], r["natural"], list(r["f"]), int(r["pos"]), int(r["n"])) for r in found]


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string")),
        ),
        ",",
    )


def redact(text: Column, spans: Column) -> Column:
    """Each span (sorted by start) replaced by [KIND]; of overlapping ones the first wins."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x["s"] < acc["at"], acc).otherwise(
            F.struct(
                x["e"].alias("at"),
                F.concat(
                    acc["out"],
                    F.substring(text, acc["at"] + 1, x["s"] - acc["at"]),
                    F.element_at(names, x["k"] + 1),
                ).alias("out"),
            )
        ),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))


def find_pii(
    docs: DataFrame,
    *,
    text_col: str = "text",
    carry: list[str] | None = None,
    precision: float = 0.98,
    most: int = 1_000_000,
    with_redacted: bool = False,
) -> DataFrame:
    """Strict spans of personal data, plus proposals of the loose generators that the boosted trees accept.

    One projection reads all texts and stores what it finds in them, without the text unless it is asked for; documents
    never shuffle. The fit is on every document: it brings the counts of distinct feature vectors (at most `most`) to
    the driver. What was stored is then scored. Proposals that touch a strict span are left out; of
    accepted ones that overlap, the one with the highest calibrated score stays, then the first. Without examples
    in the corpus no proposal is ever certain, and none is accepted.

    Returned: the carried columns (default: all) with n_<kind> (strict spans), base_sha256 (digest of the strict
    spans), spans (all of them) and, if asked for, the redacted text; these replace input columns of such names. A
    null text counts as empty and has no spans.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    rows = docs.select(packed(carry), text_of(text_col).alias("__text"))
    found = prepared(rows)
    spans = store(found if with_redacted else found.drop("__text"))
    chooser = choose(histogram_of(spans, most), precision)
    base, fresh = F.col("__base"), F.col("__fresh")
    margins = F.transform(
        fresh,
        lambda x: F.struct(
            x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), chooser.trees.margin_column(lambda i: F.get(x["f"], F.lit(i))).alias("p")
        ),
    )

    def by_kind(x: Column, value) -> Column:
        chosen = F.when(x["k"] == 0, value(0))
        for k in range(1, len(KINDS)):
            chosen = chosen.when(x["k"] == k, value(k))
        return chosen

    scored = F.transform(
        margins,
        lambda x: F.struct(
            (-by_kind(x, lambda k: chooser.platt[k].column(x["p"]))).alias("p"), x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")
        ),
    )
    accepted = F.filter(scored, lambda x: -x["p"] >= by_kind(x, lambda k: F.lit(chooser.thresholds[k])))
    extra = F.aggregate(
        F.array_sort(accepted),
        F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)"),
        lambda acc, x: F.when(overlaps(acc, x), acc).otherwise(
            F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
        ),
    )
    spans = spans.withColumn("__spans", F.array_sort(F.concat(base, F.when(F.size(fresh) > 0, extra).otherwise(F.slice(base, 1, 0)))))
    # all results first: the carried columns may have names that ours would be mistaken for
    for i, k in enumerate(KINDS):
        spans = spans.withColumn(f"__n_{k}", counted(base, i))
    spans = spans.withColumn("__sha", F.sha2(joined(base), 256)).withColumn("__joined", joined(F.col("__spans")))
    if with_redacted:
        spans = spans.withColumn("__redacted", redact(F.col("__text"), F.col("__spans")))
    return spans.select(
        *unpacked(carry),
        *[F.col(f"__n_{k}").alias(f"n_{k}") for k in KINDS],
        F.col("__sha").alias("base_sha256"),
        F.col("__joined").alias("spans"),
        *([F.col("__redacted").alias("redacted")] if with_redacted else []),
    )
