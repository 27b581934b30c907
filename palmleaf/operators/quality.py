"""Phonotactic validity, phantom segments, candidate scores, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palmleaf.functions.pyregex import pattern
from palmleaf.functions.text import count, fields, strip

# The alphabet and the classes of the rules.
ALPHABET = (
    "अआइईउऊऋॠऌॡएऐओऔकखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह"
    "ािीुूृॄॢॣेैोौ्ंःँ॒॑॓॔०१२३४५६७८९।॥•· ॐऽ़"
    "0123456789-–—,.:;!?\"'“”‘’()[]{}/*\\#"
)
BASE = "[क-हअ-औॠॡॐ]"
CONSONANT = "[क-ह]"
MATRA = "[ािीुूृॄॢॣेैोौ]"
PUNCTUATION = r"[।॥०-९0-9•·\s\-–—,.:;!?\"'“”‘’()\[\]{}/*\\#]+"
PHANTOM_BASE = "[क-हअ-औॠॡॐ0-9a-zA-Z]"
PHANTOM_SIGN = "[ा-ौ्ंःँ॒॑]"
MARKS = ("।", "॥", "|", "||", ".", "-", "_")
#: A third equal consonant, or an equal unit after three.  No open repetition: the
#: JVM matches repeated groups recursively, and a long run would end it.
_REPEATED = rf"({CONSONANT})\1\1|(?:्?{CONSONANT}){{2}}(्?{CONSONANT})\2"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def dominant_share(text: Column, char_class: str = CONSONANT, least: int = 5) -> Column:
    """Share of the most common character of a class; 0 below ``least`` of them."""
    found = F.regexp_extract_all(text, F.lit(char_class), F.lit(0))
    most = F.array_max(F.transform(F.array_distinct(found), lambda c: F.size(F.filter(found, lambda x: x == c))))
    return F.when(F.size(found) >= least, most / F.size(found)).otherwise(F.lit(0.0))


def validity(text: Column, alphabet: str = ALPHABET, base: str = BASE, matra: str = MATRA) -> Column:
    """Share of the script's characters, lowered for what syllables do not allow;
    0.0 for null or blank, not rounded."""

    def rate(x: Column) -> Column:
        n_base = count(x, base)
        solid = F.length(x) - count(x, f"[{pattern(chr(92) + 's')[1:-1]}]")
        marks = x.rlike(rf"\A(?:{pattern(PUNCTUATION)})\z")
        share = n_base / F.greatest(solid, F.lit(1))
        ratio = count(x, _class(alphabet)) / F.greatest(F.length(x), F.lit(1))
        ratio = F.when(share < 0.35, ratio * 0.5).otherwise(ratio)
        noisy = F.exists(
            fields(x), lambda t: (F.length(t) >= 3) & ~t.rlike(base) & ~t.rlike(rf"\A(?:{pattern(PUNCTUATION)})\z")
        )
        lowered = (
            ratio
            - F.when(x.rlike(matra + matra), 0.30).otherwise(0.0)
            - F.when(x.rlike(_REPEATED), 0.50).otherwise(0.0)
            - F.when(dominant_share(x) > 0.40, 0.50).otherwise(0.0)
        )
        return (
            F.when(x == "", 0.0)
            .when((solid > 0) & (n_base == 0), F.when(marks, 1.0).otherwise(0.0))
            .when(share < 0.20, 0.0)
            .when(noisy, 0.0)
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), lowered)))
        )

    return _let(strip(F.coalesce(text, F.lit(""))), rate)


def is_phantom(text: Column) -> Column:
    """Segments of hardly anything but signs."""

    def test(x: Column) -> Column:
        counts = F.struct(count(x, PHANTOM_BASE).alias("base"), count(x, PHANTOM_SIGN).alias("signs"))
        return (x != "") & ~x.isin(*MARKS) & _let(counts, sparse)

    def sparse(n: Column) -> Column:
        base, signs = n["base"], n["signs"]
        total = base + signs
        thin = (total >= 5) & (base / F.greatest(total, F.lit(1)) < 0.28)
        return (signs >= 4) & ((base < 3) | thin)

    return _let(strip(F.coalesce(text, F.lit(""))), test)


def drop_phantoms(segments: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Segments without phantoms, and ``filtered`` a group; a group of phantoms
    only stays whole."""
    w = Window.partitionBy(by)
    marked = segments.withColumn("phantom", is_phantom(F.col(text)))
    some = F.max((~F.col("phantom")).cast("int")).over(w) == 1
    counted = marked.withColumns(
        {"some": some, "filtered": F.when(some, F.sum(F.col("phantom").cast("bigint")).over(w)).otherwise(F.lit(0))}
    )
    return counted.where(~F.col("phantom") | ~F.col("some")).drop("phantom", "some")


def candidate_score(text: Column, conf: Column, base: Column, valid: Column | None = None) -> Column:
    """Confidence raised by validity, lowered for lost or added length and for a
    lost verse end."""

    def rate(x: Column) -> Column:
        cand, ref = x["cand"], x["ref"]
        n, m = F.length(cand), F.length(ref)
        length = (
            F.when((m > 0) & (n < m), F.pow(n / F.greatest(m, F.lit(1)), F.lit(0.8)))
            .when((m >= 4) & (n > F.floor(m * 1.6)), F.pow(m / F.greatest(n, F.lit(1)), F.lit(0.8)))
            .otherwise(1.0)
        )
        ends = F.when(ref.endswith("॥") & ~cand.endswith("॥"), 0.85).otherwise(1.0) * F.when(
            ref.endswith("।") & ~(cand.endswith("।") | cand.endswith("॥")), 0.90
        ).otherwise(1.0)
        score = conf * (1.0 + 0.35 * (validity(cand) if valid is None else valid)) * length * ends
        return F.when((cand == "") | is_phantom(cand), 0.0).otherwise(score)

    return _let(F.struct(strip(text).alias("cand"), strip(F.coalesce(base, F.lit(""))).alias("ref")), rate)


def is_valid_candidate(text: Column, base: Column, conf: Column) -> Column:
    """Whether a recogniser's candidate may compete with the base text."""
    letters, signs = count(text, "[क-हअ-औ0-9a-zA-Z]"), count(text, PHANTOM_SIGN)
    before = count(F.coalesce(base, F.lit("")), "[क-हअ-औ0-9a-zA-Z]")
    return F.coalesce(
        (strip(text) != "")
        & ~is_phantom(text)
        & (letters > 0)
        & (letters / F.greatest(letters + signs, F.lit(1)) >= 0.50)
        & (signs <= F.floor(letters * 0.70))
        & ~text.rlike("[ुृॢ॒॑]{2,}|ु॒ु")
        & (dominant_share(text) <= 0.38)
        & ~text.rlike(_REPEATED)
        & ~((before >= 10) & (letters < F.floor(before * 0.55)))
        & (conf >= 0.50),
        F.lit(False),
    )


def calibrated(raw: Column, valid: Column, aligned: Column | None = None) -> Column:
    """Confidence from recogniser and validity, never below the raw one."""
    bonus = (valid >= 0.95) if aligned is None else (aligned | (valid >= 0.95))
    mixed = raw * 0.65 + valid * 0.35 + F.when(bonus, 0.05).otherwise(0.0)
    return F.greatest(raw, F.least(F.lit(1.0), mixed))
