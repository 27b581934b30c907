"""Secret scan: fixed shapes, and a battery of randomness tests.

Fixed shapes are assignments, access keys and long hexadecimal runs.  Beyond
them every run of 20 or more token characters is tested against the encoding it
seems to use (decimal, hexadecimal, base 32, base 36 or base 64): a chi-squared
test of alphabet uniformity, a Wald-Wolfowitz runs test of the upper against the
lower half of the alphabet, and the lag-one serial correlation.  Each is a normal
deviate; the sum of their squares is about chi-squared with three degrees of freedom
for random strings, so at most ``BOUND``, its 1 % point.

False discoveries are controlled by length.  The null hypothesis is a token made of
words.  Every stretch of some 4,096 characters of every text gives such a token, its
words run together in the styles of identifiers and cut to a length of a band, and these
pass the same battery; few texts give several a stretch, ``NULLS`` in all at least.  A token's p-value is the share
of its band's null tokens that look as random as it or more, and within each band the
Benjamini-Hochberg procedure accepts tokens up to a false-discovery rate of ``FDR``.
Only histograms by band and deviate are gathered, a fixed number of rows.

Everything is DataFrame and SQL functions; texts are read once, spans and
deviates are written to the shared folder and read back for the decision.

Defined results: kept columns named like an operator's own are left out; a null text is an empty one and has no span; spans are code
points, end exclusive; repeated rows are scanned once each; equal starts go in
the order of ``KINDS``; where no text has a word, nothing is known of the null
hypothesis and no random span is reported; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.common import stored, unclashed
from palmleaf.llm.spans import let, located, parts

# The shapes.
ASSIGN = r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGNED = 6

_OWN = ("assigns", "accesses", "hexes", "tokens", "nulls", "base", "extra", "spans", "n_assign", "n_access", "n_hex", "base_sha256")

FDR = 0.05
#: 1 % point of chi-squared with three degrees of freedom.
BOUND = 11.345
STEP = 0.25
#: Lower ends of the length bands.
BANDS = (20, 24, 32, 48, 96)
# Fixed values: (name, test, alphabet) of the encodings, narrowest first.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^(?=.*[A-Z])(?=.*[2-7])[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36_upper", r"^(?=.*[A-Z])(?=.*[0-9])[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base36", r"^(?=.*[a-z])(?=.*[0-9])[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
# Fixed value: a word, in one case or with a capital, that stands alone.
WORD = r"(?<![A-Za-z0-9+/_=-])(?:[A-Z]?[a-z]+|[A-Z]+)(?![A-Za-z0-9+/_=-])"
#: Null tokens of all bands together, at least.
NULLS = 2000
#: Characters of which words of a null token are taken, and its least length.
_NULL_SPAN, NULL_LEAST = 240, 20
# Fixed value: a stretch of a text, the last one with a rest that is too short to be one.
STRETCH = r"(?s).{1,4096}(?:.{1,239}\z)?"


def _choose(token: Column, values: list) -> Column:
    out = F.lit(values[-1])
    for (_, test, _), value in reversed(list(zip(ENCODINGS[:-1], values[:-1], strict=True))):
        out = F.when(token.rlike(test), F.lit(value)).otherwise(out)
    return out


def deviate(token: Column) -> Column:
    """Sum of the squared deviates of the three tests, as far as they speak
    against randomness."""
    body = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")

    def tests(x: Column) -> Column:
        s, alphabet = x["s"], x["alphabet"]
        n, k = F.length(s).cast("double"), F.length(alphabet).cast("double")
        codes = F.transform(F.split(s, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        return let(F.struct(codes.alias("v"), n.alias("n"), k.alias("k"), s.alias("s")), battery)

    def battery(x: Column) -> Column:
        n, k, s = x["n"], x["k"], x["s"]
        squares = F.aggregate(
            F.array_distinct(F.split(s, "")),
            F.lit(0.0),
            lambda a, c: a + F.pow((n - F.length(F.replace(s, c, F.lit("")))).cast("double"), F.lit(2.0)),
        )
        # one pass: the last code, sums, products of neighbours, upper codes and runs
        zero = F.lit(0.0)
        start = F.struct(F.lit(-1.0).alias("last"), *[zero.alias(c) for c in ("first", "sum", "power", "lagged", "ones", "runs")])

        def step(a: Column, c: Column) -> Column:
            begins = a["last"] < 0
            return F.struct(
                c.alias("last"),
                F.when(begins, c).otherwise(a["first"]).alias("first"),
                (a["sum"] + c).alias("sum"),
                (a["power"] + c * c).alias("power"),
                F.when(begins, zero).otherwise(a["lagged"] + c * a["last"]).alias("lagged"),
                (a["ones"] + (c >= k / 2).cast("double")).alias("ones"),
                (a["runs"] + (begins | ((c >= k / 2) != (a["last"] >= k / 2))).cast("double")).alias("runs"),
            )

        sums = F.aggregate(x["v"], start, step)
        return let(F.struct(sums.alias("t"), squares.alias("squares"), n.alias("n"), k.alias("k")), deviates)

    def deviates(x: Column) -> Column:
        t, n, k = x["t"], x["n"], x["k"]
        uniform = (k / n * x["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        mean_runs = 2 * t["ones"] * (n - t["ones"]) / n + 1
        spread = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        runs = F.when(spread > 1e-9, (t["runs"] - mean_runs) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(F.lit(10.0))
        mean = t["sum"] / n
        power = t["power"] - n * mean * mean
        lagged = t["lagged"] - mean * (2 * t["sum"] - t["first"] - t["last"]) + (n - 1) * mean * mean
        serial = F.when(power > 1e-9, (lagged / F.greatest(power, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.lit(10.0))
        return uniform * uniform + runs * runs + serial * serial

    alphabets = _choose(token, [a for _, _, a in ENCODINGS])
    known = F.struct(body.alias("s"), alphabets.alias("alphabet"))
    return F.when(F.length(body) >= 8, let(known, tests)).otherwise(F.lit(1e6))


def band(length: Column) -> Column:
    out = F.lit(BANDS[0])
    for low in BANDS[1:]:
        out = F.when(length >= low, F.lit(low)).otherwise(out)
    return out


def null_tokens(text: Column, each: int) -> Column:
    """(band, deviate) of ``each`` tokens made of the words of each stretch of the text."""

    def token(part: Column, seed: Column) -> Column:
        at = F.pmod(F.shiftright(seed, 8), F.greatest(F.length(part) - _NULL_SPAN + 1, F.lit(1)).cast("bigint")).cast("int")
        found = F.array_join(F.regexp_extract_all(F.substring(part, at + 1, F.lit(_NULL_SPAN)), F.lit(WORD), F.lit(0)), " ")
        # a text of few words repeats them
        words = let(found, lambda x: F.repeat(F.concat(x, F.lit(" ")), F.when(x == "", 0).otherwise(F.ceil(_NULL_SPAN / F.greatest(F.length(x), F.lit(1)))).cast("int")))
        low = F.get(F.array(*map(F.lit, BANDS)), F.pmod(seed, F.lit(len(BANDS))).cast("int"))
        size = low + F.pmod(F.shiftright(seed, 24), F.floor(low / 4)).cast("int")
        return let(let(words, lambda x: F.substring(F.replace(styled(x, F.pmod(F.shiftright(seed, 3), F.lit(4))), F.lit(" ")), F.lit(1), size)), tested)

    def styled(words: Column, style: Column) -> Column:
        return (
            F.when(style == 0, F.lower(words))
            .when(style == 1, F.initcap(words))
            .when(style == 2, F.regexp_replace(F.initcap(words), "(?<=[a-z]) (?=[A-Z][a-z] )", "2024"))
            .otherwise(F.translate(words, " ", "_"))
        )

    def tested(x: Column) -> Column:
        return F.struct(band(F.length(x)).alias("band"), F.when(F.length(x) >= NULL_LEAST, deviate(x)).alias("deviate"))

    def tokens(part: Column) -> Column:
        seeds = F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda k: F.xxhash64(part, k))
        return F.filter(F.transform(seeds, lambda seed: let(seed, lambda s: token(part, s))), lambda x: x["deviate"].isNotNull())

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(STRETCH), F.lit(0)), tokens))


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", each: int = 1) -> DataFrame:
    """``keep`` columns and the spans of each kind; ``tokens`` are candidates with
    their deviates, ``nulls`` the bands and deviates of null tokens."""
    text = F.col(text_col)

    def found(kind: str, hint: str, pattern: str) -> Column:
        none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
        return F.when(text.rlike(hint), located(parts(text, pattern), kind)).otherwise(none)

    assigned = F.filter(
        found("assign", ASSIGN, ASSIGN), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 1)) >= MIN_ASSIGNED
    )
    bare = lambda a: F.transform(a, lambda x: F.struct(x["kind"], x["start"], x["end"]))
    tested = F.transform(
        found("random", TOKEN, TOKEN),
        lambda x: F.struct(x["kind"], x["start"], x["end"], band(F.length(x["value"])).alias("band"), deviate(x["value"]).alias("deviate")),
    )
    return docs.select(
        *keep,
        bare(assigned).alias("assigns"),
        bare(found("access", ACCESS, ACCESS)).alias("accesses"),
        bare(found("hex", HEX, HEX)).alias("hexes"),
        tested.alias("tokens"),
        null_tokens(F.coalesce(text, F.lit("")), each).alias("nulls"),
    )


def accepted_up_to(tokens: dict[int, int], nulls: dict[int, int], fdr: float = FDR) -> float:
    """Benjamini-Hochberg on one band: counts of tokens and of null tokens by cell of
    the deviate.  The bound is the upper end of the last cell up to which the p-value
    times the number of tokens is at most ``fdr`` of the tokens accepted."""
    known, m = sum(nulls.values()), sum(tokens.values())
    bound, below, got = -1.0, 0, 0
    for cell in range(_CELLS):
        below += nulls.get(cell, 0)
        got += tokens.get(cell, 0)
        if got and (1 + below) / (1 + known) * m <= fdr * got:
            bound = min(BOUND, (cell + 1) * STEP)
    return bound


#: Cells of deviates up to the bound; one more holds all larger ones.
_CELLS = int(BOUND / STEP) + 1


def thresholds(scanned: DataFrame, fdr: float = FDR) -> dict[int, float]:
    """Acceptance bound of each length band, from histograms of fixed size."""
    cell = F.least(F.floor(F.col("t.deviate") / STEP), F.lit(_CELLS)).cast("int")
    flat = lambda c, null: scanned.select(F.explode(c).alias("t")).select(F.col("t.band").alias("band"), cell.alias("cell"), F.lit(null).alias("null"))
    hist = flat("tokens", 0).union(flat("nulls", 1)).groupBy("band", "cell", "null").agg(F.count("*").alias("n"))
    counts: dict[int, tuple[dict[int, int], dict[int, int]]] = {low: ({}, {}) for low in BANDS}
    for r in hist.collect():  # at most bands x cells x 2 rows
        counts[r["band"]][r["null"]][r["cell"]] = r["n"]
    return {low: accepted_up_to(*c, fdr) for low, c in counts.items()}


def find(docs: DataFrame, keep: list[str], text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """``keep`` columns and ``spans``: (start, rank, end) in order, where rank is
    the kind's place in ``KINDS``, with ``base`` for those of the fixed shapes."""
    keep = unclashed(keep, *_OWN)
    each = max(1, -(-NULLS // max(1, docs.count())))
    scanned = stored(scan(docs, keep, text_col, each), "secrets")
    bounds = thresholds(scanned, fdr)
    accepted = F.filter("tokens", lambda x: x["deviate"] <= _by_band(x["band"], bounds, F.lit(-1.0)))
    ranked = lambda c, rank: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))
    base = F.array_sort(F.concat(ranked(F.col("assigns"), 0), ranked(F.col("accesses"), 1), ranked(F.col("hexes"), 2)))
    done = scanned.withColumns({"base": base, "extra": ranked(accepted, 3)})
    return done.select(*keep, "assigns", "accesses", "hexes", "base", F.array_sort(F.concat("base", "extra")).alias("spans"))


def _by_band(column: Column, bounds: dict[int, float], otherwise: Column) -> Column:
    out = otherwise
    for low, bound in bounds.items():
        out = F.when(column == low, F.lit(bound)).otherwise(out)
    return out


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def report(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_assign, n_access, n_hex, base_sha256 and spans."""
    keep = unclashed(keep, *_OWN)
    return find(docs, keep).select(
        *keep,
        F.size("assigns").cast("bigint").alias("n_assign"),
        F.size("accesses").cast("bigint").alias("n_access"),
        F.size("hexes").cast("bigint").alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
