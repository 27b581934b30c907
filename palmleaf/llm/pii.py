"""Format-preserving pseudonyms by keyed Feistel permutations.

Personal numbers, dates and addresses are found, validated, and replaced by
another valid value of the same format.  Each format is a finite domain, written
as a product of two ranges; a Feistel network over the two halves, with a keyed
hash as round function, permutes it.  The permutation depends only on key, format
and value: equal values become equal pseudonyms in all documents, different ones
stay different, and the key's holder can run the rounds backwards.

Formats: card (13-19 digits, Luhn; the first two digits stay and the check digit
is recomputed), phone (E.164 with ``+``, or ten digits with brackets or hyphens; valid
North American numbers stay valid), ip (IPv4), ssn, date (1900-01-01 to
2099-11-11, ISO or day first with ``/`` or ``.``), email (the local part, letter
for letter and digit for digit; the domain stays).

Everything is DataFrame and SQL functions; a text is rewritten where it is read.

Defined results: a null text stays null; a text without a valid value is
unchanged; values that fail validation are left alone; a one-character local part
may be its own pseudonym, as any permutation of a tiny domain, and is not counted
then; an empty table gives no row; repeated rows are rewritten alike; an input column
``pii`` gives way to the operator's, all others pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.spans import FENCE, let, parts, unescape

ROUNDS = 8

# Patterns of the formats.
#: The domain goes up to its last label that may be a top-level one.  Loops of groups
#: are possessive: the JVM matches others recursively, and a long text would end it.
EMAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
    r"(?:(?:\.(?![A-Za-z]{2,24}(?![A-Za-z0-9-]))[A-Za-z0-9-]++)*+\.[A-Za-z]{2,24}(?![A-Za-z0-9-]))++"
)
CARD = (
    r"(?<![\w])(?<!\d[-.])(?:[2-6]\d{12,18}|[2-6]\d{3}(?<s1>[ -])\d{4}\k<s1>\d{4}\k<s1>\d{1,7}|3[47]\d{2}(?<s2>[ -])\d{6}\k<s2>\d{5})"
    r"(?!\w|-\d)"
)
PHONE = (
    r"(?<![\w+])(?:\+[1-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\([2-9]\d{2}\) ?[2-9]\d{2}[-. ]\d{4}|\d{3}-\d{3}-\d{4})(?!\w|-\d)"
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"
SSN = r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"
DATE = (
    r"(?<![\w-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\w-])"
    r"|(?<![\w/.])(?:0?[1-9]|[12]\d|3[01])(?<s3>[/.])(?:0?[1-9]|1[0-2])\k<s3>(?:19|20)\d\d(?![\w/])"
)
PATTERN = "|".join((EMAIL, CARD, PHONE, IP, SSN, DATE))
KINDS = ("email", "card", "phone", "ip", "ssn", "date")


def _keyed(key: str, tweak: str, k: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), k.cast("string"), value.cast("string")), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: str, rounds: int = ROUNDS) -> Column:
    """Permutes Z_a x Z_b; returns struct(l, r).  Even rounds move l, odd ones r."""

    def step(acc: Column, k: Column) -> Column:
        even = k % 2 == 0
        mixed = _number(_keyed(key, tweak, k, F.when(even, acc["r"]).otherwise(acc["l"])))
        return F.struct(
            F.when(even, F.pmod(acc["l"] + F.pmod(mixed, a), a)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + F.pmod(mixed, b), b)).alias("r"),
        )

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step)


def _pow10(n: Column) -> Column:
    return F.get(F.array(*[F.lit(10**k).cast("bigint") for k in range(11)]), n)


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """Permutes the strings of as many digits (2 to 20)."""

    def halves(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        done = feistel(
            F.substring(d, F.lit(1), u).cast("bigint"), F.substring(d, u + 1, n).cast("bigint"), _pow10(u), _pow10(n - u), key, tweak
        )
        return let(done, lambda x: F.concat(F.lpad(x["l"].cast("string"), u, "0"), F.lpad(x["r"].cast("string"), n - u, "0")))

    return let(digits, halves)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in turn."""
    chars = F.split(shape, "")
    return F.array_join(
        F.transform(
            chars,
            lambda c, k: F.when(c.rlike("^[0-9]$"), F.substring(digits, F.length(_digits(F.substring(shape, F.lit(1), k + 1))), F.lit(1))).otherwise(c),
        ),
        "",
    )


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum where, from the right, places of parity ``doubled`` count twice."""
    return F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda c, k: let(c.cast("int") * F.when(k % 2 == doubled, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )


def _card(value: Column, key: str) -> Column:
    def valid(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substring(d, 1, 2), permute_digits(F.substring(d, F.lit(3), n - 3), key, "card"))
        full = let(body, lambda x: F.concat(x, F.pmod(-_luhn_sum(x, 0), F.lit(10)).cast("string")))
        return F.when(_luhn_sum(d, 1) % 10 == 0, refill(value, full)).otherwise(value)

    return let(_digits(value), valid)


def _phone(value: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        nanp = d.rlike(r"^1?[2-9]\d\d[2-9]\d{6}$") & (~value.startswith("+") | d.startswith("1"))
        last = F.substring(d, -10, 10)

        def region(t: Column) -> Column:
            # (area - 200) * 100 + first two of (exchange - 200); rest of exchange and line
            index = ((F.substring(t, 1, 3).cast("bigint") - 200) * 800 + F.substring(t, 4, 3).cast("bigint") - 200) * 10000 + F.substring(t, 7, 4).cast("bigint")
            done = let(index, lambda x: feistel(F.floor(x / 80000), x % 80000, F.lit(80000), F.lit(80000), key, "nanp"))
            return let(
                let(done, lambda x: x["l"] * 80000 + x["r"]),
                lambda x: F.concat(
                    (F.floor(x / 8000000) + 200).cast("string"),
                    (F.floor(x / 10000) % 800 + 200).cast("string"),
                    F.lpad((x % 10000).cast("string"), 4, "0"),
                ),
            )

        american = F.concat(F.substring(d, F.lit(1), F.length(d) - 10), let(last, region))
        other = F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), F.length(d)), key, "phone"))
        return (
            F.when(nanp, refill(value, american))
            .when((F.length(d) >= 8) & (F.length(d) <= 15), refill(value, other))
            .otherwise(value)
        )

    return let(_digits(value), of)


def _ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("bigint"))
    done = let(
        octets,
        lambda o: feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip"),
    )
    return let(
        done,
        lambda x: F.concat_ws(
            ".", *[y.cast("string") for y in (F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256)]
        ),
    )


def _ssn(value: Column, key: str) -> Column:
    # areas 001-665 and 667-899, groups 01-99, serials 0001-9999
    area = F.substring(value, 1, 3).cast("bigint")
    done = feistel(
        area - F.when(area > 666, 2).otherwise(1),
        (F.substring(value, 5, 2).cast("bigint") - 1) * 9999 + F.substring(value, 8, 4).cast("bigint") - 1,
        F.lit(898),
        F.lit(99 * 9999),
        key,
        "ssn",
    )
    return let(
        done,
        lambda x: F.concat_ws(
            "-",
            F.lpad((x["l"] + F.when(x["l"] > 664, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lpad((F.floor(x["r"] / 9999) + 1).cast("string"), 2, "0"),
            F.lpad((x["r"] % 9999 + 1).cast("string"), 4, "0"),
        ),
    )


#: Days from 1900-01-01 in the permuted range, as a product.
_DAYS = (292, 250)


def _date(value: Column, key: str) -> Column:
    iso = value.rlike(r"^\d{4}-")
    piece = F.split(value, "[-/.]")
    wide = F.length(value) == 10
    parsed = F.try_to_date(
        F.when(iso, value).otherwise(F.concat_ws("-", piece[2], F.lpad(piece[1], 2, "0"), F.lpad(piece[0], 2, "0"))), "yyyy-MM-dd"
    )
    days = F.datediff(parsed, F.lit("1900-01-01").cast("date"))
    sep = F.when(value.contains("."), ".").otherwise("/")

    def shown(x: Column) -> Column:
        day = F.date_add(F.lit("1900-01-01").cast("date"), (x["l"] * _DAYS[1] + x["r"]).cast("int"))
        return let(
            day,
            lambda t: F.when(iso, F.date_format(t, "yyyy-MM-dd"))
            .when(wide, F.concat(F.date_format(t, "dd"), sep, F.date_format(t, "MM"), sep, F.date_format(t, "yyyy")))
            .otherwise(F.concat(F.dayofmonth(t).cast("string"), sep, F.month(t).cast("string"), sep, F.year(t).cast("string"))),
        )

    done = let(days, lambda n: feistel(F.floor(n / _DAYS[1]), n % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]), key, "date"))
    return F.when(days.isNotNull() & (days >= 0) & (days < _DAYS[0] * _DAYS[1]), let(done, shown)).otherwise(value)


# The alphabets that an address keeps to.
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _shift(text: Column, digest: Column) -> Column:
    """Moves each character within its alphabet by a byte of the digest."""

    def one(c: Column, k: Column) -> Column:
        by = F.conv(F.substring(digest, (k % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for alphabet in _ALPHABETS:
            at = F.instr(F.lit(alphabet), c)
            out = F.when((F.length(c) == 1) & (at > 0), F.substring(F.lit(alphabet), F.pmod(at - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _email(value: Column, key: str) -> Column:
    at = F.instr(value, "@")
    half = F.floor((at - 1) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, at - 1 - half).alias("r"))

    def step(acc: Column, k: Column) -> Column:
        even = k % 2 == 0
        # the untouched half keys the other one
        moved = let(
            _keyed(key, "email", k, F.when(even, acc["r"]).otherwise(acc["l"])), lambda digest: _shift(F.when(even, acc["l"]).otherwise(acc["r"]), digest)
        )
        return F.struct(F.when(even, moved).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(moved).alias("r"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(5)), start, step)
    return let(done, lambda x: F.concat(x["l"], x["r"], F.substring(value, at, F.length(value))))


def kind_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(list(zip(KINDS, (EMAIL, CARD, PHONE, IP, SSN, DATE), strict=True))):
        out = F.when(value.rlike(rf"\A(?:{pattern})\z"), kind).otherwise(out)
    return out


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    made = {"email": _email, "card": _card, "phone": _phone, "ip": _ip, "ssn": _ssn, "date": _date}
    out = value
    for name, make in made.items():
        out = F.when(kind == name, make(value, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with rewritten texts and ``pii``: (kind, count) of values replaced.
    ``key`` is the permutations' secret."""
    if not key:
        raise ValueError("pseudonyms need a key")
    # whole rows in a struct: their columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    # a value has a digit or an @; other texts are not searched
    pieces = F.when(F.col("text").rlike("[0-9@]"), parts(F.col("text"), PATTERN))
    marked = rows.withColumn("pieces", F.when(F.size(pieces) > 1, pieces))
    sealed = F.transform(
        "pieces",
        lambda p, k: let(
            F.when(k % 2 == 1, kind_of(p)),
            lambda kind: F.struct(
                kind.alias("kind"), p.alias("was"), F.when(kind.isNull(), p).otherwise(pseudonym(p, kind, key)).alias("now")
            ),
        ),
    )
    done = marked.withColumn("sealed", sealed)
    kinds = F.transform(F.filter("sealed", lambda x: x["kind"].isNotNull() & (x["was"] != x["now"])), lambda x: x["kind"])
    counted = F.coalesce(
        let(
            kinds,
            lambda found: F.transform(
                F.array_sort(F.array_distinct(found)), lambda k: F.struct(k.alias("kind"), F.size(F.filter(found, lambda y: y == k)).alias("n"))
            ),
        ),
        F.array().cast("array<struct<kind:string,n:int>>"),
    )
    made = F.when(F.col("sealed").isNotNull(), unescape(F.array_join(F.transform("sealed", lambda x: x["now"]), ""))).otherwise(F.col("text"))
    columns = [made.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "pii"]
    return done.select(*columns, counted.alias("pii"))


__all__ = ["FENCE", "PATTERN", "feistel", "pseudonymise"]
