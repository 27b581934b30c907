"""Text clean-up as Column functions.

All stay inside the JVM; white space and word borders follow Python's Unicode
rules (see ``pyregex``).  A null text is null unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palmleaf.functions.pyregex import BLANK, SPACE, SPACES, pattern, replacement
from palmleaf.sources import literals

WS = f"[{SPACE}]"
# Character classes of the script.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FEFF}\x{FFFE}]"
SPLIT_MATRA = r"([क-हळक्षज्ञ])\s+([ािीुूृॄॢॣेैोौ्ंःँ॒॑])"
DELIMITER = r"\s*[•·*▪]+\s*"
ORPHAN_BAR = r"^[|।\s]+(?=[क-हअ-औ])"
STRAY_BRACKET = r"^[(\[{<]\s*|\s*[)\]}>]$"
COLON_VISARGA = r"([क-हअ-औा-ौ्])\s*:\s*"
DEVANAGARI = r"[ऀ-ॿ]"


def sub(text: Column, source: str, to: str, multiline: bool = False) -> Column:
    """Python's ``re.sub``."""
    return F.regexp_replace(text, pattern(source, multiline), replacement(to))


def strip(text: Column) -> Column:
    # a run is tried from its start only
    return F.regexp_replace(text, rf"^{WS}+|(?<!{WS}){WS}+\z", "")


def fields(text: Column) -> Column:
    """Python's ``str.split()``."""
    return F.filter(F.split(text, f"{WS}+"), lambda x: x != "")


def count(text: Column, char_class: str) -> Column:
    """How many characters are in a class."""
    return F.length(text) - F.length(F.regexp_replace(text, char_class, ""))


def remove_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def unix_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def dandas(text: Column) -> Column:
    """Bars and repeated dandas to spaced dandas; white space around them goes,
    line breaks included."""
    double = sub(text, r"(?:॥+|\|{2,}|।{2,})", " ॥ ")
    single = sub(double, r"(?<![।॥])(?:\s*[|।]\s*)(?![।॥])", " । ")
    return sub(single, r"\s*॥\s*", " ॥ ")


def by_line(text: Column, of) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), of), "\n")


def artifacts(text: Column) -> Column:
    return by_line(text, lambda x: sub(strip(sub(x, COLON_VISARGA, r"\1ः ")), STRAY_BRACKET, ""))


def manuscript(text: Column) -> Column:
    joined = sub(sub(text, DELIMITER, " • "), SPLIT_MATRA, r"\1\2")
    return by_line(joined, lambda x: strip(sub(x, ORPHAN_BAR, "")))


def squeeze_lines(text: Column) -> Column:
    """Blanks within lines become one; empty lines go."""
    lines = F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(x, f"[{BLANK}]+", " ")))
    return strip(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def clean(composed: Column, is_manuscript: bool = True) -> Column:
    """The whole clean-up of a composed (NFC) text; null and blank give ''."""
    out = dandas(remove_control(unix_lines(composed)))
    if is_manuscript:
        out = manuscript(out)
    return F.coalesce(squeeze_lines(artifacts(out)), F.lit(""))


def rewrite(composed: Column) -> Column:
    """The ordered rewrite rules, split signs and dandas of a composed text.

    Texts without a character that a rule starts from are left to ``strip``.
    """
    steps = [(p, r, m) for p, r, m in literals.rules()]
    full = reduce(lambda text, rule: sub(text, *rule), steps, composed)
    full = dandas(sub(full, SPLIT_MATRA, r"\1\2"))
    return F.when(composed.rlike("[ऀ-ॿ;!|]"), strip(full)).otherwise(strip(composed))


def sentences(composed: Column) -> Column:
    """Array of sentences: only the script and white space stay, dandas split."""
    kept = sub(composed, r"[^ऀ-ॿ\s]", "")
    joined = sub(kept, r"\s+([ा-्ॢॣ])", r"\1")
    parts = F.split(strip(sub(joined, r"\s+", " ")), "[।॥]+")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def one_line(composed: Column, dots: bool = True) -> Column:
    """Line breaks and tabs to blanks, blanks to one; dots after dandas go."""
    out = F.regexp_replace(F.regexp_replace(composed, "[\r\n\t]+", " "), " +", " ")
    if dots:
        out = sub(out, r"([।॥|])\s*\.+", r"\1")
    return strip(out)


# The three punctuation classes that keys lose.
PUNCT = {
    "dictionary": r"[।॥|\-_,.;:\n\r\t]+",
    "corpus": r"[।॥|\-_,.;:\n\r\t\"'!?()<>]+",
    "external": r"[।॥|\-_,.;:\n\r\t\"'!?()]+",
}


def strip_punct(text: Column, variant: str = "dictionary") -> Column:
    return strip(F.regexp_replace(text, PUNCT[variant], " "))


def corpus_key(text: Column) -> Column:
    """Without white space and dandas, dropped one by one: a search for their runs
    takes three times as long."""
    return F.translate(text, SPACES + "|।॥", "")


def english(text: Column) -> Column:
    """Translations without footnotes and chat markers."""
    out = F.regexp_replace(text, r"\*[^*]+(?:\*|\z)", "")
    out = sub(sub(out, r"### Human:\s*", ""), r"### Assistant:\s*", "")
    return strip(F.regexp_replace(out, " +", " "))


def padas(text: Column, least: int = 4) -> Column:
    """Parts between dandas, of a least length."""
    return F.filter(F.transform(F.split(text, "[।॥]+"), strip), lambda x: F.length(x) >= least)


def gloss(text: Column) -> Column:
    return strip(F.substring_index(text, "(", 1))


def tokens_of_script(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{DEVANAGARI}+"), F.lit(0))


def unsandhied(text: Column) -> Column:
    """Underscores to blanks; a leading marker goes."""
    return F.regexp_replace(F.translate(text, "_", " "), "^ल् ", "")


def edge_split(word: Column) -> Column:
    """struct(prefix, core, suffix) around a word's punctuation and digits."""
    head = F.regexp_extract(word, pattern(r"^([।॥०-९0-9\(\[\{\<\'\"–—\.\,\:\;\-\s]+)"), 1)
    tail = F.regexp_extract(word, pattern(r"([।॥०-९0-9\)\]\}\>\'\"–—\.\,\:\;\-\s]+)$").replace("$", r"\z"), 1)
    size = F.greatest(F.length(word) - F.length(head) - F.length(tail), F.lit(0))
    return F.struct(head.alias("prefix"), F.substring(word, F.length(head) + 1, size).alias("core"), tail.alias("suffix"))


def domain(stem: Column) -> Column:
    """The image domain in a file's stem."""
    return F.regexp_replace(stem, r"_\d+$", "")
