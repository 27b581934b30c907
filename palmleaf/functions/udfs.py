"""Arrow UDFs for what the JVM lacks: composition and sequence similarity."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Texts of these characters only are composed already.
_COMPOSED = r"^[\x00-\x{02FF}]*\z"


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """NFC; only texts that may change travel to Python."""
    return F.coalesce(_compose(F.when(~text.rlike(_COMPOSED), text)), text)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    # the matcher prepares its second sequence, so equal ones are kept together
    out, last, matcher = [], None, difflib.SequenceMatcher(None)
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """Similarity of ``a`` to ``b``; not symmetric."""
    return _ratio(a, b)
