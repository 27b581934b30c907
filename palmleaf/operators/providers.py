"""External providers: recognisers, translators, compound splitters.

Models and networks are not part of the engine.  A provider is an object with one
method on batches; tasks build it once and reuse it.  The defaults are disabled:
they answer null, with an ``error`` where the caller asks for one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.functions.text import strip
from palmleaf.operators import layout

RESULT = f"struct<{layout.PAGE_SCHEMA.replace(' array', ':array')}>"


class Recogniser(Protocol):
    def recognise(self, images: list[bytes]) -> list[dict]: ...


class Translator(Protocol):
    name: str

    def translate(self, texts: list[str]) -> list[str | None]: ...


class Splitter(Protocol):
    def split_all(self, word: str) -> list[tuple[str, str]]: ...


_made: dict[Callable, object] = {}


def _provider(make: Callable):
    """One provider a worker."""
    if make not in _made:
        _made[make] = make()
    return _made[make]


def recognise(images: DataFrame, make: Callable[[], Recogniser] | None, key: str = "img_id", content: str = "content") -> DataFrame:
    """key, page (parallel lists) and error of each image; a failing batch is tried
    image by image, and a failing image gets an error row."""
    kind = images.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, page {RESULT}, error string"
    fields = [f.split(" ")[0] for f in layout.PAGE_SCHEMA.split(", ")]
    page_type = pa.struct(
        [("rec_texts", pa.list_(pa.string())), ("rec_scores", pa.list_(pa.float64()))]
        + [(f, pa.list_(pa.list_(pa.list_(pa.float64())))) for f in fields[2:]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            pages, errors = [None] * len(raw), ["recogniser not available"] * len(raw)
            if make is not None:
                for k, data in enumerate(raw):
                    try:
                        found = _provider(make).recognise([data])[0]
                        found = found.get("res", found)
                        pages[k], errors[k] = {f: found.get(f) for f in fields}, None
                    except Exception as exc:  # a provider's failure is a row, never a task's failure
                        errors[k] = str(exc)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, page_type), pa.array(errors, pa.string())], names=[key, "page", "error"])

    return images.select(key, content).mapInArrow(run, schema)


def neural_answers(texts: DataFrame, make: Callable[[], Translator] | None, text: str = "cleaned") -> DataFrame:
    """(cleaned, english, source) of the texts that a translator changes."""
    distinct = texts.select(F.col(text).alias("cleaned")).distinct()
    if make is None:
        return distinct.select("cleaned", F.lit(None).cast("string").alias("english"), F.lit(None).cast("string").alias("source")).where("false")

    @F.pandas_udf("struct<english:string,source:string>")
    def ask(batch: pd.Series) -> pd.DataFrame:
        translator = _provider(make)
        try:
            answers = translator.translate(batch.tolist())
        except Exception:  # no answer: the next tier takes the text
            answers = [None] * len(batch)
        return pd.DataFrame({"english": answers, "source": [f"Neural MT ({translator.name})"] * len(batch)})

    asked = distinct.withColumn("a", ask("cleaned")).select("cleaned", "a.*")
    same = F.lower(strip(F.col("english"))) == F.lower(F.col("cleaned"))
    return asked.where(F.col("english").isNotNull() & (F.col("english") != "") & ~same & ~F.col("english").startswith("Translation unavailable"))


def compound_splits(word: Column, make: Callable[[], Splitter] | None = None, most: int = 3) -> Column:
    """array(struct(left, right)): the splits with the longest left part; empty for
    short words, failures or without a splitter."""
    none = F.array().cast("array<struct<left:string,right:string>>")
    if make is None:
        return F.when(word.isNotNull(), none)

    @F.pandas_udf("array<struct<left:string,right:string>>")
    def split(words: pd.Series) -> pd.Series:
        def one(w):
            try:
                found = sorted(_provider(make).split_all(w), key=lambda p: (-len(p[0]), p[0]))[:most]
            except Exception:  # irregular roots have no split
                return []
            return [{"left": a, "right": b} for a, b in found if a and b]

        return words.map(lambda w: one(w.strip()) if w and len(w.strip()) >= 4 else [])

    return split(word)
