"""Test texts of a segment's line windows, and name resolution and models behind interfaces.

The cutting rules depend on each other in order and on positions in the joined text, so they run as one Arrow UDF over windows; every rule
by itself is also a Column expression in ``functions.text``.
"""

from __future__ import annotations

import re
import textwrap
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.functions.tokens import CHAPTER, ENDERS, LABEL_REPAIRS, STEREO_MARKS

_MARKS = re.compile(f"{CHAPTER}|{STEREO_MARKS}")
_LABELS = tuple((re.compile(pattern), label) for pattern, label in LABEL_REPAIRS)


def start_of(text: str, name: str) -> int | None:
    """Where the first word that holds the test's name begins; for NMR one word earlier, which holds the nucleus."""
    at = 0
    before = None
    for word in text.split(" "):
        if name in word:
            return before if "NMR" in name and before is not None else at
        before, at = at, at + len(word) + 1
    return None


def test_of(text: str, name: str) -> tuple[str, str] | None:
    """(type, text) of the test that a joined window holds; None without one, and for captions of figures."""
    while (start := start_of(text, name)) is not None:
        body = text[start:]
        again = body.find(name, 15)
        out = body[:again] if again >= 0 else body
        for ender in ENDERS:
            if ender != name and (m := out.find(ender)) >= 0:
                out = out[:m].rstrip()
                break
        bracket = out.rfind(")")
        if bracket >= 0 and ":" in out[: bracket + 1]:
            out = out[: bracket + 1]
        out = _MARKS.sub("", out)
        for pattern, label in _LABELS:
            out = pattern.sub(label, out)
        out = re.sub(r"\b([STDQ])(?=\s*,\s*J\s*=)", lambda m: m.group(1).lower(), out)
        first = out.split(" ")[0]
        junk = max(first.find(c) for c in ".;)")
        out = out[junk + 1 :]
        if out.strip():
            if "spectrum" in out or "Spectra" in out:
                return None
            kind = out[: out.find("R") + 1].strip() if "NMR" in name else "MS" if "MS" in name else name
            return (kind, out.strip()) if kind else None
        text = body[max(1, len(name)) :]
    return None


def tests(windows: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """Rows (key, hit, test_type, test_text): what each window (key, hit, text, name) holds of its family's tests."""
    kind = windows.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(k, h, *t) for k, h, text, name in zip(pdf[key], pdf["hit"], pdf["text"], pdf["word"]) if (t := test_of(text, name)) is not None]
            yield pd.DataFrame(found, columns=[key, "hit", "test_type", "test_text"])

    return windows.filter(F.col("word").isin(*names)).select(key, "hit", "text", "word").mapInPandas(cut, f"`{key}` {kind}, hit bigint, test_type string, test_text string")


def recovered(found: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Where a segment has only one of 1H and 13C, the other from its text if it is there: rows (key, test_type, test_text).

    texts: (key, text), one row a segment. 1H ends before 13C or the exact mass, 13C before the exact mass.
    """
    have = found.groupBy(key).agg(F.max((F.col("test_type") == "1H NMR").cast("int")).alias("h"), F.max((F.col("test_type") == "13C NMR").cast("int")).alias("c"))
    both = have.filter(F.col("h") != F.col("c")).join(texts, key)
    wanted = F.when(F.col("h") == 0, F.lit("1H NMR")).otherwise(F.lit("13C NMR"))
    h = F.regexp_extract("text", r"(?s)1H NMR.*?(?=13C NMR|HRMS|$)", 0)
    c = F.regexp_extract("text", r"(?s)13C NMR.*?(?=HRMS|$)", 0)
    return both.select(key, wanted.alias("test_type"), F.when(F.col("h") == 0, h).otherwise(c).alias("test_text")).filter("test_text <> ''")


def wrapped_lines(lines: DataFrame, keys: list[str], column: str, width: int = 250) -> DataFrame:
    """Rows (keys, piece, text): lines wider than width wrapped at words, others as they are."""

    @F.pandas_udf("array<string>")
    def wrap(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: textwrap.wrap(t, width) or [""])

    long = F.length(column) > width
    pieces = F.when(long, wrap(F.when(long, F.col(column)).otherwise(""))).otherwise(F.array(column))
    return lines.select(*keys, F.posexplode(pieces).alias("piece", "text")).withColumn("piece", F.col("piece").cast("bigint"))


def resolve_names(names: DataFrame, column: str, known: list[DataFrame], resolver: Callable[[str], str] | None = None) -> DataFrame:
    """Rows (column, smiles): each distinct name once, from the first of the known tables (column, smiles) that has it, else by a resolver
    (none by default: no network), else empty."""
    found = names.select(column).filter(F.col(column).isNotNull()).distinct()
    for i, table in enumerate(known):
        found = found.join(table.select(column, F.nullif("smiles", F.lit("")).alias(f"__{i}")), column, "left")
    first = F.coalesce(*(F.col(f"__{i}") for i in range(len(known))), F.lit(None).cast("string"))
    if resolver is None:
        return found.select(column, F.coalesce(first, F.lit("")).alias("smiles"))

    @F.pandas_udf("string")
    def ask(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else resolver(v))

    return found.select(column, F.coalesce(first, ask(F.when(first.isNull(), F.col(column))), F.lit("")).alias("smiles"))


def apply_model(df: DataFrame, column: str, load: Callable[[], Callable[[list], list]], result: str, kind: str = "string") -> DataFrame:
    """Adds result, a model's answers for a column. load runs once for each worker process and gives a function of a batch; any detector
    or recogniser plugs in here. Null inputs give null."""
    names = [*df.columns, result]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{result}` {kind}"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            values = pdf[column].tolist()
            some = [i for i, v in enumerate(values) if v is not None]
            answers: list = [None] * len(values)
            for i, a in zip(some, model([values[i] for i in some])):
                answers[i] = a
            pdf[result] = answers
            yield pdf[names]

    return df.mapInPandas(run, ddl)


def structure_or_image(name_smiles: Column, image_smiles: Column) -> Column:
    """The structure by image, else by name, else empty."""
    return F.coalesce(F.nullif(image_smiles, F.lit("")), F.nullif(name_smiles, F.lit("")), F.lit(""))
