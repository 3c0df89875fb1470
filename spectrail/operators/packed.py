"""Several values packed in one string as one row per value.

``skeleton`` masks the ordinary characters of a value and folds repetitions, so that values packed in the same way share one skeleton. The
distinct skeletons, far fewer than values, go through ``resolve``, which decides for each what separates its values and gives one extraction
pattern; the patterns are joined back and ``regexp_extract_all`` takes the values out by position. Masking, joining and extraction run in the
JVM. The rules are written first, so their size is known: up to BOUND bytes they are broadcast and the values don't move; beyond, the values
of each skeleton are spread over SALTS tasks, as one skeleton may be that of most values.

Kinds of field:
- ``paths``: file paths, separated by ; | , a line break, with or without quotes, or as a JSON list. A comma separates only behind a file
  suffix or a quote, as names hold commas; quotes protect separators.
- ``peaks``: a heading (method, conditions, axis) and peaks with their parentheses, separated by , ; | / tab or line break, quoted or not.
  A comma between digits belongs to the number where the text has other separators, and separates where it is the only one.
- ``numbers``: bare numbers between marks and units (``J1 = 7.8, J2 = 1.7 Hz``, ``7,8; 1,7 Hz``, ``[7.8, 1.7]``).

Defined results: null and blank values give no row, a single value one row, empty values none (they take no position); quotes and blanks
around a value are dropped; the text of a value is as written. Ties and repeated values keep their own positions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.session import cut

BOUND = 8 << 20
SALTS = 32
KINDS = ("paths", "peaks", "numbers")

#: The heading of a spectrum text: method, conditions in (nested) parentheses, axis. Fixed values.
HEADING = (
    r"(?s)^[\s\"']*(?:(?:\d{1,3}\s?[A-Z][a-z]?(?:\{[^}]*\})?[\s-]?NMR|NMR|FT-?IR|IR|HRMS|LRMS|MS)\b\s*)"
    r"(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?\s*[:,]?\s*"
    r"(?:(?:δ|ν(?:max)?|ṽ|m\s?/\s?z|ppm|cm\s?(?:-1|−1|⁻¹|–1))\s*)*(?:\(\s*(?:ppm|cm\s?(?:-1|−1|⁻¹)|m\s?/\s?z|δ)\s*\))?\s*[:=]?\s*"
)

#: A peak: a number or range, words right behind it, and its parentheses; %s is the decimal separator.
_PEAK = r"\d+(?:%s\d+)?(?:\s?[–−-]\s?\d+(?:%s\d+)?)?(?:\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?"


def body(value: Column, kind: str) -> Column:
    """The value without heading."""
    return F.regexp_replace(value, HEADING, "") if kind == "peaks" else value


def skeleton(value: Column, kind: str) -> Column:
    """The value with ordinary characters masked and repetitions folded.

    Of paths, in order: q a quoted value, e a file suffix at a value's end, a other characters, and the separators. Of peaks and numbers,
    whose separators may change from value to value, the set of: n a number with a decimal point, c one with a decimal comma, i an
    integer, and the separators.
    """
    s = body(value, kind)
    if kind == "paths":
        s = F.regexp_replace(s, r"[ \u00a0]*([;|,\n\r\t]|^|$)[ \u00a0]*", "$1")
        s = F.regexp_replace(s, r"\"[^\"]*\"|(?<![^;|,\[\n])'[^']*'(?=[;|,\]\n]|$)", "\u0002")
        s = F.regexp_replace(s, r"\.[A-Za-z0-9]{2,5}(?=[\"';|,\]\n\r\t]|$)", "\u0001")
        s = F.regexp_replace(s, r"[^\u0001\u0002;|,\n\r\t]+", "a")
        s = F.regexp_replace(s, r"a(?:,?a)+", "a")
        s = F.translate(s, "\u0001\u0002", "eq")
        for _ in range(2):
            s = F.regexp_replace(s, r"(.{1,8}?)\1+", "$1")
        return s
    if kind == "peaks":
        s = F.regexp_replace(s, r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)", "")
    s = F.regexp_replace(s, r"(?<![\d.,])\d{1,3},\d{1,2}(?![\d.])", "c")
    s = F.regexp_replace(s, r"\d+\.\d+", "n")
    s = F.regexp_replace(s, r"\d+", "i")
    s = F.regexp_replace(s, r"[^cni;,|/\t\r\n&]+", "")
    return F.array_join(F.array_sort(F.array_distinct(F.split(s, ""))), "")


def _resolve_one(skeleton: str, kind: str) -> str:
    """The extraction pattern of a skeleton; the whole match is a value, still with quotes around it."""
    if kind == "numbers":
        return r"(?<![\w.])[-−]?\d+(?:%s\d+)?" % ("," if "c" in skeleton and "n" not in skeleton else r"\.")
    if kind == "peaks":
        return _PEAK % ((",", ",") if "c" in skeleton and "n" not in skeleton else (r"\.", r"\."))
    quoted = r'"[^"]*"|(?<![^\s;|,\[])\'[^\']*\'(?=\s*(?:[;|,\]\n]|$))'
    if re.search(r"[;|\n\r\t]", skeleton):
        # a comma still separates behind a suffix
        return rf'{quoted}|[^;|,\n\r\t"\s](?:(?<!\.[A-Za-z0-9]{{2,5}}),|[^;|,\n\r\t"])*'
    if re.search("e,|q", skeleton):
        suffix = r"\.[A-Za-z0-9]{2,5}(?=\s*(?:,|\]\s*$|$))"
        return rf'{quoted}|[^\s,"\'\[\]](?:(?!{suffix})[^"])*{suffix}' + (r'|[^\s,"\'\[\]][^",]*' if skeleton.endswith("a") else "")
    return r"(?s)\S.*"


def resolve(skeletons: DataFrame, kind: str) -> DataFrame:
    """Rows (skeleton, pattern) for distinct skeletons."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(pattern=[_resolve_one(s, kind) for s in pdf["skeleton"]])

    return skeletons.mapInPandas(each, "skeleton string, pattern string")


def with_rules(values: DataFrame, rules: DataFrame, bound: int = BOUND) -> DataFrame:
    """The values with the pattern of their skeleton; rules of up to bound bytes are broadcast."""
    rules = cut(rules)
    size = rules.agg(F.coalesce(F.sum(F.octet_length("skeleton") + F.octet_length("pattern") + 32), F.lit(0))).first()[0]
    if size <= bound:
        return values.join(F.broadcast(rules), "skeleton")
    salted = rules.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    spread = values.withColumn("__salt", F.pmod(F.xxhash64(*values.columns), F.lit(SALTS)).cast("int"))
    return spread.join(salted.hint("shuffle_merge"), ["skeleton", "__salt"]).drop("__salt")


def split_packed(df: DataFrame, key: str, column: str, kind: str, bound: int = BOUND) -> DataFrame:
    """Rows (key, pos, val): one for each value of the column, pos from 0 in the order written."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    filled = df.select(F.col(key), F.col(column).alias("__v")).filter(F.col("__v").rlike(r"\S")).withColumn("skeleton", skeleton(F.col("__v"), kind))
    rules = resolve(filled.select("skeleton").distinct(), kind)
    text = body(F.col("__v"), kind)
    values = F.regexp_extract_all(text, F.col("pattern"), F.lit(0))
    trimmed = F.transform(values, lambda x: F.regexp_replace(x, r"^[\s\"']+|(?:(?<=\S)[\s\"']+|(?<=\w)\s*)$" if kind != "paths" else r"^[\s\"]+|^'(?=.*'\s*$)|[\s\"]+$|(?<=[A-Za-z0-9])'\s*$", ""))
    found = F.filter(trimmed, lambda x: x.rlike(r"\S"))
    # the outer form: the plain one makes the optimizer filter by the values, and so extract them twice
    return with_rules(filled, rules, bound).select(key, F.posexplode_outer(found).alias("pos", "val")).filter("val is not null").select(key, F.col("pos").cast("bigint").alias("pos"), "val")
