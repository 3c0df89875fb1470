"""Similarity of strings by matching blocks (Arrow UDF: the ratio is defined by its algorithm, which SQL can't express)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple, float] = {}
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        if (x, y) not in seen:
            seen[x, y] = SequenceMatcher(None, x, y).ratio()
        out.append(seen[x, y])
    return pd.Series(out, dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """2 M / T of the matching blocks, frequent characters of long texts left out; not symmetric; null if either is."""
    return _ratio(a, b)


def compared(gt: Column, other: Column) -> Column:
    """1 if the text contains the ground truth, else the ratio to 2 decimals; the ratio is computed only where it is needed."""
    inside = F.contains(other, gt)
    return F.when(inside, F.lit(1.0)).otherwise(F.round(ratio(F.when(~inside, gt), F.when(~inside, other)), 2))
