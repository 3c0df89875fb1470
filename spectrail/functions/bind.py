"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value as a lambda variable: it stands and is computed once, however often then uses it."""
    return F.transform(F.array(value), then)[0]
