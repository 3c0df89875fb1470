"""The extraction pipeline from documents to records, all documents in one plan.

Documents are read once and stay rows until their tests are known (``operators.documents``); what can't be extracted becomes a row of
errors, not an exception.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.functions.tokens import TEST_FAMILIES
from spectrail.operators import documents as D


def document_tests(docs: DataFrame, key: str, column: str, tokens_mark: float = 80, spaces_mark: float = 35, families: tuple[str, ...] = TEST_FAMILIES) -> DataFrame:
    """Rows (key, names, tests): the names of a document's segments in order and the tests in them."""
    segs = D.segment_arrays(docs, key, column, tokens_mark, spaces_mark)
    named = segs.select(key, F.transform("segments", lambda g: D.name_of(g["lines"])).alias("names"), "segments")
    return D.with_tests(named, families).drop("segments")


def extract(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, segment, name, hit, test_type, test_text) of all documents' segments with tests."""
    rows = document_tests(docs, key, column).select(key, "names", F.inline("tests"))
    return rows.select(key, F.col("segment").cast("bigint").alias("segment"), F.col("hit").cast("bigint").alias("hit"), "test_type", "test_text", F.get("names", F.col("segment") - 1).alias("name"))


def sequences(docs: DataFrame, key: str, column: str, gap: int = 4) -> DataFrame:
    """Rows (key, sequence, first_pos, last_pos, types): the test sequences of each document."""
    cut = document_tests(docs, key, column).select(key, F.posexplode_outer(D.runs(F.col("tests"), gap)).alias("sequence", "t")).filter("sequence is not null")
    return cut.select(
        key, (F.col("sequence") + 1).cast("bigint").alias("sequence"), F.get("t", F.lit(0))["hit"].cast("bigint").alias("first_pos"), F.element_at("t", -1)["hit"].cast("bigint").alias("last_pos"),
        F.transform("t", lambda x: x["test_type"]).alias("types"),
    )


def outcome(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, segments, tests, errors): how many segments with tests and tests each document has, and why not if there are none. Every
    document gives a row, so nothing is lost silently and no document stops the others."""
    found = D.adjusted(D.segment_arrays(docs.withColumn(column, F.coalesce(column, F.lit(""))), key, column)).select(key, F.size("segments").cast("bigint").alias("segments"), F.size("tests").cast("bigint").alias("tests"))
    blank = docs.select(F.col(key).alias("__k"), F.coalesce(F.trim(column), F.lit("")).eqNullSafe("").alias("__blank"))
    both = found.join(blank, found[key] == blank["__k"])
    why = F.when(F.col("__blank"), F.array(F.lit("no text"))).when(F.col("segments") == 0, F.array(F.lit("no segment with a test"))).otherwise(F.array().cast("array<string>"))
    return both.select(key, "segments", "tests", why.alias("errors"))
