"""Queries of composite operators and of those that SQL can't express (checked for rows here, for results in the tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.operators import extraction as E
from spectrail.operators import grammar as G
from spectrail.operators import segments as S
from spectrail.plans import pipeline
from spectrail.session import spread, table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return S.document_lines(spread(table(spark, d, "documents", "doc_id", "text")), "doc_id", "text")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents", "doc_id", "text"))


def extracted_tests(spark, d):
    return pipeline.extract(_docs(spark, d), "doc_id", "text")


def extracted_sequences(spark, d):
    return pipeline.sequences(_docs(spark, d), "doc_id", "text").withColumn("types", F.array_join("types", ","))


def recovered_tests(spark, d):
    """Each gt molecule's joined texts as a segment: the missing one of 1H and 13C, where its text holds it."""
    g = table(spark, d, "gt_tests", "gt_id", "f_name", "molecule_name", "test_type", "test_text").filter("molecule_name is not null and test_text is not null")
    k = F.concat_ws("|", "f_name", "molecule_name").alias("segment")
    texts = g.groupBy(k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gt_id", "test_text"))), lambda x: x["test_text"]), " ").alias("text"))
    return E.recovered(g.select(k, "test_type"), texts, "segment")


def wrapped_lines(spark, d):
    return E.wrapped_lines(_lines(spark, d), ["doc_id", "seq"], "text", 120)


def grammar_nmr(spark, d):
    g = table(spark, d, "gt_tests", "gt_id", "test_type", "test_text").filter(F.col("test_type").isin("1H NMR", "13C NMR"))
    return G.shift_rows(G.parse_column(g, "gt_id", "test_text"), "gt_id")


def grammar_headers(spark, d):
    g = table(spark, d, "gt_tests", "gt_id", "test_type", "test_text").filter(F.col("test_type").isin("1H NMR", "13C NMR"))
    return G.parse_column(g, "gt_id", "test_text").select("gt_id", "nucleus", "frequency", "solvent", "temperature", "mixture", "error")


def modelled_pictures(spark, d):
    """The model interface with a stand-in for a recogniser: the length of a picture's path."""
    w = table(spark, d, "wide_records", "wide_id", "image_path")
    return E.apply_model(w, "image_path", lambda: lambda batch: [str(len(x)) for x in batch], "answer")


_NAMES = [extracted_tests, extracted_sequences, recovered_tests, wrapped_lines, grammar_nmr, grammar_headers, modelled_pictures]


def queries() -> dict:
    return {f.__name__: f for f in _NAMES}


def oracle_sql() -> dict[str, str]:
    return {
        "recovered_tests": """WITH g AS (SELECT concat_ws('|', f_name, molecule_name) AS segment, gt_id, test_type, test_text FROM gt_tests WHERE molecule_name IS NOT NULL AND test_text IS NOT NULL),
            s AS (SELECT segment, string_agg(test_text, ' ' ORDER BY gt_id, test_text) AS t, max(CASE WHEN test_type = '1H NMR' THEN 1 ELSE 0 END) AS h, max(CASE WHEN test_type = '13C NMR' THEN 1 ELSE 0 END) AS c FROM g GROUP BY segment),
            p AS (SELECT segment, h, t, CASE WHEN h = 0 THEN substr(t, instr(t, '1H NMR')) ELSE substr(t, instr(t, '13C NMR')) END AS u FROM s WHERE h <> c AND contains(t, CASE WHEN h = 0 THEN '1H NMR' ELSE '13C NMR' END)),
            e AS (SELECT *, nullif(instr(u, 'HRMS'), 0) AS a, CASE WHEN h = 0 THEN nullif(instr(u, '13C NMR'), 0) END AS b FROM p)
            SELECT segment, CASE WHEN h = 0 THEN '1H NMR' ELSE '13C NMR' END AS test_type, substr(u, 1, coalesce(least(a, b), a, b, length(u) + 1) - 1) AS test_text FROM e""",
    }
