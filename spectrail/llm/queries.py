"""Registered queries of the text problems and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spectrail.llm import leaks, lookalike, mojibake, scans, spam, tokenize
from spectrail.session import spread, table


def _p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nmr = table(spark, sf_dir, "nmr_data", "nmr_id", "raw_text")
    wide = table(spark, sf_dir, "wide_records", "wide_id", "c13_nmr", "ir")
    return lookalike.stack([("raw_text", nmr, "nmr_id", "raw_text"), ("c13_nmr", wide, "wide_id", "c13_nmr"), ("ir", wide, "wide_id", "ir")])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.pairs(spread(_p1_texts(spark, sf_dir)))


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.consistent(spread(_p1_texts(spark, sf_dir)))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.classes(spread(_p1_texts(spark, sf_dir)))


def _p3_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nmr = table(spark, sf_dir, "nmr_data", "nmr_id", "raw_text")
    gt = table(spark, sf_dir, "gt_tests", "gt_id", "test_text")
    return lookalike.stack([("raw_text", nmr, "nmr_id", "raw_text"), ("test_text", gt, "gt_id", "test_text")]).withColumnRenamed("id", "row_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair(spread(_p3_texts(spark, sf_dir)), ["fld", "row_id"], "text", text=False).select("fld", "row_id")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair(spread(_p3_texts(spark, sf_dir)), ["fld", "row_id"], "text").select("fld", "row_id", "restored")


def _p5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "wide_records", "wide_id", "h1_nmr")
    more = lookalike.stack([("h1_nmr", wide, "wide_id", "h1_nmr")]).withColumnRenamed("id", "row_id")
    return _p3_texts(spark, sf_dir).unionByName(more)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.read(spread(_p5_texts(spark, sf_dir)), ["fld", "row_id"], "text", text=False).select("fld", "row_id")


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.read(spread(_p5_texts(spark, sf_dir)), ["fld", "row_id"], "text").select("fld", "row_id", "repaired")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_column(spark, spread(table(spark, sf_dir, "documents", "doc_id", "text")), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(spread(table(spark, sf_dir, "documents", "doc_id", "text")), table(spark, sf_dir, "eval_items", "item_id", "text"), "doc_id", "text", "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.find_spam(spread(table(spark, sf_dir, "documents", "doc_id", "text")), "doc_id", "text")


def queries() -> dict:
    return {"p1_found": p1_found, "p1_texts": p1_texts, "p1_classes": p1_classes, "p3_found": p3_found, "p3_restored": p3_restored, "p5_found": p5_found, "p5_repaired": p5_repaired, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}


def oracle_sql() -> dict[str, str]:
    return {}
