"""python -m spectrail INPUT OUTPUT: the tests of all documents of a folder, as Parquet by file, a wide CSV and an error table.

INPUT holds PDF files (with a PDF library on the executors) or, with --suffix txt, plain texts.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spectrail.operators.tables import wide
from spectrail.plans.pipeline import extract
from spectrail.session import cut
from spectrail.sources import readers, sinks


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="spectrail", description=__doc__)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--suffix", default="pdf")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("spectrail").getOrCreate()
    pages = cut(readers.document_pages(readers.files(spark, a.input, a.suffix)))
    pages.filter("error is not null").select("path", "error").write.mode("overwrite").parquet(f"{a.output}/errors")
    whole = pages.filter("error is null").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("text"))
    docs = whole.withColumn("f_name", F.element_at(F.split("path", "/"), -1))
    tests = cut(extract(docs, "f_name", "text"))
    sinks.write_parts(tests, f"{a.output}/tests")
    sinks.write_wide_csv(wide(tests, ["f_name", "segment", "name"], "test_type", "test_text", "hit"), f"{a.output}/wide")


if __name__ == "__main__":
    main()
