"""Writers: partitioned tables instead of pickles, wide CSV, JSON records, binary files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrail.functions.text import safe_name


def write_parts(df: DataFrame, path: str, by: str = "f_name") -> None:
    """A parquet table by file name, so that reading one file's rows prunes to its folder; rows of a file are spread by size, not forced
    into one task."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def read_part(spark: SparkSession, path: str, value: str, by: str = "f_name", schema: T.StructType | None = None, needed: bool = False) -> DataFrame:
    """The rows of one file. schema: that of the table, without which a table of no rows can't be read; needed: no rows are an error."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(path).filter(F.col(by) == value)
    if needed and rows.isEmpty():
        raise ValueError(f"{path} has no rows of {value}")
    return rows


def write_wide_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_records(df: DataFrame, path: str, column: str = "record") -> None:
    """JSON lines of a column that holds JSON."""
    df.select(column).write.mode("overwrite").text(path)


def write_binary(df: DataFrame, folder: str, name: str, content: str, suffix: str = ".png") -> None:
    """Each row's bytes as a file of its own in a shared folder; names are made safe, existing files stay as they are."""
    rows = df.filter(F.col(content).isNotNull()).select(safe_name(F.col(name)).alias("n"), F.col(content).alias("c"))

    def save(part) -> None:
        os.makedirs(folder, exist_ok=True)
        for n, c in part:
            target = os.path.join(folder, n + suffix)
            if not os.path.exists(target):
                temporary = f"{target}.{os.getpid()}.tmp"
                with open(temporary, "wb") as f:
                    f.write(bytes(c))
                os.replace(temporary, target)  # a retried task leaves whole files

    rows.foreachPartition(save)
