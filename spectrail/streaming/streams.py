"""Structured Streaming forms: late rows, duplicates, test sequences.

State is bounded by watermarks; results are those of the batch operators on the rows that weren't too late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_table(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A folder of parquet files as a stream, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def counts_by_window(rows: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "30 days") -> DataFrame:
    """Rows (start, by, n) for windows of event time; rows later than the watermark are left out."""
    grouped = rows.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("start"), by, "n")


def without_repeats(rows: DataFrame, keys: list[str], time: str, late: str = "30 days") -> DataFrame:
    """Rows of the same keys once within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sequences(rows: DataFrame, key: str, pos: str, kind: str, time: str, gap: int = 4, late: str = "1 day") -> DataFrame:
    """Rows (key, first_pos, last_pos, types): test sequences as positions arrive in order; one is given out when a gap closes it or when
    the watermark passes its last row."""
    key_type = rows.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, types, seen = state.get if state.exists else (None, None, "", 0)
        out = []
        if state.hasTimedOut:
            state.remove()
            if first is not None:
                yield pd.DataFrame([(k[0], first, last, types)], columns=[key, "first_pos", "last_pos", "types"])
            return
        latest = seen
        for pdf in batches:
            pdf = pdf.sort_values(pos, kind="stable")
            latest = max(latest, int(pdf[time].max().timestamp() * 1000))
            for p, t in zip(pdf[pos], pdf[kind]):
                p = int(p)
                if first is not None and abs(p - last) > gap:
                    out.append((k[0], first, last, types))
                    first = None
                if first is None:
                    first, types = p, str(t)
                else:
                    types += "," + str(t)
                last = p
        state.update((first, last, types, latest))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1) + 1)
        yield pd.DataFrame(out, columns=[key, "first_pos", "last_pos", "types"])

    return rows.withWatermark(time, late).groupBy(key).applyInPandasWithState(run, f"`{key}` {key_type}, first_pos bigint, last_pos bigint, types string", "first bigint, last bigint, types string, seen bigint", "append", GroupStateTimeout.EventTimeTimeout)
