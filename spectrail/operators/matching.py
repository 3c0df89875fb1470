"""Pictures, their clusters, and their assignment to segments and of extracted molecules to ground truth."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spectrail.operators.sequences import numbered


def picture_clusters(pics: DataFrame, key: str, order: list[str], tolerance: float = 10) -> DataFrame:
    """Adds cluster (from 1): pictures in order of detection, a new one where the page changes or y is more than tolerance off the last."""
    w = Window.partitionBy(key, "page").orderBy(*order)  # a page always opens a cluster
    before = F.lag("y").over(w)
    marked = pics.withColumn("__open", before.isNull() | (F.abs(F.col("y") - before) > tolerance))
    return numbered(marked, [key], "page", order, F.col("__open"), "cluster").drop("__open")


def leading_pictures(clustered: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The picture of each cluster that lies furthest right, the first of equals; clusters without any right of 0 give no row."""
    w = Window.partitionBy(key, "cluster").orderBy(F.desc("x"), *order)
    return clustered.filter("x > 0").withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(key, "cluster", *columns)


def proximity(pics: DataFrame, segs: DataFrame, key: str, axis: str = "y", carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of pictures and segments that start on the same page, with the distance of the picture's centre from the segment's top.

    pics: (key, page, pic, x, y, w, h); segs: (key, start_page, segment, upper_y). axis "x" measures the centre's x.
    carry: columns of segs that the pairs keep.
    """
    centre = F.col("y") + F.col("h") / 2 if axis == "y" else F.col("x") + F.col("w") / 2
    joined = pics.join(segs.withColumnRenamed("start_page", "page"), [key, "page"])
    return joined.select(key, "page", "pic", "segment", F.abs(centre - F.col("upper_y")).alias("distance"), *carry)


def ranked(pairs: DataFrame, key: str) -> DataFrame:
    """Adds rank (from 1) within the document by distance, picture, segment."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("distance", "pic", "segment")).cast("bigint"))


def by_group(df: DataFrame, keys: list[str], order: list[str], solve: Callable[[list[tuple]], list[tuple]], schema: T.StructType) -> DataFrame:
    """solve(rows) for each group, its rows as tuples in order. Rows are hash-partitioned by the keys and sorted within partitions, then
    streamed in Arrow batches, so that millions of small groups cost no more than their rows (a pandas frame for each would)."""
    n = len(keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if group and group[0][:n] != row[:n]:
                    out.extend(solve(group))
                    group.clear()
                group.append(row)
            if len(out) > 10_000:
                yield batch()
                out.clear()
        if group:
            out.extend(solve(group))
        yield batch()

    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in schema.fields]
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(scan, schema)


def greedy_match(pairs: DataFrame, key: str, use_max: bool = False) -> DataFrame:
    """Rows (key, pic, segment): pairs in order of distance; taken while the picture is free and the segment under its cap.

    pairs carry min_cap and max_cap of their segment. First up to the min caps; with use_max the free pictures then up to the max caps. The scan is
    sequential, so it runs once for each document and page (pictures and segments pair within pages only), which also splits hot documents.
    """
    table = pairs.select(key, "page", "distance", "pic", "segment", "min_cap", "max_cap")

    def match(rows: list[tuple]) -> list[tuple]:
        used: set = set()
        filled: dict = {}
        out = []
        for cap in (5, 6)[: 1 + use_max]:
            for row in rows:
                pic, seg = row[3], row[4]
                if pic not in used and filled.get(seg, 0) < row[cap]:
                    used.add(pic)
                    filled[seg] = filled.get(seg, 0) + 1
                    out.append((row[0], pic, seg))
        return out

    schema = T.StructType([table.schema[c] for c in (key, "pic", "segment")])
    return by_group(table, [key, "page"], ["distance", "pic", "segment"], match, schema)


def filled_matched(segs: DataFrame, key: str, n_tests: str, n_pics: str) -> DataFrame:
    """Rows (key, filled, matched, rate): segments with tests, those of them with pictures, and their share to 2 decimals; documents without
    filled ones give no row."""
    filled = F.count_if(F.col(n_tests) > 0)
    matched = F.count_if((F.col(n_tests) > 0) & (F.col(n_pics) > 0))
    return segs.groupBy(key).agg(filled.alias("filled"), matched.alias("matched")).filter("filled > 0").withColumn("rate", F.round(F.col("matched") / F.col("filled"), 2))


# --- optimal assignment -------------------------------------------------------------------------------------------------------------


def assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a one-to-one assignment with the highest sum; rows may stay free at score 0. Shortest augmenting paths, O(n² m)."""
    n = score.shape[0]
    cost = np.hstack([-score, np.zeros((n, n))])
    m = cost.shape[1]
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        owner[0] = i
        j0 = 0
        least = np.full(m + 1, np.inf)
        done = np.zeros(m + 1, bool)
        while True:
            done[j0] = True
            i0 = owner[j0]
            free = ~done[1:]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better] = slack[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[owner[done]] += delta
            v[done] -= delta
            least[1:][free] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            owner[j0] = owner[j1]
            j0 = j1
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m - n + 1) if owner[j])


def best_assignment(scores: DataFrame, key: str, left: str, right: str, score: str = "score", threshold: float = 0.75) -> DataFrame:
    """Rows (key, left, right, score): the one-to-one pairs of highest total score in each group, of which those above threshold are kept.

    scores: only pairs above 0 are needed; pairs that are missing count as 0. A group must be of bounded size: key it by file and compound
    name or another block, as a dense problem takes the square of its rows.
    """

    def solve(rows: list[tuple]) -> list[tuple]:
        lefts, rights = sorted({r[1] for r in rows}), sorted({r[2] for r in rows})
        li, ri = {x: i for i, x in enumerate(lefts)}, {x: i for i, x in enumerate(rights)}
        matrix = np.zeros((len(lefts), len(rights)))
        for _, x, y, v in rows:
            matrix[li[x], ri[y]] = max(matrix[li[x], ri[y]], v)
        return [(rows[0][0], lefts[i], rights[j], float(matrix[i, j])) for i, j in assignment(matrix) if matrix[i, j] > threshold]

    positive = scores.filter(F.col(score) > 0).select(key, left, right, score)
    schema = T.StructType([*(positive.schema[c] for c in (key, left, right)), T.StructField(score, T.DoubleType())])
    return by_group(positive, [key], [left, right], solve, schema)


def mean_of_factors(factors: list[Column]) -> Column:
    """The mean of the factors that count, those above 0, to 2 decimals; 0 if none does."""
    return mean_of(F.array(*factors))


def mean_of(factors: Column) -> Column:
    """mean_of_factors of an array."""
    array = F.filter(factors, lambda x: x > 0)
    return F.round(F.when(F.size(array) > 0, F.aggregate(array, F.lit(0.0), lambda a, x: a + x) / F.size(array)).otherwise(F.lit(0.0)), 2)
