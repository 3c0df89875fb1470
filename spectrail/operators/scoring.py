"""Scores of extracted records against ground truth, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.functions import peaks as P
from spectrail.functions.similarity import compared, ratio


def paired_tests(gt: DataFrame, other: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each ground-truth test with the first extracted test of its type.

    gt, other: keys, test_type, test_text; other is reduced to the first test of each key and type before the join.
    """
    first = other.groupBy(*keys, "test_type").agg(F.min_by("test_text", order).alias("other_text"))
    return gt.join(first, [*keys, "test_type"])


def test_scores(pairs: DataFrame, tol: float = 0.01) -> DataFrame:
    """Adds tp, fp, fn, precision, recall, f1 of the peaks of test_text and other_text, the last three to 2 decimals."""
    c = P.confusion(P.positions(F.col("test_text"), F.col("test_type")), P.positions(F.col("other_text"), F.col("test_type")), tol)
    with_c = pairs.withColumn("__c", c)
    tp, fp, fn = (F.col(f"__c.{x}") for x in ("tp", "fp", "fn"))
    p, r, f1 = P.precision_recall_f1(tp, fp, fn, 2)
    return with_c.select(*pairs.columns, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def smiles_score(a: Column, b: Column) -> Column:
    """Ratio of two structures' strings; null if either is missing."""
    both = a.isNotNull() & b.isNotNull() & (a != "") & (b != "")
    return ratio(F.when(both, a), F.when(both, b))


name_score = compared


def summary(scores: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, population and sample standard deviation of a column."""
    return scores.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std_pop"), F.stddev_samp(column).alias("std_samp"))


def metric_summary(records: DataFrame, means: list[str], sums: list[str]) -> DataFrame:
    return records.agg(*(F.avg(c).alias(f"mean_{c}") for c in means), *(F.sum(c).alias(f"sum_{c}") for c in sums))


def metric_filter(records: DataFrame, minimum: dict[str, float], perfect: bool = False, metric: str = "f1") -> DataFrame:
    """Records at or above all minimums; perfect: only those with the metric at 1."""
    keep = F.lit(True)
    for c, v in minimum.items():
        keep &= F.col(c) >= v
    return records.filter(keep & (F.col(metric) == 1.0 if perfect else F.lit(True)))


def entity_scores(pred: DataFrame, gold: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Rows (keys, tp, fp, fn, precision, recall, f1), one row without keys, of two sets of entities; nulls are no entities, repeated ones
    count once.

    One shuffle of the entities: both sides are marked and grouped.
    """
    keys = keys or []
    sides = pred.select(*keys, column, F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(gold.select(*keys, column, F.lit(0).alias("p"), F.lit(1).alias("g")))
    each = sides.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    counts = each.groupBy(*keys).agg(F.count_if(F.expr("p = 1 and g = 1")).alias("tp"), F.count_if(F.expr("p = 1 and g = 0")).alias("fp"), F.count_if(F.expr("p = 0 and g = 1")).alias("fn"))
    p, r, f1 = P.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(*keys, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def box_union(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The union of the corner boxes of each group as (x, y, w, h); x and y are rounded first, as w and h are measured from them."""
    u = boxes.groupBy(*keys).agg(F.min("x0").alias("__x0"), F.min("y0").alias("__y0"), F.max("x1").alias("__x1"), F.max("y1").alias("__y1"))
    x, y = F.round("__x0", 2), F.round("__y0", 2)
    return u.select(*keys, x.alias("x"), y.alias("y"), F.round(F.col("__x1") - x, 2).alias("w"), F.round(F.col("__y1") - y, 2).alias("h"))
