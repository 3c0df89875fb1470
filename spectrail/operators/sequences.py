"""Ordered operators: islands, sequences of tests, common sequences, sizes, merging.

All orders are made total by the caller; ties would otherwise be arbitrary across partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrail.session import cut


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers (from 1) the runs between rows at which breaks is true; the first row of a group always opens one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    opens = F.when(first | F.coalesce(breaks, F.lit(False)), 1).otherwise(0)
    return df.withColumn("__o", opens).withColumn(name, F.sum("__o").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__o")


def numbered(df: DataFrame, keys: list[str], part: str, order: list[str], opens: Column, name: str) -> DataFrame:
    """Numbers (from 1 in each group) the runs that begin where opens is true, with groups cut into parts in order.

    Each part is sorted by itself; only one row a part is ordered over the whole group, so a group that holds much of the table is spread.
    """
    local = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("__o", F.when(opens, 1).otherwise(0))
    totals = marked.groupBy(*keys, part).agg(F.sum("__o").alias("__n"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return marked.withColumn("__l", F.sum("__o").over(local)).join(offsets, [*keys, part]).withColumn(name, F.col("__l") + F.col("__before")).drop("__o", "__l", "__before")


def test_sequences(tests: DataFrame, key: str, start: str, end: str, kind: str, tie: str, gap: int = 4, part: int = 10_000) -> DataFrame:
    """Rows (key, sequence, first_pos, last_pos, types): a new sequence where a test starts more than gap lines off the last one's end.

    start is a whole number. Documents are cut every part lines, and each part's tests, sorted, are written once; the first test of a part is
    compared with the last of the one before, and only a sequence that goes over parts is put together from them.
    """
    row = F.struct(F.col(start).alias("a"), F.col(tie).alias("t"), F.col(end).alias("e"), F.col(kind).alias("k"))
    placed = tests.filter(F.col(start).isNotNull()).withColumn("__p", F.floor(F.col(start) / part))
    parts = cut(placed.groupBy(key, "__p").agg(F.array_sort(F.collect_list(row)).alias("__l")))
    off = lambda i: (i > 0) & (F.abs(F.get("__l", i)["a"] - F.get("__l", i - 1)["e"]) > gap)
    opens = F.filter(F.sequence(F.lit(0), F.size("__l") - 1), off)
    ends = parts.select(key, "__p", F.get("__l", F.lit(0))["a"].alias("__first"), F.element_at("__l", -1)["e"].alias("__last"), F.size(opens).alias("__n"))
    w = Window.partitionBy(key).orderBy("__p")
    new = F.lag("__last").over(w).isNull() | (F.abs(F.col("__first") - F.lag("__last").over(w)) > gap)
    numbers = ends.withColumn("__new", new).withColumn("__m", F.col("__n") + F.col("__new").cast("int"))
    numbers = numbers.select(key, "__p", (F.coalesce(F.sum("__m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__new").cast("int")).alias("__before"))
    # the first run of a part may go on from the part before
    runs = parts.select(key, "__p", "__l", F.concat(F.array(F.lit(0)), opens).alias("__o"))
    cuts = F.transform("__o", lambda s, i: F.slice("__l", s + 1, F.coalesce(F.get("__o", i + 1), F.size("__l")) - s))
    each = runs.join(numbers, [key, "__p"]).select(key, "__before", F.posexplode(cuts).alias("__i", "__r"))
    pieces = each.select(key, (F.col("__before") + F.col("__i")).cast("bigint").alias("sequence"), "__r")
    whole = pieces.groupBy(key, "sequence").agg(F.array_sort(F.flatten(F.collect_list("__r"))).alias("__r"))
    return whole.select(
        key, "sequence", F.get("__r", F.lit(0))["a"].alias("first_pos"), F.array_max(F.transform("__r", lambda x: x["e"])).alias("last_pos"), F.transform("__r", lambda x: x["k"]).alias("types")
    )


def common_sequence(sequences: DataFrame, order: list[str], types: str = "types") -> DataFrame:
    """The most frequent type sequence and its count; of equals the one met first by order. Counted before anything is gathered."""
    counted = sequences.groupBy(types).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("__first"))
    return counted.orderBy(F.desc("n"), "__first").limit(1).select(types, "n")


def occurrences(source: Column, target: Column) -> Column:
    """How often target stands in source as a contiguous part; overlaps count; 0 if it is longer."""
    n, m = F.size(source), F.size(target)
    return F.when((n >= m) & (m > 0), F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), lambda i: F.slice(source, i, m) == target))).otherwise(F.lit(0))


def _one(common: DataFrame, types: str) -> Column | None:
    row = common.select(types).first()
    return None if row is None else F.array(*(F.lit(x) for x in row[0]))


def segment_sizes(sequences: DataFrame, common: DataFrame, types: str = "types") -> DataFrame:
    """Adds size, max_molecules and min_molecules: tests per common sequence, and that rounded up against the occurrences.

    common has one row by construction (see common_sequence); it is taken as a literal. Without one there are no rows.
    """
    target = _one(common, types)
    if target is None:
        sequences, target = sequences.limit(0), F.array(F.lit(""))
    size = F.size(types) / F.size(target)
    up, times = F.ceil(size), occurrences(F.col(types), target)
    return sequences.select(*sequences.columns, size.alias("size"), F.greatest(up, times).cast("bigint").alias("max_molecules"), F.least(up, times).cast("bigint").alias("min_molecules"))


def classes(sized: DataFrame) -> DataFrame:
    """Adds class: complete, incomplete (less than one common sequence) or empty."""
    return sized.withColumn("class", F.when(F.col("size") == 0, "empty").when(F.col("size") < 1, "incomplete").otherwise("complete"))


def neighbours_to_merge(sized: DataFrame, key: str, order: str, common: DataFrame, types: str = "types") -> DataFrame:
    """Rows (key, order, next): incomplete segments that give a common sequence together with the next one."""
    w = Window.partitionBy(key).orderBy(order)
    target = _one(common, types)
    if target is None:
        sized, target = sized.limit(0), F.array(F.lit(""))
    paired = sized.withColumn("next", F.lead(order).over(w)).withColumn("__t", F.lead(types).over(w))
    together = occurrences(F.concat(F.col(types), F.coalesce("__t", F.array().cast("array<string>"))), target)
    return paired.filter((F.size(types) < F.size(target)) & F.col("next").isNotNull() & (together > 0)).select(key, order, "next")


def merge_pairs(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Chains of pairs that share a member with the one before, as rows (key, chain, members sorted)."""
    w = Window.partitionBy(key).orderBy(a, b)
    apart = (F.col(a) != F.lag(b).over(w)) & (F.col(a) != F.lag(a).over(w))
    chained = islands(pairs, [key], [a, b], apart, "chain")
    return chained.groupBy(key, "chain").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(a, b))))).alias("members"))


def runs_of_numbers(df: DataFrame, key: str, number: str) -> DataFrame:
    """Runs of consecutive numbers: rows (key, first_n, last_n, n)."""
    w = Window.partitionBy(key).orderBy(number)
    d = df.select(key, number).distinct().withColumn("__g", F.col(number) - F.row_number().over(w))
    return d.groupBy(key, "__g").agg(F.min(number).alias("first_n"), F.max(number).alias("last_n"), F.count(F.lit(1)).alias("n")).drop("__g")


def in_blocks(df: DataFrame, key: str, order: str, behind: int, ahead: int, part: int = 10_000, block: int = 10_000) -> DataFrame:
    """Adds __i (place in the group, from 0), __block, and __own: rows in blocks of a group, each with the rows that stand up to behind before
    and ahead after it, which aren't its own. order is a whole number, and unique in a group."""
    placed = numbered(df.withColumn("__p", F.floor(F.col(order) / part)), [key], "__p", [order], F.lit(True), "__n").drop("__p")
    i = F.col("__n") - 1
    home = F.floor(i / block)
    at = F.array(F.struct(home.alias("b"), F.lit(True).alias("own")), F.struct(F.when(i % block < ahead, home - 1).alias("b"), F.lit(False).alias("own")), F.struct(F.when(i % block >= block - behind, home + 1).alias("b"), F.lit(False).alias("own")))
    spread = placed.select(*df.columns, i.alias("__i"), F.explode(F.filter(at, lambda x: x["b"] >= 0)).alias("__at"))
    return spread.select(*df.columns, "__i", F.col("__at.b").alias("__block"), F.col("__at.own").alias("__own"))


def first_plateau(df: DataFrame, key: str, order: str, value: str, length: int = 5, flat: float = 1.0, block: int = 10_000) -> DataFrame:
    """Rows (key, plateau): the first 0-based place of the differences from which the gradient stays within flat for length places.

    -1 if there is none. Differences are those of neighbours; the gradient is central, one-sided at both ends. A group that holds much of the
    table is worked in blocks; order is a whole number.
    """
    w = Window.partitionBy(key, "__block").orderBy(order)
    d = in_blocks(df.select(key, order, value), key, order, 1, length + 2, block=block)
    d = d.withColumn("__d", F.lead(value).over(w) - F.col(value)).filter("__d is not null")
    before, after = F.lag("__d").over(w), F.lead("__d").over(w)
    g = d.withColumn("__g", F.when(before.isNull(), after - F.col("__d")).when(after.isNull(), F.col("__d") - before).otherwise((after - before) / 2))
    onward = w.rowsBetween(0, length - 1)
    flagged = g.withColumn("__ok", (F.max(F.abs("__g")).over(onward) <= flat) & (F.count("__g").over(onward) == length)).filter("__own")
    return flagged.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("__ok"), F.col("__i"))), F.lit(-1)).cast("bigint").alias("plateau"))


def cut_before_gap(df: DataFrame, key: str, order: str, value: str, cut: DataFrame, gap: int = 2, block: int = 10_000, salts: int = 16) -> DataFrame:
    """Rows (key, cut): a cut place moved back to the last gap larger than gap at or before it (0 if there is none); places of 0 and less stay."""
    w = Window.partitionBy(key, "__block").orderBy(order)
    d = in_blocks(df.select(key, order, value), key, order, 1, 0, block=block).withColumn("__step", F.col(value) - F.lag(value).over(w)).filter("__own")
    gaps = d.filter((F.col("__step") > gap) & (F.col("__i") > 0)).select(key, "__i", F.pmod(F.col("__block"), F.lit(salts)).alias("__salt"))
    salted = cut.select(key, F.col("plateau").alias("__cut"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    last = gaps.join(salted, [key, "__salt"]).filter(F.col("__i") <= F.col("__cut")).groupBy(key).agg(F.max("__i").alias("__m"))
    moved = F.when(F.col("plateau") > 0, F.coalesce("__m", F.lit(0))).otherwise(F.col("plateau"))
    return cut.join(last, key, "left").select(key, moved.cast("bigint").alias("cut"))


def smooth_bounds(df: DataFrame, keys: list[str], order: list[str], upper: str, lower: str) -> DataFrame:
    """Neighbouring boxes get the mean of their touching bounds: adds smooth_upper and smooth_lower."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("smooth_upper", F.coalesce((F.lag(lower).over(w) + F.col(upper)) / 2, F.col(upper))).withColumn("smooth_lower", F.coalesce((F.lead(upper).over(w) + F.col(lower)) / 2, F.col(lower)))
