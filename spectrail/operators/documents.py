"""Segments, tests and sequences of whole documents, a document a row, without a shuffle.

The operators of ``segments`` and ``sequences`` take lines as rows, which other sources may have; a document's own lines fit in one row with
its text, and there everything about it follows from arrays: statistics, percentiles, segments, windows, islands. The cutting rules of tests,
which depend on each other, run in one Arrow pass over the windows. A corpus is read once.

Defined results: null texts give no row; documents without a start have no segments, segments without a test no tests; a test's text counts
once a segment, where it stands first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spectrail.functions import text as X
from spectrail.functions.bind import bind
from spectrail.functions.tokens import TEST_FAMILIES
from spectrail.operators.extraction import test_of
from spectrail.operators.segments import LINES_PER_PAGE

TEST = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("hit", T.IntegerType()), T.StructField("test_type", T.StringType()), T.StructField("test_text", T.StringType())])


def percentile(values: Column, mark: float) -> Column:
    """The percentile of an array, between its neighbours in proportion; null of an empty one."""

    def of(ordered: Column) -> Column:
        at = (F.size(ordered) - 1) * F.lit(mark / 100)
        lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
        a, b = F.get(ordered, lo), F.get(ordered, hi)
        return F.when(F.size(ordered) > 0, F.when((lo == hi) | (a == b), a.cast("double")).otherwise((hi - at) * a + (at - lo) * b))

    return bind(F.sort_array(values), of)


def line_arrays(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, lines, stats): a document's lines, and (seq, likelihood, spaces) of the eligible ones."""
    lines = docs.select(key, F.split(column, "\n").alias("lines")).filter("lines is not null")
    edited = F.transform("lines", lambda x, i: F.struct(i.alias("seq"), x.alias("text"), X.without_noise(x).alias("t")))
    long = lambda e: (F.length(F.replace(e["t"], F.lit(" "), F.lit(""))) > 10) & ~e["text"].startswith("Rf") & ~e["text"].startswith("mp")
    stats = F.transform(F.filter(edited, long), lambda e: F.struct(e["seq"].alias("seq"), X.name_likelihood(e["t"]).alias("likelihood"), X.count_of(e["t"], " ").alias("spaces")))
    return lines.select(key, "lines", stats.alias("stats"))


def starts(stats: Column, tokens_mark: float = 80, spaces_mark: float = 35) -> Column:
    """The lines above the document's likelihood percentile and under its spaces percentile; both strict."""
    high = percentile(F.transform(stats, lambda s: s["likelihood"]), tokens_mark)
    low = percentile(F.transform(stats, lambda s: s["spaces"]), spaces_mark)
    marks = F.array(F.struct(high.alias("t"), low.alias("s")))  # once a document, not once a line
    return F.flatten(F.transform(marks, lambda m: F.transform(F.filter(stats, lambda x: (x["likelihood"] > m["t"]) & (x["spaces"] < m["s"])), lambda x: x["seq"])))


def cut(lines: Column, at: Column) -> Column:
    """Segments (segment, first, lines): each start opens one up to the next."""
    return F.transform(at, lambda s, k: F.struct((k + 1).alias("segment"), s.alias("first"), F.slice(lines, s + 1, F.coalesce(F.get(at, k + 1), F.size(lines)) - s).alias("lines")))


def segment_arrays(docs: DataFrame, key: str, column: str, tokens_mark: float = 80, spaces_mark: float = 35) -> DataFrame:
    """Rows (key, segments)."""
    found = line_arrays(docs, key, column).select(key, "lines", starts(F.col("stats"), tokens_mark, spaces_mark).alias("at"))
    return found.select(key, cut(F.col("lines"), F.col("at")).alias("segments"))


def unpacked(df: DataFrame, keys: list, column: Column | str, needed: str) -> DataFrame:
    """Rows (keys, members) of an array of structs; needed is a member that is never null.

    The outer form, as the plain one makes the optimizer filter documents by the array, and so compute all that it is made of once more.
    """
    return df.select(*keys, F.inline_outer(column)).filter(F.col(needed).isNotNull())


def name_of(lines: Column, depth: int = 3) -> Column:
    """What stands before the tag in the first 1..depth lines joined, else the first line."""
    tries = [X.compound_name(F.array_join(F.slice(lines, 1, n), "")) for n in range(1, depth + 1)]
    return X.safe_name(F.coalesce(*tries, F.get(lines, F.lit(0))))


def windows(segments: Column, families: tuple[str, ...] = TEST_FAMILIES, before: int = 1, after: int = 20) -> Column:
    """(segment, hit, word, text): for each line of a segment that holds a family's word the lines from before to after it, joined."""

    def of(g: Column) -> Column:
        lines = g["lines"]

        def window(w: str) -> Column:
            hits = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.contains(F.get(lines, i), F.lit(w)))
            first = lambda i: F.greatest(i - before, F.lit(0))
            return F.transform(hits, lambda i: F.struct(g["segment"].alias("segment"), (g["first"] + i).alias("hit"), F.lit(w).alias("word"), F.array_join(F.slice(lines, first(i) + 1, i + after - first(i)), "").alias("text")))

        return F.concat(*(window(w) for w in families))

    return F.flatten(F.transform(segments, of))


def look_around(lines: Column, families: tuple[str, ...] = TEST_FAMILIES, before: int = 1, after: int = 20) -> Column:
    """(hit, first, texts): for each line that holds a word the lines from before to after it, clipped to the document."""
    held = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.exists(F.array(*map(F.lit, families)), lambda w: F.contains(F.get(lines, i), w)))
    first = lambda i: F.greatest(i - before, F.lit(0))
    return F.transform(held, lambda i: F.struct(i.alias("hit"), first(i).alias("first"), F.slice(lines, first(i) + 1, i + after - first(i)).alias("texts")))


def end_line(window: Column, needle: str) -> Column:
    """The line of a window of look_around through which its joined text holds the needle; null if it doesn't."""
    texts = window["texts"]
    through = F.instr(F.array_join(texts, ""), needle) + len(needle) - 1
    ends = F.transform(F.sequence(F.lit(1), F.size(texts)), lambda k: F.aggregate(F.slice(texts, F.lit(1), k), F.lit(0), lambda a, x: a + F.length(x)))
    return F.when(F.contains(F.array_join(texts, ""), F.lit(needle)), bind(through, lambda t: window["first"] + F.size(F.filter(ends, lambda e: e < t))))


def appended(df: DataFrame, column: str, of: Callable[[object], object], name: str, kind: T.DataType) -> DataFrame:
    """Adds name, of(value) of a column; other columns pass through as they are. The column itself is dropped."""
    rest = [c for c in df.columns if c != column]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(name, kind)])
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([of(v) for v in batch.column(len(rest)).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), made], [*rest, name])

    return df.select(*rest, column).mapInArrow(run, schema)


def _tests(found: list[dict] | None) -> list[dict]:
    first: dict[tuple, int] = {}
    for w in found or ():
        if (t := test_of(w["text"], w["word"])) is not None and t[0].strip() and t[1].strip():
            k = (w["segment"], *t)
            first[k] = min(w["hit"], first.get(k, w["hit"]))
    rows = sorted((hit, text, kind, segment) for (segment, kind, text), hit in first.items())
    return [{"segment": s, "hit": h, "test_type": k, "test_text": t} for h, t, k, s in rows]


def with_tests(docs: DataFrame, families: tuple[str, ...] = TEST_FAMILIES) -> DataFrame:
    """Adds tests, (segment, hit, test_type, test_text) in order of lines, to rows with segments."""
    return appended(docs.withColumn("__w", windows(F.col("segments"), families)), "__w", _tests, "tests", T.ArrayType(TEST))


def runs(tests: Column, gap: int = 4) -> Column:
    """The tests cut into sequences: a new one where a test stands more than gap lines behind the one before."""
    n = F.size(tests)
    hit = lambda i: F.get(tests, i)["hit"]
    opens = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (hit(i) - hit(i - 1) > gap))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(F.array(opens), lambda o: F.transform(o, lambda s, k: F.slice(tests, s + 1, F.coalesce(F.get(o, k + 1), n) - s))))


def of_segment(tests: Column, segment: Column) -> Column:
    return F.filter(tests, lambda t: t["segment"] == segment)


def relocated(segments: Column, stats: Column, lines: Column, tokens_mark: float = 50, spaces_mark: float = 25, max_pages: int = 1, per_page: int = LINES_PER_PAGE) -> Column:
    """Segments of more than max_pages page breaks are located again within their lines by milder marks, and the last part stays; those in
    which nothing is located stay as they are."""

    def again(g: Column) -> Column:
        last = g["first"] + F.size(g["lines"]) - 1
        wide = F.floor(last / per_page) - F.floor(g["first"] / per_page) > max_pages
        own = F.filter(stats, lambda s: s["seq"].between(g["first"], last))
        at = F.get(F.array(starts(own, tokens_mark, spaces_mark)), F.lit(0))
        new = F.coalesce(F.when(wide, F.array_max(at)), g["first"])
        return F.struct(g["segment"].alias("segment"), new.alias("first"), F.slice(lines, new + 1, last - new + 1).alias("lines"))

    return F.transform(segments, again)


def split_at_sequences(segments: Column, tests: Column, gap: int = 4) -> Column:
    """Parts (segment, part, first, n_lines, types): a segment's lines up to, without, the end line of each of its sequences, each part with
    the sequence that ends it; what follows the last end, and empty parts, are left out. Parts count from 1."""

    def of(g: Column) -> Column:
        ends = F.transform(runs(of_segment(tests, g["segment"]), gap), lambda r: F.struct((F.element_at(r, -1)["hit"] - g["first"]).alias("end"), F.transform(r, lambda t: t["test_type"]).alias("types")))

        def part(e: Column, k: Column, all_: Column) -> Column:
            a = F.when(k > 0, F.get(all_, k - 1)["end"]).otherwise(F.lit(0))
            return F.struct(g["segment"].alias("segment"), (k + 1).alias("part"), (g["first"] + a).alias("first"), (e["end"] - a).alias("n_lines"), e["types"].alias("types"))

        return F.filter(F.flatten(F.transform(F.array(ends), lambda all_: F.transform(all_, lambda e, k: part(e, k, all_)))), lambda p: p["n_lines"] > 0)

    return F.flatten(F.transform(segments, of))


def occurrences(source: list, target: list) -> int:
    return sum(source[i : i + len(target)] == target for i in range(len(source) - len(target) + 1))


def merging(types: list[list[str]]) -> list[list[int]]:
    """Which segments, by 0-based number, become one, in order, given the test types of each.

    The document's common sequence is the most frequent list of types (of equals the first). Where the mean number of tests, rounded down or
    up, is its length, neighbours of which the first is incomplete, and which give the common sequence together, are chained; a chain that
    holds it once becomes one segment, another is left out. A run of segments without tests goes with the segment behind it, or with itself
    at the end of the document. Elsewhere all stay as they are.
    """
    full = [tuple(t) for t in types if t]
    n = len(types)
    alone = [[i] for i in range(n)]
    if not full:
        return alone
    common = list(Counter(full).most_common(1)[0][0])
    mean = sum(map(len, full)) / len(full)
    if len(common) not in (floor(mean), ceil(mean)):
        return alone
    chains: list[list[int]] = []
    for i in range(n - 1):
        if 0 < len(types[i]) < len(common) and occurrences(types[i] + types[i + 1], common):
            if chains and i in chains[-1]:
                chains[-1].append(i + 1)
            else:
                chains.append([i, i + 1])
    out, used = [], {i for c in chains for i in c}
    for c in chains:
        if occurrences([t for i in c for t in types[i]], common) == 1:
            out.append(c)
    i = 0
    while i < n:
        if not types[i] and i not in used:
            j = i
            while j + 1 < n and not types[j + 1]:
                j += 1
            group = list(range(i, min(j + 2, n)))
            group = [k for k in group if k not in used]
            used.update(group)
            out.append(group)
            i = j
        i += 1
    out += [[i] for i in range(n) if i not in used]
    return sorted(out)


def _merging(lists: list[list[str]] | None) -> list[list[int]]:
    return merging(lists or [])


def adjusted(docs: DataFrame, families: tuple[str, ...] = TEST_FAMILIES) -> DataFrame:
    """Rows with segments as rows with segments and tests: merged as by ``merging``, their tests searched again, numbered in order of lines, and
    without those that hold no test."""
    types = F.transform("segments", lambda g: F.transform(of_segment(F.col("tests"), g["segment"]), lambda t: t["test_type"]))
    grouped = appended(with_tests(docs, families).withColumn("__t", types).drop("tests"), "__t", _merging, "__g", T.ArrayType(T.ArrayType(T.IntegerType())))
    joined = F.transform("__g", lambda g, k: F.struct((k + 1).alias("segment"), F.get(F.col("segments"), F.get(g, F.lit(0)))["first"].alias("first"), F.flatten(F.transform(g, lambda i: F.get(F.col("segments"), i)["lines"])).alias("lines")))
    rebuilt = with_tests(grouped.withColumn("segments", joined).drop("__g"), families)
    kept = F.filter("segments", lambda g: F.exists("tests", lambda t: t["segment"] == g["segment"]))
    return rebuilt.withColumn("segments", kept)


def best_option(counts: DataFrame, key: str, option: str = "option", n: str = "n") -> DataFrame:
    """Rows (key, option, n): the option with the highest count, of equals the first; the first one where nothing counts."""
    return counts.groupBy(key).agg(F.max_by(F.struct(option, n), F.struct(n, -F.col(option))).alias("__b")).select(key, f"__b.{option}", f"__b.{n}")
