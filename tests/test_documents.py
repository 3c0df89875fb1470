import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrail.operators import documents as D
from spectrail.operators import pictures as P
from spectrail.operators import segments as S
from spectrail.plans import pipeline

TEXT = """Ethyl benzoate (12a)
1H NMR (400 MHz, CDCl3): d 7.26 (s, 1H), 3.71 (s, 3H).
one line
13C NMR (101 MHz, CDCl3): d 170.1, 60.2.
and some words in between
and more of them
and still more
and again some
IR (neat): 1710 (s), 1600 (m).
last line"""


def rows_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").withColumn("segment", F.lit("clash"))


def whole(spark, *texts):
    """Every text as one segment."""
    return rows_of(spark, *texts).select("id", D.cut(F.split("text", "\n"), F.array(F.lit(0))).alias("segments"))


def test_same_as_lines_as_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    lines = S.document_lines(docs, "doc_id", "text")
    for marks in ((80, 35), (50, 25), (40, 40)):
        slow = S.segments(lines, S.segment_starts(S.line_statistics(lines, "doc_id"), "doc_id", *marks), "doc_id").select("doc_id", "segment", "first_seq", "n_lines")
        fast = D.segment_arrays(docs, "doc_id", "text", *marks).select("doc_id", F.inline("segments")).select("doc_id", "segment", F.col("first").alias("first_seq"), F.size("lines").alias("n_lines"))
        assert sorted(map(tuple, slow.collect())) == sorted(map(tuple, fast.collect()))


def test_no_shuffle(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    for df in (pipeline.extract(docs, "doc_id", "text"), pipeline.sequences(docs, "doc_id", "text")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("FileScan") == 1


@pytest.mark.parametrize("n", [1, 2, 3, 10, 11])
def test_percentile(spark, n):
    r = random.Random(n)
    values = [float(r.randint(0, 5)) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for mark in (0, 25, 35, 50, 80, 100):
        want = df.agg(F.percentile("v", F.lit(mark / 100))).first()[0]
        assert spark.range(1).select(D.percentile(F.array(*map(F.lit, values)), mark)).first()[0] == want
    assert spark.range(1).select(D.percentile(F.array().cast("array<double>"), 50)).first()[0] is None


def test_sequences_and_split(spark):
    df = D.with_tests(whole(spark, TEXT, "nothing here", ""))
    seqs = {r.id: [[t.test_type for t in s] for s in r.s] for r in df.select("id", D.runs(F.col("tests")).alias("s")).collect()}
    assert seqs == {0: [["1H NMR", "13C NMR"], ["IR"]], 1: [], 2: []}
    parts = df.select("id", F.inline(D.split_at_sequences(F.col("segments"), F.col("tests")))).collect()
    assert [(p.id, p.part, p.first, p.n_lines, p.types) for p in parts] == [(0, 1, 0, 3, ["1H NMR", "13C NMR"]), (0, 2, 3, 5, ["IR"])]


def test_relocated(spark):
    text = "\n".join(f"line {i} with methyl and ethyl phenyl groups" if i % 4 == 0 else f"plain words without any of those, number {i} here" for i in range(24))
    docs = D.line_arrays(rows_of(spark, text, "short"), "id", "text")
    segs = docs.select("id", "lines", "stats", D.cut(F.col("lines"), F.array(F.lit(0))).alias("segs"))
    got = {r.id: (r.s[0].first, len(r.s[0].lines)) for r in segs.select("id", D.relocated(F.col("segs"), F.col("stats"), F.col("lines"), per_page=5).alias("s")).collect()}
    assert got == {0: (20, 4), 1: (0, 1)}
    one = segs.select("id", D.relocated(F.col("segs"), F.col("stats"), F.col("lines"), per_page=50).alias("s")).collect()
    assert all(r.s[0].first == 0 for r in one)


def test_merging():
    h, c, i = "H", "C", "I"
    assert D.merging([]) == [] and D.merging([[], []]) == [[0], [1]]
    assert D.merging([[h, c], [h], [c, i], [h, c], [h, c]]) == [[0], [1, 2], [3], [4]]
    assert D.merging([[h, c], [h], [c], [h, c], [h, c]]) == [[0], [4]]  # a chain that holds two is left out
    assert D.merging([[h, c], [], [h, c], []]) == [[0], [1, 2], [3]]
    assert D.merging([[h, c], [h, c], [], []]) == [[0], [1], [2, 3]]
    assert D.merging([[h, c], [h], [i], [h, c]]) == [[0], [1], [2, 3]]
    assert D.merging([[h, c]] * 3 + [[h]] * 9 + [[h, c, i, i, i]] * 3) == [[k] for k in range(15)]  # the mean is far from the common sequence
    r = random.Random(3)
    for _ in range(300):
        types = [[r.choice("HC") for _ in range(r.randint(0, 3))] for _ in range(r.randint(0, 8))]
        groups = D.merging(types)
        flat = list(itertools.chain(*groups))
        assert len(flat) == len(set(flat)) and groups == sorted(groups) and all(g == list(range(g[0], g[-1] + 1)) for g in groups)
        assert {k for k, t in enumerate(types) if not t} <= set(flat)


def test_adjusted_and_outcome(spark):
    got = D.adjusted(whole(spark, TEXT, "nothing here")).select("id", F.size("segments").alias("n"), F.size("tests").alias("t")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 3), (1, 0, 0)]
    out = {r.id: (r.segments, r.tests, r.errors) for r in pipeline.outcome(rows_of(spark, "", None, "no test"), "id", "text").collect()}
    assert out == {0: (0, 0, ["no text"]), 1: (0, 0, ["no text"]), 2: (0, 0, ["no segment with a test"])}


def test_best_option(spark):
    counts = spark.createDataFrame([(1, 0, 2), (1, 1, 5), (1, 2, 5), (2, 3, 1)], "id bigint, option int, n bigint")
    assert sorted(map(tuple, D.best_option(counts, "id").collect())) == [(1, 1, 5), (2, 3, 1)]


def test_suppressed_boxes(spark):
    r = random.Random(5)
    rows = [(r.randint(0, 1), i, r.choice([0.1, 0.3, 0.5, 0.9]), x := r.randint(0, 40), y := r.randint(0, 40), x + r.randint(5, 20), y + r.randint(5, 20)) for i in range(60)]
    df = spark.createDataFrame(rows, "page bigint, id bigint, confidence double, x0 int, y0 int, x1 int, y1 int")

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        both = max(w, 0) * max(h, 0)
        return both / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - both)

    kept = []
    for b in sorted(rows, key=lambda b: (-b[2], b[1])):
        if b[2] >= P.LEAST and all(k[0] != b[0] or iou(k, b) <= P.OVERLAP for k in kept):
            kept.append(b)
    assert sorted(x.id for x in P.suppressed(df, ["page"], "id").collect()) == sorted(k[1] for k in kept)
    assert P.suppressed(df.limit(0), ["page"], "id").count() == 0


def test_whole_boxes_and_letterbox(spark):
    df = spark.createDataFrame([(1, -3.7, 2.2, 700.0, 10.9), (2, 5.0, 5.0, 5.9, 9.0), (3, None, 1.0, 2.0, 3.0)], "id bigint, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in P.whole_boxes(df, 612, 792).collect()] == [(1, 0, 2, 612, 10)]
    box = spark.createDataFrame([(0.0, 0.0, 612.0, 792.0)], "x0 double, y0 double, x1 double, y1 double").select(*P.letterbox(612, 792)).first()
    assert abs(box.x0 + box.x1 - 640) < 1e-9 and box.y0 == 0 and abs(box.y1 - 640) < 1e-9


def test_pixels():
    a = np.zeros((10, 20), np.uint8)
    s = P.square(a, 8)
    assert s.shape == (8, 8) and (s[2:6] == 0).all() and (s[:2] == 255).all() and (s[6:] == 255).all()
    assert (P.square(np.full((3, 3), 7, np.uint8), 9) == 7).all() and (P.square(np.zeros((0, 4), np.uint8), 4) == 255).all()
    mask = np.zeros((10, 20), bool)
    mask[2:4, 5:9] = True
    m = P.masked(a, mask)
    assert m.shape == (2, 4) and (m == 0).all() and P.masked(a, mask & False) is a
    assert P.cropped(a, -2, 1, 5, 3).shape == (2, 5)


def test_page_blocks(spark):
    import textwrap

    long = "word and another word; " * 30
    rows = [("d", 1, 7, "second", 10.0, 50.0, 20.0, 60.0), ("d", 1, 9, long, 0.0, 10.0, 100.0, 40.0), ("d", 1, 8, "first\nline", 0.0, 10.0, 100.0, 40.0), ("d", 2, 1, "", 0.0, 0.0, 1.0, 1.0), ("d", 2, 2, None, 0.0, 0.0, 1.0, 1.0), ("d", 2, 3, "no box", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc string, page int, block bigint, text string, x0 double, y0 double, x1 double, y1 double")
    got = S.page_blocks(df, ["doc", "page"], "block", "text", (200.0, 100.0)).orderBy("page", "line").collect()
    wanted = ["first line", *textwrap.wrap(long.replace(";", " ").rstrip(), 250), "second"]
    assert [(r.line, r.text) for r in got if r.page == 1] == list(enumerate(wanted)) and [r.text for r in got if r.page == 2] == [""]
    assert tuple(got[0].bbox) == (10.0, 0.0, 40.0, 50.0)


def test_new_queries_run_on_empty_tables(spark, data, tmp_path):
    import glob
    import os

    import __spark_entry__ as entry
    from spectrail.plans import survey_more

    for f in glob.glob(f"{data}/*.parquet"):
        spark.read.parquet(f).limit(0).write.parquet(f"{tmp_path}/{os.path.basename(f)}")
    for name in survey_more.queries():
        assert entry.queries()[name](spark, str(tmp_path)).count() <= 1, name
