"""Queries of sequences, pictures, matching, scoring, statistics and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectrail.functions import geometry as G
from spectrail.functions import peaks as P
from spectrail.functions import text as X
from spectrail.functions.similarity import compared, ratio
from spectrail.functions.tokens import COLOURS, TEST_TYPES
from spectrail.operators import extraction as E
from spectrail.operators import matching as M
from spectrail.operators import scoring as C
from spectrail.operators import sequences as Q
from spectrail.operators import tables as B
from spectrail.session import table

# --- sequences: events stand for tests, hours since the user's first event for line numbers ----------------------------------------------


def _tests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    hour = F.expr("(unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(CAST(first_ts AS TIMESTAMP))) div 3600000000")
    return e.withColumn("first_ts", F.min("ts").over(Window.partitionBy("user_id"))).select("event_id", "user_id", "event_type", hour.alias("pos"))


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return Q.test_sequences(_tests(spark, d), "user_id", "pos", "pos", "event_type", "event_id")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    seqs = _sequences(spark, d)
    return Q.segment_sizes(seqs, Q.common_sequence(seqs, ["user_id", "sequence"]))


def test_sequences(spark, d):
    return _sequences(spark, d).withColumn("types", F.array_join("types", ","))


def common_sequence(spark, d):
    return Q.common_sequence(_sequences(spark, d), ["user_id", "sequence"]).withColumn("types", F.array_join("types", ","))


def sequence_statistics(spark, d):
    return _sequences(spark, d).agg(F.avg(F.size("types")).alias("mean_tests"), F.countDistinct("types").alias("kinds"))


def segment_sizes(spark, d):
    return Q.classes(_sized(spark, d)).select("user_id", "sequence", "size", "max_molecules", "min_molecules", "class")


def pair_occurrences(spark, d):
    t = _tests(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("types"))
    return t.select("user_id", Q.occurrences(F.col("types"), F.array(F.lit("view"), F.lit("click"))).cast("bigint").alias("n"))


def neighbours_to_merge(spark, d):
    seqs = _sequences(spark, d)
    two = seqs.select(F.array(F.lit("view"), F.lit("click")).alias("types")).limit(1)
    return Q.neighbours_to_merge(seqs, "user_id", "sequence", two)


def merged_chains(spark, d):
    return Q.merge_pairs(neighbours_to_merge(spark, d), "user_id", "sequence", "next").select("user_id", "chain", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def page_runs(spark, d):
    return Q.runs_of_numbers(table(spark, d, "spectra", "f_name", "page_number").filter("page_number is not null"), "f_name", "page_number")


def _pages(spark, d):
    return table(spark, d, "spectra", "f_name", "spectrum_id", "page_number").filter("page_number is not null")


def first_plateau(spark, d):
    return Q.first_plateau(_pages(spark, d).withColumn("page_number", F.expr("page_number div 8")), "f_name", "spectrum_id", "page_number")


def cut_before_gap(spark, d):
    """The place of the first plateau moved back to a gap of pages."""
    return Q.cut_before_gap(_pages(spark, d), "f_name", "spectrum_id", "page_number", first_plateau(spark, d))


def smoothed_bounds(spark, d):
    b = table(spark, d, "nmr_data", "nmr_id", "f_name", "provenance").select("nmr_id", "f_name", "provenance.page_number", "provenance.bbox.y0", "provenance.bbox.y1").filter("y0 is not null and page_number is not null")
    return Q.smooth_bounds(b, ["f_name", "page_number"], ["y0", "nmr_id"], "y0", "y1").select("nmr_id", "smooth_upper", "smooth_lower")


# --- pictures: line items stand for detected pictures, orders for segments ----------------------------------------------------------------


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    w = Window.partitionBy("doc", "page").orderBy("l_partkey", "l_suppkey", "l_orderkey")
    pics = items.select(F.expr("l_orderkey div 10").alias("doc"), F.col("l_linenumber").cast("bigint").alias("page"), "l_partkey", "l_suppkey", "l_orderkey")
    return pics.withColumn("det", (F.row_number().over(w) - 1).cast("bigint")).select("doc", "page", "det", (F.col("l_partkey") % 80).cast("double").alias("x"), (F.col("l_suppkey") % 30).cast("double").alias("y"), F.lit(10.0).alias("w"), F.lit(8.0).alias("h"))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return M.picture_clusters(_pictures(spark, d), "doc", ["det"])


def _segments(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    return o.select(F.expr("o_orderkey div 10").alias("doc"), F.col("o_orderkey").alias("segment"), (F.col("o_orderkey") % 7 + 1).alias("start_page"), (F.col("o_custkey") % 100).cast("double").alias("upper_y"), (F.col("o_orderkey") % 3).alias("min_cap"), (F.col("o_orderkey") % 3 + 1).alias("max_cap"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    lead = M.leading_pictures(_clusters(spark, d), "doc", ["det"], ["page", "x", "y", "w", "h"]).withColumnRenamed("cluster", "pic")
    return M.proximity(lead, _segments(spark, d), "doc", carry=("min_cap", "max_cap"))


def pic_clusters(spark, d):
    return _clusters(spark, d).groupBy("doc", "cluster").agg(F.min("page").alias("page"), F.count(F.lit(1)).alias("n"))


def leading_pics(spark, d):
    return M.leading_pictures(_clusters(spark, d), "doc", ["det"], ["page", "x", "y"])


def proximity_pairs(spark, d):
    return M.ranked(_pairs(spark, d).drop("min_cap", "max_cap"), "doc")


def greedy_match(spark, d):
    return M.greedy_match(_pairs(spark, d), "doc", use_max=True)


def filled_matched_rate(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    l = table(spark, d, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_tests"))  # noqa: E741
    segs = o.join(l, o["o_orderkey"] == l["l_orderkey"], "left").select((F.col("o_custkey") % 24).alias("doc"), F.coalesce("n_tests", F.lit(0)).alias("n_tests"), (F.col("o_orderkey") % 3).alias("n_pics"))
    return M.filled_matched(segs, "doc", "n_tests", "n_pics")


# --- scoring: gt_tests against the wide records ------------------------------------------------------------------------------------------

_WIDE = {"1H NMR": "h1_nmr", "13C NMR": "c13_nmr", "IR": "ir", "MS": "ms"}


def _wide_tests(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "wide_records", "wide_id", "molecule_name", "file_name", *_WIDE.values())
    cells = F.array(*(F.struct(F.lit(k).alias("test_type"), F.col(c).alias("test_text")) for k, c in _WIDE.items()))
    return w.select("wide_id", "molecule_name", F.regexp_replace("file_name", r"\.pdf$", "").alias("f_name"), F.inline(cells)).filter("test_text is not null")


def _pairs_of_tests(spark: SparkSession, d: str) -> DataFrame:
    gt = table(spark, d, "gt_tests", "gt_id", "f_name", "molecule_name", "test_type", "test_text").filter(F.col("test_type").isin(*TEST_TYPES) & F.col("test_text").isNotNull())
    return C.paired_tests(gt, _wide_tests(spark, d), ["f_name", "molecule_name"], "wide_id")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return C.test_scores(_pairs_of_tests(spark, d)).select("gt_id", "f_name", "molecule_name", "test_type", "tp", "fp", "fn", "precision", "recall", "f1")


def peak_confusion(spark, d):
    return _scored(spark, d)


def score_summary(spark, d):
    return C.summary(_scored(spark, d), "f1")


def metric_summary(spark, d):
    return C.metric_summary(_scored(spark, d), ["precision", "recall", "f1"], ["tp", "fp", "fn"])


def metric_filter(spark, d):
    return C.metric_filter(_scored(spark, d), {"precision": 0.8, "recall": 0.5}).select("gt_id", "f1")


def molecule_scores(spark, d):
    """The mean of the factors that count, per molecule."""
    s = _scored(spark, d).groupBy("f_name", "molecule_name").agg(*(F.max(F.when((F.col("test_type") == k) & (F.col("tp") > 0), F.col("f1"))).alias(B.column_name(k)) for k in TEST_TYPES))
    return s.select("f_name", "molecule_name", M.mean_of_factors([F.col(B.column_name(k)) for k in TEST_TYPES]).alias("score"))


#: Parts that the ground truth of a file is cut into, so that a hot file's pairs are spread over tasks.
PAIR_PARTS = 16


def pair_scores(spark, d):
    """Scores of all ground-truth molecules of a file against all its extracted ones: the mean of the factors that count (structure, name,
    and text similarity and F1 of each ground-truth test with a true peak). Both sides are reduced to one row a molecule, tests to distinct ones."""
    keys, part = ["f_name", "molecule_name", "extracted_name"], F.pmod(F.hash("molecule_name"), F.lit(PAIR_PARTS))
    parts = F.explode(F.sequence(F.lit(0), F.lit(PAIR_PARTS - 1))).alias("part")
    g = table(spark, d, "gt_tests", "f_name", "molecule_name", "opsin_smiles", "test_type", "test_text").filter("molecule_name is not null and f_name is not null")
    gt = g.groupBy("f_name", "molecule_name").agg(F.min("opsin_smiles").alias("gt_smiles")).withColumn("part", part)
    w = table(spark, d, "wide_records", "molecule_name", "file_name", "molecule_smiles_by_images").filter("molecule_name is not null")
    ex = w.groupBy(F.regexp_replace("file_name", r"\.pdf$", "").alias("f_name"), F.col("molecule_name").alias("extracted_name")).agg(F.min("molecule_smiles_by_images").alias("smiles")).select("*", parts)
    both = gt.join(ex, ["f_name", "part"]).select(*keys, C.smiles_score(F.col("gt_smiles"), F.col("smiles")).alias("smiles_score"), compared(F.col("molecule_name"), F.col("extracted_name")).alias("name_score"))

    peaks = lambda c: P.positions(F.col(c), F.col("test_type"))
    true = g.filter(F.col("test_type").isin(*TEST_TYPES) & F.col("test_text").isNotNull()).select("f_name", "molecule_name", "test_type", "test_text").distinct().select("*", peaks("test_text").alias("a"), part.alias("part"))
    first = _wide_tests(spark, d).filter("molecule_name is not null").groupBy("f_name", F.col("molecule_name").alias("extracted_name"), "test_type").agg(F.min_by("test_text", "wide_id").alias("other"))
    tests = true.join(first.select("*", peaks("other").alias("b")).select("*", parts), ["f_name", "test_type", "part"]).select(*keys, "test_text", "other", P.confusion(F.col("a"), F.col("b")).alias("c")).filter("c.tp > 0")
    f1 = P.precision_recall_f1(F.col("c.tp"), F.col("c.fp"), F.col("c.fn"), 2)[2]
    scored = tests.select(*keys, F.array(compared(F.col("test_text"), F.col("other")), f1).alias("s")).groupBy(*keys).agg(F.flatten(F.collect_list("s")).alias("test_scores"))
    mean = M.mean_of(F.concat(F.array("smiles_score", "name_score"), F.coalesce("test_scores", F.array().cast("array<double>"))))
    return both.join(scored, keys, "left").select(*keys, mean.alias("score"))


def best_assignment(spark, d):
    return M.best_assignment(pair_scores(spark, d).withColumnRenamed("f_name", "group"), "group", "molecule_name", "extracted_name")


def string_ratio(spark, d):
    w = table(spark, d, "wide_records", "wide_id", "molecule_smiles_by_images", "molecule_smiles_by_name")
    return w.select("wide_id", C.smiles_score(F.col("molecule_smiles_by_name"), F.col("molecule_smiles_by_images")).alias("confidence")).filter("confidence is not null")


def name_ratio(spark, d):
    g = table(spark, d, "gt_tests", "gt_id", "test_text", "notes").filter("test_text is not null and notes is not null")
    return g.select("gt_id", ratio(F.col("notes"), F.col("test_text")).alias("ratio"))


def entity_prf(spark, d):
    return C.entity_scores(table(spark, d, "wide_records", F.col("molecule_smiles_by_images").alias("smiles")), table(spark, d, "molecules", "smiles"), "smiles")


def calibration(spark, d):
    """Predicted against true structures, file by file."""
    pred = table(spark, d, "wide_records", F.regexp_replace("file_name", r"\.pdf$", "").alias("f_name"), F.col("molecule_smiles_by_images").alias("smiles"))
    return C.entity_scores(pred, table(spark, d, "molecules", "f_name", "smiles"), "smiles", ["f_name"])


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nmr_data", "nmr_id", "f_name", "provenance").select("nmr_id", "f_name", F.col("provenance.page_number").cast("bigint").alias("page"), F.col("provenance.bbox").alias("box")).filter("box is not null and page is not null")


def bbox_iou(spark, d):
    b = _boxes(spark, d)
    n = b.select((F.col("nmr_id") - 1).alias("nmr_id"), F.col("box").alias("next"))
    return b.join(n, "nmr_id").select("nmr_id", G.iou(F.col("box"), F.col("next")).alias("iou"))


def bbox_union(spark, d):
    return C.box_union(_boxes(spark, d).select("f_name", "page", "box.*"), ["f_name", "page"])


def bbox_scaled(spark, d):
    x = _boxes(spark, d).select("nmr_id", G.corners_to_size(F.col("box.x0"), F.col("box.y0"), F.col("box.x1"), F.col("box.y1")).alias("s"))
    return x.select("nmr_id", "s.*", G.pixel_ranges(F.col("s.x"), F.col("s.y"), F.col("s.w"), F.col("s.h"), F.lit(200.0), F.lit(100.0)).alias("p")).select("nmr_id", "x", "y", "w", "h", *(F.col(f"p.{c}").cast("bigint").alias(c) for c in ("top", "bottom", "left", "right")))


def provenance_pages(spark, d):
    return _boxes(spark, d).groupBy("f_name", "page").agg(F.count(F.lit(1)).alias("boxes"), F.min("nmr_id").alias("first_id"), F.array_join(F.transform(F.array_sort(F.collect_list("nmr_id")), lambda x: x.cast("string")), ",").alias("ids"))


# --- statistics and exports ---------------------------------------------------------------------------------------------------------------


def _gt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gt_tests", "gt_id", "f_name", "molecule_name", "test_type", "test_text")


def gt_stats(spark, d):
    return B.counts_by_type(_gt(spark, d), "test_type", "f_name")


def gt_files(spark, d):
    return B.counts_by_file(_gt(spark, d), "f_name", "test_type", "molecule_name")


def gt_means(spark, d):
    return B.mean_counts(gt_files(spark, d), ["molecules", *(B.column_name(k) for k in TEST_TYPES)])


def gt_groups(spark, d):
    return B.grouped_tests(_gt(spark, d), "f_name", "molecule_name", "gt_id")


def wide_export(spark, d):
    w = B.wide(table(spark, d, "spectra", "spectrum_id", "test_type", "molecule_id", "text_representation"), ["molecule_id"], "test_type", "text_representation", "spectrum_id")
    return w.select("molecule_id", *(F.col(k).alias(_WIDE[k]) for k in TEST_TYPES))


def type_colours(spark, d):
    return B.type_colours(table(spark, d, "spectra", "test_type"), "test_type")


def label_config(spark, d):
    return B.label_config(type_colours(spark, d), "test_type")


def annotation_rows(spark, d):
    t = table(spark, d, "nmr_data", "nmr_id", "nucleus", "raw_text", "provenance").filter("provenance.bbox is not null and provenance.page_number is not null and nucleus is not null")
    b = t.select("nmr_id", "nucleus", "raw_text", F.col("provenance.page_number").alias("page"), (F.col("provenance.page_number") - 1).alias("first"), F.col("provenance.bbox.x0").alias("x"), F.col("provenance.bbox.y0").alias("y"), (F.col("provenance.bbox.x1") - F.col("provenance.bbox.x0")).alias("w"), (F.col("provenance.bbox.y1") - F.col("provenance.bbox.y0")).alias("h"))
    return B.annotation_rows(b, ["nmr_id"], "nucleus", "raw_text", "first")


def annotation_tasks(spark, d):
    return B.tasks(annotation_rows(spark, d), ["nmr_id"])


def annotation_round_trip(spark, d):
    """Tasks written and read again: the label and text of each."""
    value = lambda c: F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"), *c)
    rows = annotation_rows(spark, d)
    entry = F.struct("part", "id", F.when(F.col("part") == 0, F.to_json(value([F.array("value").alias("rectanglelabels")]))).otherwise(F.to_json(value([F.array("value").alias("text")]))).alias("v"))
    task = rows.groupBy("nmr_id").agg(F.array_sort(F.collect_list(entry)).alias("e")).select("nmr_id", F.concat(F.lit("["), F.array_join(F.transform("e", lambda e: F.concat(F.lit('{"id":"'), e["id"], F.lit('","value":'), e["v"], F.lit("}"))), ","), F.lit("]")).alias("task"))
    return B.read_annotations(task, ["nmr_id"], "task").select("nmr_id", "label", "text", F.size("boxes").cast("bigint").alias("boxes"))


def updated_tests(spark, d):
    s = table(spark, d, "spectra", "spectrum_id", "test_type", "molecule_id", "text_representation")
    changes = s.filter(F.col("spectrum_id") % 7 == 0).select("molecule_id", "test_type", F.concat(F.lit("checked: "), "text_representation").alias("text_representation"))
    return B.update_by_type(s, changes, ["molecule_id"], "test_type", "text_representation").select("spectrum_id", "text_representation")


def canonical_spectra(spark, d):
    c = B.canonical_spectra(table(spark, d, "spectra", "test_type", "molecule_id", "text_representation", "page_number"))
    return c.select("id", "type", "molecule_id", "text_representation", F.col("provenance.page_number").cast("bigint").alias("page_number"), "provenance.source", F.col("provenance.method.algorithm").alias("algorithm"), F.col("provenance.method.confidence").alias("confidence"))


def canonical_records(spark, d):
    m = table(spark, d, "molecules", F.col("molecule_id").alias("id"), "f_name", "smiles", "inchi", "label")
    s = table(spark, d, "spectra", "f_name", "test_type", "molecule_id", "text_representation", "page_number")
    return B.records(m, B.canonical_spectra(s.drop("f_name")).join(s.select("molecule_id", "f_name").distinct(), "molecule_id"), "f_name")


def graph_nodes(spark, d):
    return B.graph_nodes(table(spark, d, "molecules", "molecule_id"), table(spark, d, "spectra", "test_type", "molecule_id")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def resolved_names(spark, d):
    """Names looked up once each, in two tables of known structures (the first writer of each wins), then joined back."""
    w = table(spark, d, "wide_records", "wide_id", "molecule_name", "molecule_smiles_by_name").filter("molecule_name is not null and molecule_smiles_by_name is not null")
    g = table(spark, d, "gt_tests", "gt_id", "molecule_name", "opsin_smiles").filter("molecule_name is not null and opsin_smiles is not null")
    first = w.groupBy("molecule_name").agg(F.min_by("molecule_smiles_by_name", "wide_id").alias("smiles"))
    second = g.groupBy("molecule_name").agg(F.min_by("opsin_smiles", "gt_id").alias("smiles"))
    m = table(spark, d, "molecules", "molecule_id", "molecule_name", "smiles")
    known = E.resolve_names(m, "molecule_name", [first, second]).withColumnRenamed("smiles", "known")
    return m.join(known, "molecule_name", "left").select("molecule_id", F.coalesce(F.nullif("smiles", F.lit("")), "known", F.lit("")).alias("smiles"))


def set_operations(spark, d):
    a, b = table(spark, d, "gt_tests", "f_name").filter("f_name is not null"), table(spark, d, "molecules", "f_name").filter("f_name is not null")
    parts = {"union_all": a.unionByName(b), "distinct": a.distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "anti": a.join(b, "f_name", "left_anti"), "semi": a.join(b, "f_name", "left_semi")}
    out = None
    for k, p in parts.items():
        one = p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def sorted_tests(spark, d):
    """All tests in order of molecule names, then ids."""
    return _gt(spark, d).filter("molecule_name is not null").orderBy("molecule_name", "gt_id").select("gt_id", "molecule_name")


def serial_groups(spark, d):
    return B.serial_groups(table(spark, d, "molecules", F.concat("molecule_id", F.lit("_full")).alias("name")), "name")


def number_shapes(spark, d):
    return table(spark, d, "nmr_peaks", "coupling_constants").groupBy(X.decimals(F.trim("coupling_constants")).cast("bigint").alias("decimals")).agg(F.count(F.lit(1)).alias("n"))


_NAMES = [test_sequences, common_sequence, sequence_statistics, segment_sizes, pair_occurrences, neighbours_to_merge, merged_chains, page_runs, first_plateau, cut_before_gap, smoothed_bounds, pic_clusters, leading_pics, proximity_pairs, greedy_match, filled_matched_rate, peak_confusion, score_summary, metric_summary, metric_filter, molecule_scores, pair_scores, best_assignment, string_ratio, name_ratio, entity_prf, calibration, bbox_iou, bbox_union, bbox_scaled, provenance_pages, gt_stats, gt_files, gt_means, gt_groups, wide_export, type_colours, label_config, annotation_rows, annotation_tasks, annotation_round_trip, updated_tests, canonical_spectra, canonical_records, graph_nodes, resolved_names, set_operations, sorted_tests, serial_groups, number_shapes]


def queries() -> dict:
    return {f.__name__: f for f in _NAMES}


# --- SQL ----------------------------------------------------------------------------------------------------------------------------

TESTS = "tests AS (SELECT event_id, user_id, event_type, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) // 3600000000 AS pos FROM events)"
SEQS = f"""{TESTS}, g AS (SELECT *, CASE WHEN lag(pos) OVER w IS NULL OR abs(pos - lag(pos) OVER w) > 4 THEN 1 ELSE 0 END AS o FROM tests WINDOW w AS (PARTITION BY user_id ORDER BY pos, event_id)),
n AS (SELECT *, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY pos, event_id) AS BIGINT) AS sequence FROM g),
seqs AS (SELECT user_id, sequence, min(pos) AS first_pos, max(pos) AS last_pos, list(event_type ORDER BY pos, event_id) AS types FROM n GROUP BY user_id, sequence)"""
COMMON = f"{SEQS}, common AS (SELECT types, count(*) AS n FROM seqs GROUP BY types ORDER BY n DESC, min((user_id, sequence)) LIMIT 1)"


def _occ(source: str, target: str, m: str) -> str:
    return f"CASE WHEN len({source}) >= {m} THEN len(list_filter(range(1, len({source}) - {m} + 2), lambda i: {source}[i:i + {m} - 1] = {target})) ELSE 0 END"


MERGE = f"""{SEQS}, p AS (SELECT *, lead(sequence) OVER w AS next, lead(types) OVER w AS t2 FROM seqs WINDOW w AS (PARTITION BY user_id ORDER BY sequence)),
q AS (SELECT user_id, sequence, next, list_concat(types, t2) AS bt, len(types) AS size FROM p WHERE next IS NOT NULL),
pairs AS (SELECT user_id, sequence, next FROM q WHERE size < 2 AND {_occ('bt', "['view', 'click']", '2')} > 0)"""
PICS = """pics AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY pk, sk, ok) - 1 AS det FROM (SELECT l_orderkey // 10 AS doc, CAST(l_linenumber AS BIGINT) AS page, l_partkey AS pk, l_suppkey AS sk, l_orderkey AS ok, CAST(l_partkey % 80 AS DOUBLE) AS x, CAST(l_suppkey % 30 AS DOUBLE) AS y FROM lineitem)),
cg AS (SELECT *, CASE WHEN lag(page) OVER w IS NULL OR page <> lag(page) OVER w OR abs(y - lag(y) OVER w) > 10 THEN 1 ELSE 0 END AS o FROM pics WINDOW w AS (PARTITION BY doc ORDER BY page, det)),
cl AS (SELECT *, CAST(sum(o) OVER (PARTITION BY doc ORDER BY page, det) AS BIGINT) AS cluster FROM cg),
lead_pics AS (SELECT doc, cluster, page, x, y FROM (SELECT *, row_number() OVER (PARTITION BY doc, cluster ORDER BY x DESC, det) AS r FROM cl WHERE x > 0) WHERE r = 1)"""

from spectrail.plans.survey_text import C_PEAKS, H_PEAKS, IR, MS  # noqa: E402


def _renamed(cte: str, n: int, source: str) -> str:
    """A parser's SQL over another source table, its names made unique."""
    out = cte.replace("FROM gt_tests", f"FROM {source}")
    for name in ("src", "t", "z", "y", "x", "v", "pieces", "b", "c", "m", "n", "hp", "cp", "bands", "mp"):
        out = out.replace(f"\n{name} AS (", f"\n{name}{n} AS (").replace(f", {name} AS (", f", {name}{n} AS (").replace(f"FROM {name})", f"FROM {name}{n})").replace(f"FROM {name} WHERE", f"FROM {name}{n} WHERE")
    return out if not out.startswith("src AS") else f"src{n} AS" + out[len("src AS") :]


def _positions(n: int, source: str) -> str:
    ctes = ",\n".join(_renamed(c, 10 * n + i, source) for i, c in enumerate((H_PEAKS, C_PEAKS, IR, MS)))
    return f"""{ctes}, pos{n} AS (SELECT gt_id, list(shift ORDER BY pos) AS ps FROM hp{10 * n} GROUP BY gt_id UNION ALL SELECT gt_id, c FROM cp{10 * n + 1}
    UNION ALL SELECT gt_id, list(wn ORDER BY pos) FROM bands{10 * n + 2} GROUP BY gt_id UNION ALL SELECT gt_id, list_transform(ps, lambda r: r[1]) FROM mp{10 * n + 3})"""


CONFUSION = f"""wt AS (SELECT wide_id, molecule_name, regexp_replace(file_name, '\\.pdf$', '') AS f_name, unnest(['1H NMR', '13C NMR', 'IR', 'MS']) AS test_type, unnest([h1_nmr, c13_nmr, ir, ms]) AS test_text FROM wide_records),
fw AS (SELECT f_name, molecule_name, test_type, arg_min(test_text, wide_id) AS other FROM wt WHERE test_text IS NOT NULL GROUP BY 1, 2, 3),
pt AS (SELECT g.gt_id, g.f_name, g.molecule_name, g.test_type, g.test_text, f.other FROM gt_tests g JOIN fw f ON f.f_name = g.f_name AND f.molecule_name = g.molecule_name AND f.test_type = g.test_type WHERE g.test_text IS NOT NULL),
other_side AS (SELECT gt_id, test_type, other AS test_text FROM pt), true_side AS (SELECT gt_id, test_type, test_text FROM pt),
{_positions(1, 'true_side')}, {_positions(2, 'other_side')},
bothp AS (SELECT pt.gt_id, pt.f_name, pt.molecule_name, pt.test_type, coalesce(a.ps, []) AS a, coalesce(b.ps, []) AS b FROM pt LEFT JOIN pos1 a ON a.gt_id = pt.gt_id LEFT JOIN pos2 b ON b.gt_id = pt.gt_id),
near AS (SELECT *, list_transform(b, lambda p: CASE WHEN list_min(list_transform(a, lambda t: abs(t - p))) <= 0.01 THEN list_position(list_transform(a, lambda t: abs(t - p)), list_min(list_transform(a, lambda t: abs(t - p)))) END) AS j FROM bothp),
hits AS (SELECT *, len(list_distinct(list_filter(j, lambda i: i IS NOT NULL))) AS h FROM near),
cm AS (SELECT gt_id, f_name, molecule_name, test_type, CASE WHEN len(a) > 0 THEN h ELSE 0 END AS tp, CASE WHEN len(a) > 0 THEN len(b) - h ELSE 0 END AS fp, CASE WHEN len(a) > 0 THEN len(a) - h ELSE 0 END AS fn FROM hits),
pr AS (SELECT *, CAST(round(CAST(CAST(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS VARCHAR) AS DECIMAL(30, 20)), 2) AS DOUBLE) AS precision, CAST(round(CAST(CAST(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS VARCHAR) AS DECIMAL(30, 20)), 2) AS DOUBLE) AS recall FROM cm),
scored AS (SELECT *, CAST(round(CAST(CAST(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS VARCHAR) AS DECIMAL(30, 20)), 2) AS DOUBLE) AS f1 FROM pr)"""
PLATEAU = """p AS (SELECT f_name, spectrum_id, page_number // 8 AS v FROM spectra WHERE page_number IS NOT NULL), d AS (SELECT f_name, spectrum_id, lead(v) OVER (PARTITION BY f_name ORDER BY spectrum_id) - v AS d FROM p),
e AS (SELECT *, lag(d) OVER w AS b, lead(d) OVER w AS a, row_number() OVER w - 1 AS i FROM d WHERE d IS NOT NULL WINDOW w AS (PARTITION BY f_name ORDER BY spectrum_id)),
g AS (SELECT *, CASE WHEN b IS NULL THEN a - d WHEN a IS NULL THEN d - b ELSE (a - b) / 2 END AS g FROM e),
o AS (SELECT f_name, i, max(abs(g)) OVER w <= 1 AND count(g) OVER w = 5 AS ok FROM g WINDOW w AS (PARTITION BY f_name ORDER BY spectrum_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
plateaus AS (SELECT f_name, coalesce(min(CASE WHEN ok THEN i END), -1) AS plateau FROM o GROUP BY f_name)"""
BOXES = "boxes AS (SELECT nmr_id, f_name, CAST(provenance.page_number AS BIGINT) AS page, provenance.bbox AS box FROM nmr_data WHERE provenance.bbox IS NOT NULL AND provenance.page_number IS NOT NULL)"
FILES = "files AS (SELECT f_name, count(DISTINCT molecule_name) AS molecules, " + ", ".join(f"count(CASE WHEN test_type = '{k}' THEN 1 END) AS {B.column_name(k)}" for k in TEST_TYPES) + " FROM gt_tests WHERE f_name IS NOT NULL GROUP BY f_name)"
COLOURED = "coloured AS (SELECT test_type, [" + ", ".join(f"'{c}'" for c in COLOURS) + "][r] AS colour FROM (SELECT test_type, row_number() OVER (ORDER BY test_type) AS r FROM (SELECT DISTINCT test_type FROM spectra WHERE test_type IS NOT NULL)) WHERE r <= 8)"
ANNOT = """ann AS (SELECT nmr_id, nucleus, raw_text, provenance.bbox AS b, substr(sha256(CAST(nmr_id AS VARCHAR) || '|' || nucleus), 1, 10) AS id FROM nmr_data WHERE provenance.bbox IS NOT NULL AND provenance.page_number IS NOT NULL AND nucleus IS NOT NULL)"""
_IW = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0.0::DOUBLE) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0.0::DOUBLE)"


def oracle_sql() -> dict[str, str]:
    area = lambda r: f"({r}.x1 - {r}.x0) * ({r}.y1 - {r}.y0)"
    union = f"({area('a')} + {area('b')} - {_IW})"
    return {
        "test_sequences": f"WITH {SEQS} SELECT user_id, sequence, first_pos, last_pos, array_to_string(types, ',') AS types FROM seqs",
        "common_sequence": f"WITH {COMMON} SELECT array_to_string(types, ',') AS types, n FROM common",
        "sequence_statistics": f"WITH {SEQS} SELECT avg(len(types)) AS mean_tests, count(DISTINCT types) AS kinds FROM seqs",
        "segment_sizes": f"""WITH {COMMON}, s AS (SELECT user_id, sequence, seqs.types AS t, common.types AS c, len(seqs.types) / len(common.types) AS size FROM seqs CROSS JOIN common),
            o AS (SELECT *, CAST(ceil(size) AS BIGINT) AS up, {_occ('t', 'c', 'len(c)')} AS times FROM s)
            SELECT user_id, sequence, size, greatest(up, times) AS max_molecules, least(up, times) AS min_molecules, CASE WHEN size = 0 THEN 'empty' WHEN size < 1 THEN 'incomplete' ELSE 'complete' END AS class FROM o""",
        "pair_occurrences": f"WITH {TESTS}, l AS (SELECT user_id, list(event_type ORDER BY event_id) AS t FROM tests GROUP BY user_id) SELECT user_id, {_occ('t', chr(91) + chr(39) + 'view' + chr(39) + ', ' + chr(39) + 'click' + chr(39) + chr(93), '2')} AS n FROM l",
        "neighbours_to_merge": f"WITH {MERGE} SELECT user_id, sequence, next FROM pairs",
        "merged_chains": f"""WITH {MERGE}, c AS (SELECT *, CASE WHEN lag(next) OVER w IS NULL OR (sequence <> lag(next) OVER w AND sequence <> lag(sequence) OVER w) THEN 1 ELSE 0 END AS o FROM pairs WINDOW w AS (PARTITION BY user_id ORDER BY sequence, next)),
            k AS (SELECT *, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY sequence, next) AS BIGINT) AS chain FROM c)
            SELECT user_id, chain, array_to_string(list_transform(list_sort(list_distinct(flatten(list([sequence, next])))), lambda x: CAST(x AS VARCHAR)), ',') AS members FROM k GROUP BY user_id, chain""",
        "page_runs": "SELECT f_name, min(page_number) AS first_n, max(page_number) AS last_n, count(*) AS n FROM (SELECT f_name, page_number, page_number - row_number() OVER (PARTITION BY f_name ORDER BY page_number) AS g FROM (SELECT DISTINCT f_name, page_number FROM spectra WHERE page_number IS NOT NULL)) GROUP BY f_name, g",
        "first_plateau": f"WITH {PLATEAU} SELECT * FROM plateaus",
        "cut_before_gap": f"""WITH {PLATEAU}, q AS (SELECT f_name, row_number() OVER w - 1 AS i, page_number - lag(page_number) OVER w AS step FROM spectra WHERE page_number IS NOT NULL WINDOW w AS (PARTITION BY f_name ORDER BY spectrum_id))
            SELECT x.f_name, CASE WHEN any_value(plateau) > 0 THEN coalesce(max(CASE WHEN step > 2 AND i > 0 AND i <= plateau THEN i END), 0) ELSE any_value(plateau) END AS cut FROM plateaus x JOIN q USING (f_name) GROUP BY x.f_name""",
        "label_config": f"""WITH {COLOURED} SELECT '<View>' || chr(10) || '  <RectangleLabels name="rectangles" toName="pdf" showInline="true">' || chr(10)
            || string_agg('    <Label value="' || test_type || '" background="' || colour || '"/>', chr(10) ORDER BY test_type) || chr(10) || '    <Label value="Molecule" background="#AE2012"/>' || chr(10) || '  </RectangleLabels>' || chr(10)
            || '  <Image valueList="$pages" name="pdf"/>' || chr(10) || '  <TextArea name="transcription" toName="pdf" editable="true" perRegion="true"/>' || chr(10) || '</View>' AS config FROM coloured""",
        "smoothed_bounds": """WITH b AS (SELECT nmr_id, f_name, provenance.page_number AS p, provenance.bbox.y0 AS y0, provenance.bbox.y1 AS y1 FROM nmr_data WHERE provenance.bbox.y0 IS NOT NULL AND provenance.page_number IS NOT NULL)
            SELECT nmr_id, coalesce((lag(y1) OVER w + y0) / 2, y0) AS smooth_upper, coalesce((lead(y0) OVER w + y1) / 2, y1) AS smooth_lower FROM b WINDOW w AS (PARTITION BY f_name, p ORDER BY y0, nmr_id)""",
        "pic_clusters": f"WITH {PICS} SELECT doc, cluster, min(page) AS page, count(*) AS n FROM cl GROUP BY doc, cluster",
        "leading_pics": f"WITH {PICS} SELECT * FROM lead_pics",
        "proximity_pairs": f"""WITH {PICS}, s AS (SELECT o_orderkey // 10 AS doc, o_orderkey AS segment, o_orderkey % 7 + 1 AS page, CAST(o_custkey % 100 AS DOUBLE) AS u FROM orders),
            p AS (SELECT l.doc, l.page, l.cluster AS pic, s.segment, abs(l.y + 4.0::DOUBLE - s.u) AS distance FROM lead_pics l JOIN s ON s.doc = l.doc AND s.page = l.page)
            SELECT *, row_number() OVER (PARTITION BY doc ORDER BY distance, pic, segment) AS rank FROM p""",
        "greedy_match": f"""WITH RECURSIVE {PICS}, s AS (SELECT o_orderkey // 10 AS doc, o_orderkey AS segment, o_orderkey % 7 + 1 AS page, CAST(o_custkey % 100 AS DOUBLE) AS u, o_orderkey % 3 AS cap FROM orders),
            p AS (SELECT l.doc, l.page, l.cluster AS pic, s.segment, s.cap, abs(l.y + 4.0::DOUBLE - s.u) AS distance FROM lead_pics l JOIN s ON s.doc = l.doc AND s.page = l.page),
            o AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY distance, pic, segment) AS r, count(*) OVER (PARTITION BY doc, page) AS n FROM p),
            st(doc, page, n, k, taken, filled) AS (SELECT DISTINCT doc, page, n, CAST(0 AS BIGINT), []::BIGINT[], []::BIGINT[] FROM o
                UNION ALL SELECT st.doc, st.page, st.n, st.k + 1, CASE WHEN good THEN list_append(taken, pic) ELSE taken END, CASE WHEN good THEN list_append(filled, segment) ELSE filled END
                FROM (SELECT st.*, o.pic, o.segment, NOT list_contains(st.taken, o.pic) AND len(list_filter(st.filled, lambda x: x = o.segment)) < o.cap + CASE WHEN st.k < st.n THEN 0 ELSE 1 END AS good
                      FROM st JOIN o ON o.doc = st.doc AND o.page = st.page AND o.r = st.k % st.n + 1 WHERE st.k < 2 * st.n) st)
            SELECT doc, unnest(taken) AS pic, unnest(filled) AS segment FROM st WHERE k = 2 * n""",
        "filled_matched_rate": """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT o_custkey % 24 AS doc, coalesce(n, 0) AS t, o_orderkey % 3 AS p FROM orders LEFT JOIN n ON l_orderkey = o_orderkey),
            a AS (SELECT doc, count(CASE WHEN t > 0 THEN 1 END) AS filled, count(CASE WHEN t > 0 AND p > 0 THEN 1 END) AS matched FROM s GROUP BY doc) SELECT doc, filled, matched, round(matched / filled, 2) AS rate FROM a WHERE filled > 0""",
        "peak_confusion": f"WITH {CONFUSION} SELECT * FROM scored",
        "score_summary": f"WITH {CONFUSION} SELECT count(f1) AS n, avg(f1) AS mean, stddev_pop(f1) AS std_pop, stddev_samp(f1) AS std_samp FROM scored",
        "metric_summary": f"WITH {CONFUSION} SELECT avg(precision) AS mean_precision, avg(recall) AS mean_recall, avg(f1) AS mean_f1, CAST(sum(tp) AS BIGINT) AS sum_tp, CAST(sum(fp) AS BIGINT) AS sum_fp, CAST(sum(fn) AS BIGINT) AS sum_fn FROM scored",
        "metric_filter": f"WITH {CONFUSION} SELECT gt_id, f1 FROM scored WHERE precision >= 0.8 AND recall >= 0.5",
        "molecule_scores": f"""WITH {CONFUSION}, m AS (SELECT f_name, molecule_name, list_filter([{', '.join(f"max(CASE WHEN test_type = '{k}' AND tp > 0 THEN f1 END)" for k in TEST_TYPES)}], lambda x: x > 0) AS f FROM scored GROUP BY f_name, molecule_name)
            SELECT f_name, molecule_name, CAST(round(CAST(CAST(CASE WHEN len(f) > 0 THEN list_reduce(f, lambda a, b: a + b) / len(f) ELSE 0.0::DOUBLE END AS VARCHAR) AS DECIMAL(30, 20)), 2) AS DOUBLE) AS score FROM m""",
        "entity_prf": """WITH p AS (SELECT DISTINCT molecule_smiles_by_images AS s FROM wide_records WHERE molecule_smiles_by_images IS NOT NULL), g AS (SELECT DISTINCT smiles AS s FROM molecules WHERE smiles IS NOT NULL),
            c AS (SELECT (SELECT count(*) FROM p WHERE s IN (SELECT s FROM g)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng),
            r AS (SELECT tp, np - tp AS fp, ng - tp AS fn, CASE WHEN np > 0 THEN tp / np ELSE 0.0::DOUBLE END AS precision, CASE WHEN ng > 0 THEN tp / ng ELSE 0.0::DOUBLE END AS recall FROM c)
            SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM r""",
        "calibration": """WITH s AS (SELECT regexp_replace(file_name, '\\.pdf$', '') AS f_name, molecule_smiles_by_images AS s, 1 AS p, 0 AS g FROM wide_records UNION ALL SELECT f_name, smiles, 0, 1 FROM molecules),
            e AS (SELECT f_name, s, max(p) AS p, max(g) AS g FROM s WHERE s IS NOT NULL GROUP BY 1, 2),
            c AS (SELECT f_name, count(*) FILTER (p = 1 AND g = 1) AS tp, count(*) FILTER (p = 1 AND g = 0) AS fp, count(*) FILTER (p = 0 AND g = 1) AS fn FROM e GROUP BY 1),
            r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall FROM c)
            SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM r""",
        "bbox_iou": f"WITH {BOXES}, j AS (SELECT p.nmr_id, p.box AS a, n.box AS b FROM boxes p JOIN boxes n ON n.nmr_id = p.nmr_id + 1) SELECT nmr_id, CASE WHEN {union} <> 0 THEN {_IW} / {union} ELSE 0.0::DOUBLE END AS iou FROM j",
        "bbox_union": f"WITH {BOXES}, u AS (SELECT f_name, page, min(box.x0) AS x, min(box.y0) AS y, max(box.x1) AS x1, max(box.y1) AS y1 FROM boxes GROUP BY f_name, page) SELECT f_name, page, round(x, 2) AS x, round(y, 2) AS y, round(x1 - round(x, 2), 2) AS w, round(y1 - round(y, 2), 2) AS h FROM u",
        "bbox_scaled": f"""WITH {BOXES}, s AS (SELECT nmr_id, box.x0 AS x, box.y0 AS y, box.x1 - box.x0 AS w, box.y1 - box.y0 AS h FROM boxes)
            SELECT nmr_id, x, y, w, h, CAST(trunc(y / 100 * 100.0::DOUBLE) AS BIGINT) AS top, CAST(trunc((y + h) / 100 * 100.0::DOUBLE) AS BIGINT) AS bottom, CAST(trunc(x / 100 * 200.0::DOUBLE) AS BIGINT) AS left, CAST(trunc((x + w) / 100 * 200.0::DOUBLE) AS BIGINT) AS right FROM s""".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'),
        "provenance_pages": f"WITH {BOXES} SELECT f_name, page, count(*) AS boxes, min(nmr_id) AS first_id, string_agg(CAST(nmr_id AS VARCHAR), ',' ORDER BY nmr_id) AS ids FROM boxes GROUP BY f_name, page",
        "gt_stats": "SELECT 'total_' || test_type AS stat, count(*) AS n FROM gt_tests WHERE test_type IS NOT NULL GROUP BY test_type UNION ALL SELECT 'rows', count(*) FROM gt_tests UNION ALL SELECT 'files', count(DISTINCT f_name) FROM gt_tests",
        "gt_files": f"WITH {FILES} SELECT * FROM files",
        "gt_means": f"WITH {FILES} SELECT avg(molecules) AS mean_molecules, " + ", ".join(f"avg({B.column_name(k)}) AS mean_{B.column_name(k)}" for k in TEST_TYPES) + " FROM files",
        "gt_groups": "SELECT f_name, molecule_name, count(*) AS n_tests, coalesce(string_agg(coalesce(test_type, ''), ',' ORDER BY gt_id), '') AS types FROM gt_tests WHERE f_name IS NOT NULL AND molecule_name IS NOT NULL GROUP BY f_name, molecule_name",
        "wide_export": "SELECT molecule_id, " + ", ".join(f"arg_max_null(text_representation, CASE WHEN test_type = '{k}' THEN spectrum_id END) FILTER (test_type = '{k}') AS {c}" for k, c in _WIDE.items()) + " FROM spectra GROUP BY molecule_id",
        "type_colours": f"WITH {COLOURED} SELECT * FROM coloured",
        "annotation_rows": f"""WITH {ANNOT} SELECT nmr_id, id, CAST(1 AS BIGINT) AS item_index, b.x0 AS x, b.y0 AS y, b.x1 - b.x0 AS w, b.y1 - b.y0 AS h, p AS part, CASE WHEN p = 0 THEN 'rectanglelabels' ELSE 'textarea' END AS type, CASE WHEN p = 0 THEN nucleus ELSE raw_text END AS value FROM ann CROSS JOIN (SELECT unnest([0, 1]) AS p)""",
        "annotation_tasks": f"""WITH {ANNOT} SELECT nmr_id, CAST(to_json({{'result': [
            {{'item_index': 1, 'id': id, 'part': 0, 'type': 'rectanglelabels', 'value': {{'x': b.x0, 'y': b.y0, 'width': b.x1 - b.x0, 'height': b.y1 - b.y0, 'labels': [nucleus]}}}},
            {{'item_index': 1, 'id': id, 'part': 1, 'type': 'textarea', 'value': {{'x': b.x0, 'y': b.y0, 'width': b.x1 - b.x0, 'height': b.y1 - b.y0, 'labels': [raw_text]}}}}]}}) AS VARCHAR) AS task FROM ann""",
        "annotation_round_trip": f"WITH {ANNOT} SELECT nmr_id, nucleus AS label, raw_text AS text, CAST(1 AS BIGINT) AS boxes FROM ann",
        "updated_tests": """WITH c AS (SELECT molecule_id, test_type, min('checked: ' || text_representation) AS new FROM spectra WHERE spectrum_id % 7 = 0 GROUP BY 1, 2)
            SELECT s.spectrum_id, coalesce(c.new, s.text_representation) AS text_representation FROM spectra s LEFT JOIN c ON c.molecule_id = s.molecule_id AND c.test_type = s.test_type""",
        "canonical_spectra": "SELECT concat_ws('_', 'spec', test_type, molecule_id) AS id, test_type AS type, molecule_id, text_representation, CAST(coalesce(page_number, 0) AS BIGINT) AS page_number, 'text' AS source, 'legacy_parser' AS algorithm, 0.8::DOUBLE AS confidence FROM spectra",
        "graph_nodes": "SELECT kind, count(*) AS n FROM (SELECT DISTINCT molecule_id AS node, 'molecule' AS kind FROM molecules UNION SELECT DISTINCT concat_ws('_', 'spec', test_type, molecule_id), 'spectrum' FROM spectra) GROUP BY kind",
        "resolved_names": """WITH k AS (SELECT molecule_name, arg_min(molecule_smiles_by_name, wide_id) AS known FROM wide_records WHERE molecule_name IS NOT NULL AND molecule_smiles_by_name IS NOT NULL GROUP BY 1)
            , l AS (SELECT molecule_name, arg_min(opsin_smiles, gt_id) AS second FROM gt_tests WHERE molecule_name IS NOT NULL AND opsin_smiles IS NOT NULL GROUP BY 1)
            SELECT molecule_id, coalesce(nullif(smiles, ''), nullif(known, ''), nullif(second, ''), '') AS smiles FROM molecules LEFT JOIN k USING (molecule_name) LEFT JOIN l USING (molecule_name)""",
        "set_operations": """WITH a AS (SELECT f_name FROM gt_tests WHERE f_name IS NOT NULL), b AS (SELECT f_name FROM molecules WHERE f_name IS NOT NULL)
            SELECT 'union_all' AS op, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'distinct', count(DISTINCT f_name) FROM a
            UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
            UNION ALL SELECT 'anti', count(*) FROM a WHERE f_name NOT IN (SELECT f_name FROM b) UNION ALL SELECT 'semi', count(*) FROM a WHERE f_name IN (SELECT f_name FROM b)""",
        "sorted_tests": "SELECT gt_id, molecule_name FROM gt_tests WHERE molecule_name IS NOT NULL ORDER BY molecule_name, gt_id",
        "serial_groups": "SELECT serial, array_to_string(list_sort(list(name)), ';') AS names FROM (SELECT molecule_id || '_full' AS name, string_split(molecule_id || '_full', '_')[-2] AS serial FROM molecules) GROUP BY serial",
        "number_shapes": "SELECT CAST(length(regexp_extract(trim(coupling_constants), '^-?\\d+\\.(\\d+)$', 1)) AS BIGINT) AS decimals, count(*) AS n FROM nmr_peaks GROUP BY 1",
    }
