"""Further queries of the operator inventory, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spectrail.functions import peaks as P
from spectrail.functions.tokens import FRAGMENTS, NAME_TOKENS, TEST_FAMILIES, TEST_TYPES
from spectrail.operators import documents as D
from spectrail.operators import pictures as PIC
from spectrail.operators import segments as S
from spectrail.operators import tables as B
from spectrail.plans import pipeline
from spectrail.plans.survey_tables import SEQS
from spectrail.plans.survey_text import _FRAGMENTS, _TOKENS, HITS, LINES, POSITIONS, q
from spectrail.session import shared_folder, spread, table
from spectrail.sources import readers, sinks


def _lines(spark, d):
    return S.document_lines(spread(table(spark, d, "documents", "doc_id", "text")), "doc_id", "text")


def page_renumbered(spark, d):
    """Blocks in reading order: the boxes of a page by their upper edge."""
    b = table(spark, d, "nmr_data", "nmr_id", "f_name", "provenance").select("nmr_id", "f_name", F.col("provenance.page_number").alias("page"), F.col("provenance.bbox.y0").alias("y0")).filter("page is not null and y0 is not null and f_name is not null")
    return S.renumber(b, "f_name", ["y0", "nmr_id"]).select("nmr_id", "line")


def _with_tests(spark, d):
    return D.with_tests(D.segment_arrays(spread(table(spark, d, "documents", "doc_id", "text")), "doc_id", "text"))


def split_segments(spark, d):
    """Segments cut at the ends of their test sequences."""
    parts = D.unpacked(_with_tests(spark, d), ["doc_id"], D.split_at_sequences(F.col("segments"), F.col("tests")), "segment")
    return parts.select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("segment", "part", "first", "n_lines")), F.array_join("types", ",").alias("types"))


def adjusted_segments(spark, d):
    """Segments merged by the document's common sequence, with the types of their tests; those without a test are dropped."""
    rows = D.unpacked(D.adjusted(D.segment_arrays(spread(table(spark, d, "documents", "doc_id", "text")), "doc_id", "text")), ["doc_id", "tests"], "segments", "segment")
    types = F.transform(D.of_segment(F.col("tests"), F.col("segment")), lambda t: t["test_type"])
    return rows.select("doc_id", F.col("segment").cast("bigint").alias("segment"), F.col("first").cast("bigint").alias("first_seq"), F.size("lines").cast("bigint").alias("n_lines"), F.array_join(types, ",").alias("types"))


def document_outcomes(spark, d):
    """Every document with its numbers of segments and tests, or why there are none."""
    out = pipeline.outcome(spread(table(spark, d, "documents", "doc_id", "text")), "doc_id", "text")
    return out.select("doc_id", "segments", "tests", F.array_join("errors", ";").alias("errors"))


def loop_totals(spark, d):
    """Totals of a run over all documents."""
    o = document_outcomes(spark, d)
    return o.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("errors") == "").alias("success"), F.count_if(F.col("errors") != "").alias("failed"), F.sum("segments").alias("segments"), F.sum("tests").alias("tests"))


def sequence_frequencies(spark, d):
    from spectrail.plans.survey_tables import test_sequences

    return test_sequences(spark, d).groupBy("types").agg(F.count(F.lit(1)).alias("n"))


def bbox_strings(spark, d):
    """The union of a molecule's boxes as x0,y0,x1,y1; the greater corner is 0 at least, a molecule without boxes has an empty string."""
    b = table(spark, d, "nmr_data", "molecule_id", "provenance").select("molecule_id", "provenance.bbox.*")
    u = b.groupBy("molecule_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.greatest(F.max("x1"), F.lit(0.0)).alias("x1"), F.greatest(F.max("y1"), F.lit(0.0)).alias("y1"))
    text = F.concat_ws(",", *(F.col(c).cast("decimal(12,1)").cast("string") for c in ("x0", "y0", "x1", "y1")))
    return u.select("molecule_id", F.when(F.col("x0").isNull(), "").otherwise(text).alias("bbox"))


def ordered_spectra(spark, d):
    """All spectra with their place in the order of pages, then ids, of their file."""
    s = table(spark, d, "spectra", "f_name", "page_number", "spectrum_id").filter("page_number is not null and f_name is not null")
    # a place by page first: a file's pages are few, so no window has to hold a hot file's spectra
    pages = s.groupBy("f_name", "page_number").agg(F.count(F.lit(1)).alias("n"))
    before = pages.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("f_name").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = s.withColumn("own", F.row_number().over(Window.partitionBy("f_name", "page_number").orderBy("spectrum_id")))
    return own.join(before, ["f_name", "page_number"]).select("spectrum_id", (F.col("before") + F.col("own") - 1).cast("bigint").alias("place"))


def test_entries(spark, d):
    """Entries of the test database: the molecule's name, type and text of a test, first and last page."""
    s = table(spark, d, "spectra", "spectrum_id", "molecule_id", "test_type", "text_representation", "page_number")
    m = table(spark, d, "molecules", "molecule_id", "molecule_name")
    return s.join(m, "molecule_id").select("spectrum_id", "molecule_name", "test_type", F.col("text_representation").alias("text"), F.col("page_number").alias("start_page"), F.col("page_number").alias("end_page"))


def page_subset(spark, d):
    """The lines of the pages that hold a test's word."""
    lines = _lines(spark, d)
    pages = S.keyword_lines(lines, TEST_FAMILIES).select("doc_id", "page").distinct()
    return lines.join(pages, ["doc_id", "page"], "left_semi").select("doc_id", "seq")


def molecules_with_tests(spark, d):
    """Molecules that have a spectrum, and only those."""
    return table(spark, d, "molecules", "molecule_id", "f_name").join(table(spark, d, "spectra", "molecule_id").filter("molecule_id is not null"), "molecule_id", "left_semi")


def test_dicts(spark, d):
    """The tests of every wide record, one a row."""
    w = table(spark, d, "wide_records", "wide_id", "h1_nmr", "c13_nmr", "ir", "ms")
    cells = F.array(*(F.struct(F.lit(k).alias("test_type"), F.col(c).alias("test_text")) for k, c in (("1H NMR", "h1_nmr"), ("13C NMR", "c13_nmr"), ("IR", "ir"), ("MS", "ms"))))
    return w.select("wide_id", F.inline(F.filter(cells, lambda t: t["test_text"].isNotNull())))


def taken_pictures(spark, d):
    """Every wide record with the number of pictures taken before of its file; 0 where none were."""
    taken = table(spark, d, "nmr_data", "f_name", "provenance").filter("provenance.modality = 'image' and f_name is not null").groupBy("f_name").agg(F.count(F.lit(1)).alias("n"))
    w = table(spark, d, "wide_records", "wide_id", F.regexp_replace("file_name", r"\.pdf$", "").alias("f_name"))
    return w.join(taken, "f_name", "left").select("wide_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("pictures"))


def updated_boxes(spark, d):
    """Boxes replaced where a corrected one of the same molecule exists, the first in order; others stay."""
    b = table(spark, d, "nmr_data", "nmr_id", "molecule_id", "provenance").select("nmr_id", "molecule_id", "provenance.bbox.*", "provenance.confidence")
    new = b.filter("confidence >= 0.9 and x0 is not null").groupBy("molecule_id").agg(F.min(F.struct("x0", "y0", "x1", "y1")).alias("new"))
    return b.join(new, "molecule_id", "left").select("nmr_id", *(F.coalesce(f"new.{c}", c).alias(c) for c in ("x0", "y0", "x1", "y1")))


def kept_pictures(spark, d):
    """Detected boxes of each page that no surer one overlaps."""
    b = table(spark, d, "nmr_data", "nmr_id", "f_name", "provenance").select("nmr_id", "f_name", "provenance.page_number", "provenance.bbox.*", "provenance.confidence").filter("f_name is not null and page_number is not null")
    return PIC.suppressed(PIC.whole_boxes(b, 612, 792), ["f_name", "page_number"], "nmr_id").select("nmr_id")


def letterboxed(spark, d):
    """Boxes of a page of 612 by 792 in the coordinates of a detector's square of 640."""
    b = table(spark, d, "nmr_data", "nmr_id", "provenance").select("nmr_id", "provenance.bbox.*").filter("x0 is not null")
    return b.select("nmr_id", *PIC.letterbox(612, 792, 640))


def page_lines(spark, d):
    """The lines of the pages of nmr_data's texts, each a block of its page of 612 by 792."""
    b = table(spark, d, "nmr_data", "nmr_id", "f_name", "raw_text", "provenance").select("nmr_id", "f_name", F.col("provenance.page_number").alias("page"), "raw_text", "provenance.bbox.*").filter("f_name is not null and page is not null")
    return S.page_blocks(b, ["f_name", "page"], "nmr_id", "raw_text", (612.0, 792.0)).select("f_name", "page", "line", "text", "bbox.*")


def matched_segments(spark, d):
    """The wide export of documents' segments that start on a page with a picture: one row a segment, a column for each type of test."""
    docs = spread(table(spark, d, "documents", "doc_id", "f_name", "text"))
    rows = D.unpacked(D.adjusted(D.segment_arrays(docs, "doc_id", "text")).join(docs.select("doc_id", "f_name"), "doc_id"), ["doc_id", "f_name", "tests"], "segments", "segment")
    pics = table(spark, d, "nmr_data", "f_name", "provenance").filter("provenance.modality = 'image' and provenance.page_number is not null").select("f_name", (F.col("provenance.page_number") % 3).alias("page")).distinct()
    kept = rows.withColumn("page", F.floor(F.col("first") / S.LINES_PER_PAGE)).join(pics, ["f_name", "page"], "left_semi")
    tests = kept.select("doc_id", "segment", F.inline(D.of_segment(F.col("tests"), F.col("segment")).cast("array<struct<own:int,hit:int,test_type:string,test_text:string>>")))
    return B.wide(tests, ["doc_id", "segment"], "test_type", "test_text", "hit")


def csv_round_trip(spark, d):
    """Molecules written as wide CSV to the shared folder and read again."""
    path = f"{shared_folder(spark)}/csv_round_trip"
    sinks.write_wide_csv(table(spark, d, "molecules", "molecule_id", "molecule_name", "smiles", "label"), path)
    return readers.wide_csv(spark, path).select("molecule_id", "molecule_name", "smiles", "label")


def part_round_trip(spark, d):
    """Spectra written by file and one file's part read again."""
    path = f"{shared_folder(spark)}/part_round_trip"
    s = table(spark, d, "spectra", "f_name", "spectrum_id", "test_type")
    sinks.write_parts(s, path)
    return sinks.read_part(spark, path, "SI_compendium_A", schema=s.schema).select("spectrum_id", "test_type")


def json_round_trip(spark, d):
    """Ground truth written as one JSON object a line and read again by schema."""
    path = f"{shared_folder(spark)}/json_round_trip"
    g = table(spark, d, "gt_tests", "gt_id", "test_type", "test_text")
    sinks.write_records(g.select(F.to_json(F.struct("gt_id", "test_type", "test_text")).alias("record")), path)
    return spark.read.schema("gt_id bigint, test_type string, test_text string").json(path)


def first_pages(spark, d):
    return S.first_pages(_lines(spark, d), "doc_id").select("doc_id", F.length("text").cast("bigint").alias("length"))


def peak_range(spark, d):
    """Tests of all types with a peak between 120 and 200."""
    t = table(spark, d, "gt_tests", "gt_id", "f_name", "test_type", "test_text").filter(F.col("test_type").isin(*TEST_TYPES))
    return B.filter_tests(t, between=(120, 200), positions=P.positions(F.col("test_text"), F.col("test_type"))).select("gt_id")


def changes_by_index(spark, d):
    s = table(spark, d, "wide_records", "wide_id", "image_path")
    c = table(spark, d, "molecules", F.substring("molecule_id", 8, 6).cast("bigint").alias("wide_id"), F.concat(F.lit("images/"), "molecule_id").alias("image_path"))
    return B.apply_by_index(s, c, "wide_id", "image_path")


def name_tokens(spark, d):
    """How often each name fragment is found, over all names."""
    found = F.explode(F.regexp_extract_all(F.col("molecule_name"), F.lit(f"({NAME_TOKENS})"), F.lit(1)))
    tokens = table(spark, d, "molecules", "molecule_name").select(found.alias("token")).select(F.lower("token").alias("token"))
    return tokens.filter(F.col("token").isin(*FRAGMENTS)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def matched_export(spark, d):
    """The wide export of molecules with a picture only."""
    with_pic = table(spark, d, "wide_records", "wide_id", "molecule_name", "image_path").filter(F.col("image_path").rlike(r"\S"))
    return with_pic.groupBy("molecule_name").agg(F.max_by("image_path", "wide_id").alias("image_path"), F.count(F.lit(1)).alias("n"))


_NAMES = [adjusted_segments, document_outcomes, loop_totals, sequence_frequencies, bbox_strings, ordered_spectra, test_entries, page_subset, molecules_with_tests, test_dicts, taken_pictures, updated_boxes, kept_pictures, letterboxed, page_lines, matched_segments, csv_round_trip, part_round_trip, json_round_trip, page_renumbered, split_segments, first_pages, peak_range, changes_by_index, name_tokens, matched_export]


def queries() -> dict:
    return {f.__name__: f for f in _NAMES}


def oracle_sql() -> dict[str, str]:
    fragments = ", ".join(q(f) for f in _FRAGMENTS)
    return {
        "page_renumbered": "SELECT nmr_id, row_number() OVER (PARTITION BY f_name, provenance.page_number ORDER BY provenance.bbox.y0, nmr_id) - 1 AS line FROM nmr_data WHERE provenance.page_number IS NOT NULL AND provenance.bbox.y0 IS NOT NULL AND f_name IS NOT NULL",
        "sequence_frequencies": f"WITH {SEQS} SELECT array_to_string(types, ',') AS types, count(*) AS n FROM seqs GROUP BY seqs.types",
        "bbox_strings": """WITH u AS (SELECT molecule_id, min(provenance.bbox.x0) AS x0, min(provenance.bbox.y0) AS y0, greatest(max(provenance.bbox.x1), 0) AS x1, greatest(max(provenance.bbox.y1), 0) AS y1 FROM nmr_data GROUP BY molecule_id)
            SELECT molecule_id, CASE WHEN x0 IS NULL THEN '' ELSE concat_ws(',', CAST(x0 AS DECIMAL(12, 1)), CAST(y0 AS DECIMAL(12, 1)), CAST(x1 AS DECIMAL(12, 1)), CAST(y1 AS DECIMAL(12, 1))) END AS bbox FROM u""",
        "ordered_spectra": "SELECT spectrum_id, row_number() OVER (PARTITION BY f_name ORDER BY page_number, spectrum_id) - 1 AS place FROM spectra WHERE page_number IS NOT NULL AND f_name IS NOT NULL",
        "test_entries": "SELECT s.spectrum_id, m.molecule_name, s.test_type, s.text_representation AS text, s.page_number AS start_page, s.page_number AS end_page FROM spectra s JOIN molecules m ON m.molecule_id = s.molecule_id",
        "page_subset": f"WITH {HITS} SELECT doc_id, seq FROM lines l WHERE EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = l.doc_id AND h.seq // 50 = l.page)",
        "molecules_with_tests": "SELECT molecule_id, f_name FROM molecules WHERE molecule_id IN (SELECT molecule_id FROM spectra WHERE molecule_id IS NOT NULL)",
        "test_dicts": "SELECT wide_id, test_type, test_text FROM (SELECT wide_id, unnest(['1H NMR', '13C NMR', 'IR', 'MS']) AS test_type, unnest([h1_nmr, c13_nmr, ir, ms]) AS test_text FROM wide_records) WHERE test_text IS NOT NULL",
        "taken_pictures": """WITH t AS (SELECT f_name, count(*) AS n FROM nmr_data WHERE provenance.modality = 'image' AND f_name IS NOT NULL GROUP BY 1)
            SELECT wide_id, coalesce(n, 0) AS pictures FROM wide_records w LEFT JOIN t ON t.f_name = regexp_replace(w.file_name, '\\.pdf$', '')""",
        "updated_boxes": """WITH b AS (SELECT nmr_id, molecule_id, provenance.bbox.x0 AS x0, provenance.bbox.y0 AS y0, provenance.bbox.x1 AS x1, provenance.bbox.y1 AS y1, provenance.confidence AS c FROM nmr_data),
            n AS (SELECT molecule_id, min((x0, y0, x1, y1)) AS v FROM b WHERE c >= 0.9 AND x0 IS NOT NULL GROUP BY 1)
            SELECT nmr_id, coalesce(v[1], x0) AS x0, coalesce(v[2], y0) AS y0, coalesce(v[3], x1) AS x1, coalesce(v[4], y1) AS y1 FROM b LEFT JOIN n USING (molecule_id)""",
        "letterboxed": """SELECT nmr_id, provenance.bbox.x0 * (640.0::DOUBLE / 792) + (640 - 612 * (640.0::DOUBLE / 792)) / 2 AS x0, provenance.bbox.y0 * (640.0::DOUBLE / 792) AS y0,
            provenance.bbox.x1 * (640.0::DOUBLE / 792) + (640 - 612 * (640.0::DOUBLE / 792)) / 2 AS x1, provenance.bbox.y1 * (640.0::DOUBLE / 792) AS y1 FROM nmr_data WHERE provenance.bbox.x0 IS NOT NULL""",
        "csv_round_trip": "SELECT molecule_id, molecule_name, smiles, label FROM molecules",
        "part_round_trip": "SELECT spectrum_id, test_type FROM spectra WHERE f_name = 'SI_compendium_A'",
        "json_round_trip": "SELECT gt_id, test_type, test_text FROM gt_tests",
        "first_pages": f"WITH {LINES} SELECT doc_id, CAST(length(string_agg(text, chr(10) ORDER BY seq)) AS BIGINT) AS length FROM lines WHERE page < 5 GROUP BY doc_id",
        "peak_range": f"WITH {POSITIONS} SELECT DISTINCT gt_id FROM ps JOIN gt_tests g USING (gt_id) WHERE p BETWEEN 120 AND 200",
        "changes_by_index": """WITH c AS (SELECT TRY_CAST(substr(molecule_id, 8, 6) AS BIGINT) AS wide_id, min('images/' || molecule_id) AS new FROM molecules GROUP BY 1)
            SELECT w.wide_id, coalesce(c.new, w.image_path) AS image_path FROM wide_records w LEFT JOIN c ON c.wide_id = w.wide_id""",
        "name_tokens": f"SELECT token, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(molecule_name, {q('(' + _TOKENS + ')')}, 1))) AS token FROM molecules) WHERE token IN ({fragments}) GROUP BY token",
        "matched_export": "SELECT molecule_name, arg_max(image_path, wide_id) AS image_path, count(*) AS n FROM wide_records WHERE regexp_matches(image_path, '\\S') GROUP BY molecule_name",
    }
