"""Queries of lines, segments, texts and peaks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.functions import peaks as P
from spectrail.functions import text as X
from spectrail.functions.tokens import TEST_FAMILIES, TEST_TYPES
from spectrail.operators import documents as D
from spectrail.operators import segments as S
from spectrail.session import spread, table


def q(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return S.document_lines(spread(table(spark, d, "documents", "doc_id", "text")), "doc_id", "text")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return S.line_statistics(_lines(spark, d), "doc_id")


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)


def line_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d)


def segment_starts(spark: SparkSession, d: str) -> DataFrame:
    return S.segment_starts(_stats(spark, d), "doc_id").select("doc_id", "seq")


def first_over(spark: SparkSession, d: str) -> DataFrame:
    return S.first_over(_stats(spark, d), "doc_id")


def _segment_rows(spark: SparkSession, d: str) -> DataFrame:
    """Segments from documents as rows: no shuffle."""
    docs = spread(table(spark, d, "documents", "doc_id", "text"))
    return D.unpacked(D.segment_arrays(docs, "doc_id", "text"), ["doc_id"], "segments", "segment")


def _span(rows: DataFrame, per_page: int = S.LINES_PER_PAGE) -> DataFrame:
    first = F.col("first").cast("bigint")
    last = first + F.size("lines") - 1
    page = lambda c: F.floor(c / per_page)
    return rows.select("doc_id", F.col("segment").cast("bigint").alias("segment"), first.alias("first_seq"), last.alias("last_seq"), page(first).alias("start_page"), page(last).alias("end_page"), F.size("lines").cast("bigint").alias("n_lines"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    return _span(_segment_rows(spark, d))


def segment_names(spark: SparkSession, d: str) -> DataFrame:
    return _segment_rows(spark, d).select("doc_id", F.col("segment").cast("bigint").alias("segment"), D.name_of(F.col("lines")).alias("name"))


def segment_pages(spark: SparkSession, d: str) -> DataFrame:
    return S.segment_pages(segments(spark, d), "doc_id")


#: Lines of a page for long_segments: pages of the usual size hold whole documents here.
SHORT_PAGE = 4


def long_segments(spark: SparkSession, d: str) -> DataFrame:
    """All segments, those that span more than two pages located again: where they begin then and how many lines they have."""
    docs = D.line_arrays(spread(table(spark, d, "documents", "doc_id", "text")), "doc_id", "text")
    segs = docs.select("doc_id", "lines", "stats", D.starts(F.col("stats")).alias("at")).select("doc_id", "lines", "stats", D.cut(F.col("lines"), F.col("at")).alias("segs"))
    again = D.unpacked(segs, ["doc_id"], D.relocated(F.col("segs"), F.col("stats"), F.col("lines"), per_page=SHORT_PAGE), "segment")
    return _span(again).select("doc_id", "segment", "first_seq", "n_lines")


OPTIONS = [(i, float(t), float(s)) for i, (t, s) in enumerate((t, s) for t in (40, 60, 80) for s in (20, 30, 40))]


def _option_starts(spark: SparkSession, d: str) -> DataFrame:
    """Rows (doc_id, option, seq): the lines that open segments under each option, all from one pass of statistics."""
    docs = D.line_arrays(spread(table(spark, d, "documents", "doc_id", "text")), "doc_id", "text")
    each = F.array(*(F.struct(F.lit(i).alias("option"), D.starts(F.col("stats"), t, s).alias("at")) for i, t, s in OPTIONS))
    return D.unpacked(docs, ["doc_id"], each, "option").select("doc_id", "option", F.explode_outer("at").alias("seq")).filter("seq is not null")


def option_grid(spark: SparkSession, d: str) -> DataFrame:
    counts = _option_starts(spark, d).groupBy("doc_id", "option").agg(F.count(F.lit(1)).alias("n"))
    return D.best_option(counts, "doc_id")


def option_matches(spark: SparkSession, d: str) -> DataFrame:
    """The option under which most segments get a picture of the page they start on; the first one where none does.

    Every segment takes one picture, and all on a page fit, so a page matches as many as the smaller of both numbers. Pictures are those that
    nmr_data found in images of the document's file, on every third page as documents here are short.
    """
    pics = table(spark, d, "nmr_data", "f_name", "provenance").filter("provenance.modality = 'image' and provenance.page_number is not null").groupBy("f_name", (F.col("provenance.page_number") % 3).cast("bigint").alias("page")).agg(F.count(F.lit(1)).alias("pics"))
    names = table(spark, d, "documents", "doc_id", "f_name", "text").filter("text is not null").select("doc_id", "f_name")
    segs = _option_starts(spark, d).groupBy("doc_id", "option", F.floor(F.col("seq") / S.LINES_PER_PAGE).alias("page")).agg(F.count(F.lit(1)).alias("segs"))
    matched = segs.join(names, "doc_id").join(pics, ["f_name", "page"]).groupBy("doc_id", "option").agg(F.sum(F.least("segs", "pics")).alias("n"))
    every = names.select("doc_id").join(D.best_option(matched, "doc_id"), "doc_id", "left")
    return every.select("doc_id", F.coalesce("option", F.lit(0)).alias("option"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def keyword_lines(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_lines(_lines(spark, d), TEST_FAMILIES).select("doc_id", "seq", "word")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents", "doc_id", "text")).select("doc_id", F.split("text", "\n").alias("lines")).filter("lines is not null")
    return docs.select("doc_id", F.explode_outer(D.look_around(F.col("lines"))).alias("w")).filter("w is not null")


def look_around(spark: SparkSession, d: str) -> DataFrame:
    seq = F.posexplode_outer("w.texts").alias("i", "text")
    return _windows(spark, d).select("doc_id", "w.hit", "w.first", seq).select("doc_id", F.col("hit").cast("bigint").alias("hit"), (F.col("first") + F.col("i")).cast("bigint").alias("seq"))


def window_texts(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("w")
    return _windows(spark, d).select("doc_id", w["hit"].cast("bigint").alias("hit"), F.length(F.array_join(w["texts"], "")).cast("bigint").alias("length"), D.end_line(w, "NMR").cast("bigint").alias("nmr_seq"))


def compound_tags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _lines(spark, d).select("doc_id", "seq", X.compound_tag(t).alias("tag"), X.safe_name(X.compound_name(t)).alias("name")).filter("tag is not null")


def doc_metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").filter("text is not null")
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Title: On sample "), F.col("doc_id"), F.lit("\nAuthor: N. "), F.col("doc_id") % 7, F.lit("\nYear: 20"), F.lpad((F.col("doc_id") % 30).cast("string"), 2, "0"), F.lit("\n"))).otherwise("")
    return S.metadata(docs.select("doc_id", F.concat(head, "text").alias("text")), "doc_id", "text")


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("test_text")
    return table(spark, d, "gt_tests", "gt_id", "test_text").filter("test_text is not null").select("gt_id", X.clean_text(t).alias("clean"), X.delete_marks(t).alias("unmarked"), X.without_brackets(t).alias("bare"))


def cut_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("test_text")
    return table(spark, d, "gt_tests", "gt_id", "test_text").filter("test_text is not null").select(
        "gt_id",
        X.cut_at_second(t, "NMR").alias("first_only"),
        X.cut_at_enders(t).alias("before_ender"),
        X.cut_after_bracket(t).alias("to_bracket"),
        X.trim_left_junk(t).alias("trimmed"),
        X.repair_labels(t).alias("relabelled"),
        X.test_type(F.lit("NMR"), t).alias("kind"),
    )


def normal_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("test_type")
    return table(spark, d, "gt_tests", "test_type").groupBy(X.normal_type(k).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(X.same_type(F.lit("13C NMR"), k)).alias("any_nmr"))


def peak_strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gt_tests", "gt_id", "test_text").filter("test_text is not null").select("gt_id", F.posexplode_outer(X.peak_strings(F.col("test_text"))).alias("pos", "peak")).filter("pos is not null").select("gt_id", F.col("pos").cast("bigint").alias("pos"), "peak")


def _tests(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return table(spark, d, "gt_tests", "gt_id", "test_type", "test_text").filter(F.col("test_type") == kind)


def nmr_h_peaks(spark: SparkSession, d: str) -> DataFrame:
    rows = _tests(spark, d, "1H NMR").select("gt_id", P.frequency(F.col("test_text")).alias("mhz"), F.posexplode_outer(P.proton_peaks(F.col("test_text"))).alias("pos", "p")).filter("pos is not null")
    return rows.select("gt_id", "mhz", F.col("pos").cast("bigint").alias("pos"), "p.shift", "p.lo", "p.hi", "p.mult", F.array_join(F.transform("p.j", lambda x: (x * 10).cast("bigint").cast("string")), ",").alias("j10"), "p.integ", "p.label")


def nmr_c_peaks(spark: SparkSession, d: str) -> DataFrame:
    rows = _tests(spark, d, "13C NMR").select("gt_id", F.posexplode_outer(P.carbon_shifts(F.col("test_text"))).alias("pos", "shift")).filter("pos is not null")
    return rows.select("gt_id", F.col("pos").cast("bigint").alias("pos"), "shift")


def ir_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = _tests(spark, d, "IR").select("gt_id", F.posexplode_outer(P.ir_bands(F.col("test_text"))).alias("pos", "p")).filter("pos is not null")
    return rows.select("gt_id", F.col("pos").cast("bigint").alias("pos"), "p.wn", "p.intensity", "p.broad", "p.raw")


def ms_peaks(spark: SparkSession, d: str) -> DataFrame:
    rows = _tests(spark, d, "MS").select("gt_id", F.posexplode_outer(P.ms_peaks(F.col("test_text"))).alias("pos", "p")).filter("pos is not null")
    return rows.select("gt_id", F.col("pos").cast("bigint").alias("pos"), "p.mz", "p.intensity")


def parse_dispatch(spark: SparkSession, d: str) -> DataFrame:
    p = P.positions(F.col("test_text"), F.col("test_type"))
    return table(spark, d, "gt_tests", "gt_id", "test_type", "test_text").select("gt_id", "test_type", p.alias("p")).filter(F.col("test_type").isin(*TEST_TYPES)).select("gt_id", "test_type", F.size("p").cast("bigint").alias("n"), F.array_min("p").alias("lowest"), F.array_max("p").alias("highest"))


def splitting_sticks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of simulated 1H spectra: a peak's integration is shared by its lines, heights are relative to the spectrum's highest."""
    from pyspark.sql import Window

    rows = _tests(spark, d, "1H NMR").select("gt_id", P.frequency(F.col("test_text")).alias("mhz"), F.posexplode_outer(P.proton_peaks(F.col("test_text"))).alias("pos", "p")).filter("pos is not null")
    lines = P.splitting(F.col("p.shift"), F.col("p.mult"), F.col("p.j"), F.col("mhz"))
    sticks = rows.select("gt_id", "pos", F.coalesce("p.integ", F.lit(1.0)).alias("i"), lines.alias("l")).select("gt_id", "pos", (F.col("i") / F.size("l")).alias("h"), F.posexplode_outer("l").alias("line", "ppm")).filter("line is not null")
    return sticks.select("gt_id", F.col("pos").cast("bigint").alias("pos"), F.col("line").cast("bigint").alias("line"), "ppm", (F.col("h") / F.max("h").over(Window.partitionBy("gt_id"))).alias("height"))


def text_search(spark: SparkSession, d: str) -> DataFrame:
    from spectrail.operators.tables import page_of, search

    hits = search(table(spark, d, "documents", "doc_id", "text", "lang"), ["text"], r"residual solvent|phase organique")
    return page_of(hits.select("doc_id", "lang"), ["doc_id"], 2, 20)


def page_count(spark: SparkSession, d: str) -> DataFrame:
    from spectrail.operators.tables import page_count as count
    from spectrail.operators.tables import search

    return count(search(table(spark, d, "documents", "text"), ["text"], "solvent"), 25)


_NAMES = [doc_lines, line_stats, segment_starts, first_over, segments, segment_names, segment_pages, long_segments, option_grid, option_matches, keyword_lines, look_around, window_texts, compound_tags, doc_metadata, clean_texts, cut_texts, normal_types, peak_strings, nmr_h_peaks, nmr_c_peaks, ir_bands, ms_peaks, parse_dispatch, splitting_sticks, text_search, page_count]


def queries() -> dict:
    return {f.__name__: f for f in _NAMES}


# --- SQL ----------------------------------------------------------------------------------------------------------------------------

# Fixed values, written out once more so that the SQL doesn't take them from what it checks: name fragments, locants, section words, tag.
_FRAGMENTS = (
    "carboxylate", "phosphate", "isopropyl", "azetidin", "methoxy", "benzene", "methane", "propane", "uronium", "ethane", "phenyl",
    "chloro", "fluoro", "methyl", "propan", "benzyl", "hydryl", "thione", "sodium", "butan", "butyl", "hydro", "carbo", "tetra", "allyl",
    "sulfo", "azete", "amido", "pival", "olate", "thio", "tert", "benz", "nate", "piva", "late", "loyl", "azin", "hexa", "ace", "tri",
    "oxy", "oxo", "one", "hyl", "ane", "ate", "tol", "tyl", "bis", "nyl", "ol", "di", "en", "yl",
)
_TOKENS = "|".join([*_FRAGMENTS, *(x[0].upper() + x[1:] for x in _FRAGMENTS)]) + r"|-\d+,\d+,\d+-|-\d+,\d+-|-\d+-|\d+-|-\d+|\(\d*S\)|\(\d*R\)|\(\d*E\)|\(\d*Z\)"
_NOISE = ("Experimental", "experimental", "10.09.08.07.06.05.04.03.02.01.00.0-1.0")
_TAG = r"\(\d+[A-Za-z]?\)"

LINES = "lines AS (SELECT doc_id, i AS seq, i // 50 AS page, i % 50 AS line, t AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS i FROM documents WHERE text IS NOT NULL))"
_T = "text"
for _n in _NOISE:
    _T = f"replace({_T}, {q(_n)}, '')"
STATS = f"""{LINES}, edited AS (SELECT doc_id, seq, text, {_T} AS t FROM lines),
stats AS (SELECT doc_id, seq, 200.0::DOUBLE * len(regexp_extract_all(t, {q(_TOKENS)})) / length(t) AS likelihood, CAST(length(t) - length(replace(t, ' ', '')) AS BIGINT) AS spaces
FROM edited WHERE length(replace(t, ' ', '')) > 10 AND NOT starts_with(text, 'Rf') AND NOT starts_with(text, 'mp'))"""
STARTS = f"""{STATS}, marks AS (SELECT doc_id, quantile_cont(likelihood, 0.8) AS mt, quantile_cont(spaces, 0.35) AS ms FROM stats GROUP BY doc_id),
starts AS (SELECT s.doc_id, s.seq FROM stats s JOIN marks m USING (doc_id) WHERE s.likelihood > m.mt AND s.spaces < m.ms)"""
INSIDE = f"""{STARTS}, inside AS (SELECT * FROM (SELECT l.*, CAST(sum(CASE WHEN s.seq IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY l.doc_id ORDER BY l.seq) AS BIGINT) AS segment
FROM lines l LEFT JOIN starts s ON s.doc_id = l.doc_id AND s.seq = l.seq) WHERE segment > 0)"""
SEGMENTS = f"""{INSIDE}, segs AS (SELECT doc_id, segment, min(seq) AS first_seq, max(seq) AS last_seq, min(page) AS start_page, max(page) AS end_page, count(*) AS n_lines FROM inside GROUP BY doc_id, segment)"""
HITS = f"{LINES}, hits AS (SELECT doc_id, seq, word FROM lines JOIN (SELECT unnest(['NMR', 'IR', 'Rf', 'HRMS']) AS word) f ON contains(text, word))"
AROUND = f"{HITS}, around AS (SELECT l.doc_id, h.seq AS hit, l.seq, l.text FROM lines l JOIN (SELECT DISTINCT doc_id, seq FROM hits) h ON h.doc_id = l.doc_id AND l.seq >= h.seq - 1 AND l.seq < h.seq + 20)"


def _name(t: str) -> str:
    return f"nullif(trim(regexp_extract({t}, {q('(?s)^(.*?)' + _TAG)}, 1)), '')"


def _safe(t: str) -> str:
    illegal = r'[<>:"/\\|?*\x00-\x1f]'
    return f"regexp_replace(regexp_replace({t}, {q(illegal)}, ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"


_ONE = "trim(replace(replace(coalesce(test_text, ''), '\\n', ' '), chr(10), ' '))"
_HEAD = "regexp_extract(s, '(?i)NMR[^:]*:\\s*')"
_AFTER = f"(CASE WHEN contains(s, 'δ') THEN substr(s, instr(s, 'δ') + 1) WHEN {_HEAD} <> '' THEN substr(s, instr(s, {_HEAD}) + length({_HEAD})) ELSE s END)"


def _texts(kind: str) -> str:
    return f"src AS (SELECT gt_id, test_text, {_ONE} AS s FROM gt_tests WHERE test_type = {q(kind)}), t AS (SELECT gt_id, test_text, s, {_AFTER} AS a FROM src)"


# Fixed values, once more for the SQL: patterns of peaks, multiplicities and couplings.
_HP = r"(\d{1,2}(?:\.\d+)?(?:\s*[–-]\s*\d{1,2}(?:\.\d+)?)?)\s*(?:\(([^)]*)\))?"
_MULT = r"\b(dd|dt|td|dq|qt|tt|s|d|t|q|quin|quint|sext|sept|hept|m)\b"
_JP = r"J[^=\d]*=\s*([\d.]+(?:\s*,\s*[\d.]+)*)"
H_PEAKS = f"""{_texts('1H NMR')},
z AS (SELECT gt_id, test_text, unnest(list_zip(regexp_extract_all(a, {q(_HP)}, 1), regexp_extract_all(a, {q(_HP)}, 2))) AS p, generate_subscripts(regexp_extract_all(a, {q(_HP)}, 1), 1) AS i FROM t),
y AS (SELECT gt_id, test_text, i, coalesce(p[2], '') AS info, lower(coalesce(p[2], '')) AS low, list_transform(regexp_split_to_array(p[1], '\\s*[–-]\\s*'), lambda x: CAST(x AS DOUBLE)) AS e FROM z),
x AS (SELECT *, CASE WHEN len(e) = 2 THEN list_min(e) END AS lo, CASE WHEN len(e) = 2 THEN list_max(e) END AS hi, CASE WHEN len(e) = 2 THEN (e[1] + e[2]) / 2 ELSE e[1] END AS shift, regexp_extract(low, {q(_MULT)}, 1) AS m FROM y),
hp AS (SELECT gt_id, coalesce(CAST(nullif(regexp_extract(test_text, '(?i)(\\d{{2,4}})\\s*MHz', 1), '') AS DOUBLE), 400.0::DOUBLE) AS mhz, CAST(row_number() OVER (PARTITION BY gt_id ORDER BY i) - 1 AS BIGINT) AS pos, shift, lo, hi,
CASE WHEN m = '' THEN NULL WHEN regexp_matches(low, '\\bbr\\b') THEN 'br ' || m ELSE m END AS mult,
list_transform(regexp_extract_all(regexp_extract(info, {q(_JP)}, 1), '([\\d.]*\\d)', 1), lambda v: TRY_CAST(v AS DOUBLE)) AS j,
CAST(nullif(regexp_extract(info, '(\\d+(?:\\.\\d+)?)\\s*H\\b', 1), '') AS DOUBLE) AS integ, trim(info) AS label
FROM x WHERE CASE WHEN lo IS NULL THEN shift BETWEEN 0 AND 16 ELSE lo BETWEEN 0 AND 16 AND hi BETWEEN 0 AND 16 END)"""


def _near(word: str) -> str:
    return f"regexp_matches(raw, '(^|[^a-z]){word}([^a-z]|$)')"


_LEVEL = f"CASE WHEN {_near('vs')} THEN 1.0::DOUBLE WHEN {_near('vw')} THEN 0.2::DOUBLE WHEN {_near('s')} THEN 0.8::DOUBLE WHEN {_near('m')} THEN 0.55::DOUBLE WHEN {_near('w')} THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END"
_IRP = r"(\d{3,4}(?:\.\d+)?)(?:\s*[–-]\s*(\d{3,4}(?:\.\d+)?))?"
_MERGE = "list_reduce(list_prepend([]::DOUBLE[], list_transform(v, lambda x: [x])), lambda acc, x: CASE WHEN len(acc) = 0 OR abs(x[1] - acc[len(acc)]) > 0.05 THEN list_concat(acc, x) ELSE acc END)"
C_PEAKS = f"""{_texts('13C NMR')}, v AS (SELECT gt_id, list_sort(list_filter(list_transform(regexp_extract_all(a, '(\\d{{1,3}}(?:\\.\\d+)?)', 1), lambda x: CAST(x AS DOUBLE)), lambda x: x BETWEEN 0 AND 250)) AS v FROM t),
cp AS (SELECT gt_id, {_MERGE} AS c FROM v)"""
IR = f"""{_texts('IR')}, pieces AS (SELECT gt_id, unnest(list_filter(list_transform(regexp_split_to_array(lower(s), '[;,]'), lambda x: trim(x)), lambda x: x <> '')) AS raw, generate_subscripts(list_filter(list_transform(regexp_split_to_array(lower(s), '[;,]'), lambda x: trim(x)), lambda x: x <> ''), 1) AS i FROM t),
b AS (SELECT gt_id, i, raw, unnest(list_zip(regexp_extract_all(raw, {q(_IRP)}, 1), regexp_extract_all(raw, {q(_IRP)}, 2))) AS p, generate_subscripts(regexp_extract_all(raw, {q(_IRP)}, 1), 1) AS k FROM pieces),
c AS (SELECT *, CAST(p[1] AS DOUBLE) AS x, CAST(nullif(p[2], '') AS DOUBLE) AS y FROM b),
bands AS (SELECT gt_id, CAST(row_number() OVER (PARTITION BY gt_id ORDER BY i, k) - 1 AS BIGINT) AS pos, CASE WHEN y BETWEEN 400 AND 4000 THEN (x + y) / 2 ELSE x END AS wn, {_LEVEL} AS intensity,
coalesce(y BETWEEN 400 AND 4000, false) OR regexp_matches(raw, '(^|[^\\pL\\pN_])br([^\\pL\\pN_]|$)|broad') AS broad, raw FROM c WHERE x BETWEEN 400 AND 4000)"""
_PAIRS = r"(\d{2,5}(?:\.\d+)?)\s*\(\s*(\d{1,3})\s*\)"
MS = f"""{_texts('MS')}, m AS (SELECT gt_id, list_filter(list_transform(list_zip(regexp_extract_all(s, {q(_PAIRS)}, 1), regexp_extract_all(s, {q(_PAIRS)}, 2)), lambda p: [CAST(p[1] AS DOUBLE), CAST(p[2] AS DOUBLE)]), lambda p: p[1] BETWEEN 10 AND 5000) AS pairs,
list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(s, '(\\d{{2,5}}(?:\\.\\d+)?)', 1), lambda x: CAST(x AS DOUBLE)), lambda x: x BETWEEN 10 AND 5000))) AS single FROM t),
n AS (SELECT gt_id, CASE WHEN len(pairs) > 0 THEN pairs ELSE list_transform(single, lambda x: [x, 100.0::DOUBLE]) END AS ps FROM m),
mp AS (SELECT gt_id, list_transform(ps, lambda p: [p[1], CASE WHEN list_max(list_transform(ps, lambda r: r[2])) > 0 THEN p[2] * 100.0::DOUBLE / list_max(list_transform(ps, lambda r: r[2])) ELSE p[2] END]) AS ps FROM n)"""

_CH = r"\s*(?:CHAPTER|Chapter)\s*\d\s*:?\s*(?:EXPERIMENTAL|Experimental)?\s*\d+|\s*Experimental\s*\d+|Experimental-\d+-|\(R\)|\(S\)|\(cis\)|\(trans\)"
_BARE = "regexp_replace(regexp_replace({t}, '\\([^()]*\\)', '', 'g'), '\\[[^\\[\\]]*\\]', '', 'g')"
_PLAIN = f"""a AS (SELECT gt_id, regexp_replace(regexp_replace(trim(replace(replace(replace(replace(replace({_BARE.format(t='test_text')}, chr(10), ' '), 'cm-1', ''), '–', '-'), ', ', ','), ',', ', ')), '\\.+$', ''), '13C$', '') AS s FROM gt_tests WHERE test_text IS NOT NULL),
b AS (SELECT gt_id, trim(CASE WHEN instr(s, 'NMR') > 0 AND instr(s, 'NMR') + 2 <= length(s) - 10 THEN substr(s, instr(s, 'NMR') + 3) ELSE s END) AS s FROM a),
c AS (SELECT gt_id, flatten(list_transform(string_split(s, ','), lambda p: string_split(p, '-'))) AS parts FROM b)"""


def _enders(names: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN instr(test_text, {q(e)}) > 0 THEN rtrim(substr(test_text, 1, instr(test_text, {q(e)}) - 1))" for e in names) + " ELSE test_text END"


_FIRST = "string_split(test_text, ' ')[1]"
_JUNK = f"greatest(instr({_FIRST}, '.'), instr({_FIRST}, ';'), instr({_FIRST}, ')'))"
_REL = "test_text"
for _p, _l in (
    (r"\[1H\]\s*NMR|\d+%*\)\.*1H NMR|\);1H NMR|\d+\.1H NMR|°\)1H NMR|lH NMR|21H NMR|\(13\):1H NMR", "1H NMR"), ("^.*1H NMR", "1H NMR"), (r"19F\(H\) NMR", "19F NMR"), ("^.*19F NMR", "19F NMR"),
    (r"H-\d+\);*13C NMR|\d+H\)[;.]*13C NMR|H\d+\)\.*13C NMR|13C\}1H\} NMR|141 NMR", "13C NMR"), ("^.*13C NMR", "13C NMR"),
    (r"O10298OOOTBS3142Appendix A:| 43NH 51016OO1112678Me92Me\d+| 1211OO1610NH 53417Me182Me\d+|N OCO2allylCO2MeN|NMeO2CONMeO2CO2N\d+|OCO2allylCO2MeO\d+|Ph2SiHOPh2SiOPh2SiOH\d+|61    ", "/)"),
):
    _REL = f"regexp_replace({_REL}, {q(_p)}, '{_l}', 'g')"
for _m in "STDQ":
    _REL = f"regexp_replace({_REL}, '{_m}(\\s*,\\s*J\\s*=)', '{_m.lower()}\\1', 'g')"

_HEADER = "CASE WHEN doc_id % 3 = 0 THEN 'Title: On sample ' || doc_id || chr(10) || 'Author: N. ' || (doc_id % 7) || chr(10) || 'Year: 20' || lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') || chr(10) ELSE '' END"


def _label(key: str, names: str) -> str:
    value = "(\\d{4})" if key == "year" else "([^\\n]*)"
    return f"nullif(trim(regexp_extract(t, '(?i)(?:{names}):\\s*{value}', 1)), '')"


#: Peak positions of all types, rows (gt_id, p) of ps.
POSITIONS = f"""{H_PEAKS.replace('src AS', 'src1 AS').replace('FROM src)', 'FROM src1)').replace(' t AS', ' t1 AS').replace('FROM t)', 'FROM t1)')},
            {C_PEAKS.replace('src AS', 'src2 AS').replace('FROM src)', 'FROM src2)').replace(' t AS', ' t2 AS').replace('FROM t)', 'FROM t2)')},
            {IR.replace('src AS', 'src3 AS').replace('FROM src)', 'FROM src3)').replace(' t AS', ' t3 AS').replace('FROM t)', 'FROM t3)')},
            {MS.replace('src AS', 'src4 AS').replace('FROM src)', 'FROM src4)').replace(' t AS', ' t4 AS').replace('FROM t)', 'FROM t4)')},
            ps AS (SELECT gt_id, shift AS p FROM hp UNION ALL SELECT gt_id, unnest(c) FROM cp UNION ALL SELECT gt_id, wn FROM bands UNION ALL SELECT gt_id, unnest(list_transform(ps, lambda r: r[1])) FROM mp)"""


def oracle_sql() -> dict[str, str]:
    grid = ", ".join(f"({i}, {t / 100}, {s / 100})" for i, t, s in OPTIONS)
    return {
        "doc_lines": f"WITH {LINES} SELECT * FROM lines",
        "line_stats": f"WITH {STATS} SELECT * FROM stats",
        "segment_starts": f"WITH {STARTS} SELECT * FROM starts",
        "first_over": f"WITH {STATS}, m AS (SELECT doc_id, quantile_cont(likelihood, 0.5) AS mt FROM stats GROUP BY doc_id) SELECT s.doc_id, min(s.seq) AS seq FROM stats s JOIN m USING (doc_id) WHERE s.likelihood > m.mt GROUP BY s.doc_id",
        "segments": f"WITH {SEGMENTS} SELECT * FROM segs",
        "segment_names": f"""WITH {INSIDE}, l AS (SELECT doc_id, segment, list(text ORDER BY seq)[1:3] AS l FROM inside GROUP BY doc_id, segment)
            SELECT doc_id, segment, {_safe(f"coalesce({_name('l[1]')}, {_name('array_to_string(l[1:2], chr(0))').replace('chr(0)', chr(39) * 2)}, {_name('array_to_string(l, chr(0))').replace('chr(0)', chr(39) * 2)}, l[1])")} AS name FROM l""",
        "segment_pages": f"WITH {SEGMENTS} SELECT doc_id, segment, unnest(range(start_page, end_page + 1)) AS page FROM segs",
        "long_segments": f"""WITH {SEGMENTS}, wide AS (SELECT * FROM segs WHERE last_seq // 4 - first_seq // 4 > 1),
            own AS (SELECT w.doc_id, w.segment, s.seq, s.likelihood, s.spaces FROM wide w JOIN stats s ON s.doc_id = w.doc_id AND s.seq BETWEEN w.first_seq AND w.last_seq),
            m2 AS (SELECT doc_id, segment, quantile_cont(likelihood, 0.5) AS mt2, quantile_cont(spaces, 0.25) AS ms2 FROM own GROUP BY doc_id, segment),
            again AS (SELECT o.doc_id, o.segment, max(o.seq) AS seq FROM own o JOIN m2 USING (doc_id, segment) WHERE o.likelihood > mt2 AND o.spaces < ms2 GROUP BY o.doc_id, o.segment)
            SELECT g.doc_id, g.segment, coalesce(a.seq, g.first_seq) AS first_seq, g.last_seq - coalesce(a.seq, g.first_seq) + 1 AS n_lines FROM segs g LEFT JOIN again a ON a.doc_id = g.doc_id AND a.segment = g.segment""",
        "option_matches": f"""WITH {STATS}, o(option, t, s) AS (VALUES {grid}),
            m AS (SELECT doc_id, option, QT AS mt, QS AS ms FROM (SELECT * FROM stats CROSS JOIN o) GROUP BY doc_id, option, t, s),
            n AS (SELECT s.doc_id, m.option, s.seq // 50 AS page, count(*) AS segs FROM stats s JOIN m USING (doc_id) WHERE s.likelihood > m.mt AND s.spaces < m.ms GROUP BY 1, 2, 3),
            p AS (SELECT f_name, provenance.page_number % 3 AS page, count(*) AS pics FROM nmr_data WHERE provenance.modality = 'image' AND provenance.page_number IS NOT NULL GROUP BY 1, 2),
            k AS (SELECT n.doc_id, n.option, sum(least(segs, pics)) AS n FROM n JOIN documents d ON d.doc_id = n.doc_id JOIN p ON p.f_name = d.f_name AND p.page = n.page GROUP BY 1, 2),
            b AS (SELECT doc_id, option, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, option) AS r FROM k) WHERE r = 1)
            SELECT d.doc_id, coalesce(b.option, 0) AS option, CAST(coalesce(b.n, 0) AS BIGINT) AS n FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id WHERE d.text IS NOT NULL""".replace("QT", _quantiles("likelihood", 1)).replace("QS", _quantiles("spaces", 2)),
        "option_grid": f"""WITH {STATS}, o(option, t, s) AS (VALUES {grid}),
            m AS (SELECT doc_id, option, quantile_cont(likelihood, t) AS mt, quantile_cont(spaces, s) AS ms FROM (SELECT * FROM stats CROSS JOIN o) GROUP BY doc_id, option, t, s),
            n AS (SELECT s.doc_id, m.option, count(*) AS n FROM stats s JOIN m USING (doc_id) WHERE s.likelihood > m.mt AND s.spaces < m.ms GROUP BY s.doc_id, m.option)
            SELECT doc_id, option, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, option) AS r FROM n) WHERE r = 1""".replace("quantile_cont(likelihood, t)", _quantiles("likelihood", 1)).replace("quantile_cont(spaces, s)", _quantiles("spaces", 2)),
        "keyword_lines": f"WITH {HITS} SELECT * FROM hits",
        "look_around": f"WITH {AROUND} SELECT doc_id, hit, seq FROM around",
        "window_texts": f"""WITH {AROUND}, e AS (SELECT *, string_agg(text, '') OVER (PARTITION BY doc_id, hit ORDER BY seq) AS so_far FROM around)
            SELECT doc_id, hit, CAST(max(length(so_far)) AS BIGINT) AS length, min(CASE WHEN contains(so_far, 'NMR') THEN seq END) AS nmr_seq FROM e GROUP BY doc_id, hit""",
        "compound_tags": f"WITH {LINES} SELECT doc_id, seq, regexp_extract(text, {q(_TAG)}) AS tag, {_safe(_name('text'))} AS name FROM lines WHERE regexp_matches(text, {q(_TAG)})",
        "doc_metadata": f"""WITH d AS (SELECT doc_id, {_HEADER} || text AS t FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls FROM d)
            SELECT doc_id, coalesce({_label('title', 'Title|Thesis Title')}, trim(ls[1])) AS title,
            coalesce({_label('author', 'Author|Candidate')}, trim(list_last(string_split(trim(list_filter(ls, lambda x: contains(lower(x), 'by'))[1]), 'by')))) AS author,
            coalesce({_label('university', 'University|Institution')}, trim(list_filter(ls, lambda x: contains(lower(x), 'university'))[1])) AS university,
            coalesce({_label('year', 'Year|Date')}, nullif(regexp_extract(t, '(?:^|\\W)(\\d{{4}})(?:\\W|$)', 1), '')) AS year,
            coalesce({_label('subject', 'Subject|Discipline')}, trim(list_filter(ls, lambda x: contains(lower(x), 'subject'))[1])) AS subject FROM l""".replace("list_last(", "list_extract(").replace("'by')))) AS author", "'by'), -1))) AS author"),
        "clean_texts": f"""SELECT gt_id, regexp_replace(rtrim(replace(replace(replace(test_text, chr(10), ' '), chr(61623), ' '), ';', ' ')), '13C \\(([^)]*MHz[^)]*)\\)', '13C NMR (\\1)', 'g') AS clean,
            regexp_replace(test_text, {q(_CH)}, '', 'g') AS unmarked, {_BARE.format(t='test_text')} AS bare FROM gt_tests WHERE test_text IS NOT NULL""",
        "cut_texts": f"""SELECT gt_id, CASE WHEN instr(substr(test_text, 16), 'NMR') > 0 THEN substr(test_text, 1, 14 + instr(substr(test_text, 16), 'NMR')) ELSE test_text END AS first_only,
            {_enders(('NMR', 'IR', 'Rf', 'HRMS', 'HPLC', 'ESI-MS'))} AS before_ender,
            CASE WHEN contains(regexp_extract(test_text, '(?s)^(.*\\))', 1), ':') THEN regexp_extract(test_text, '(?s)^(.*\\))', 1) ELSE test_text END AS to_bracket,
            CASE WHEN {_JUNK} > 0 THEN substr(test_text, {_JUNK} + 1) ELSE test_text END AS trimmed, {_REL} AS relabelled, substr(test_text, 1, instr(test_text, 'R')) AS kind FROM gt_tests WHERE test_text IS NOT NULL""",
        "normal_types": """SELECT CASE WHEN contains(test_type, '13C') AND contains(test_type, 'NMR') THEN '13C NMR' ELSE test_type END AS kind, count(*) AS n,
            count(CASE WHEN contains(test_type, 'NMR') THEN 1 END) AS any_nmr FROM gt_tests GROUP BY 1""",
        "peak_strings": f"""WITH {_PLAIN} SELECT gt_id, CAST(i - 1 AS BIGINT) AS pos, CASE WHEN p = '' THEN '0' WHEN regexp_extract(p, '\\d+(?:\\.\\d+)?') = '' THEN '-999.0' ELSE regexp_extract(p, '\\d+(?:\\.\\d+)?') END AS peak
            FROM (SELECT gt_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM c)""",
        "nmr_h_peaks": f"WITH {H_PEAKS} SELECT gt_id, mhz, pos, shift, lo, hi, mult, array_to_string(list_transform(j, lambda v: CAST(CAST(trunc(v * 10) AS BIGINT) AS VARCHAR)), ',') AS j10, integ, label FROM hp",
        "nmr_c_peaks": f"WITH {C_PEAKS} SELECT gt_id, CAST(i - 1 AS BIGINT) AS pos, shift FROM (SELECT gt_id, unnest(c) AS shift, generate_subscripts(c, 1) AS i FROM cp)",
        "ir_bands": f"WITH {IR} SELECT gt_id, pos, wn, intensity, broad, raw FROM bands",
        "ms_peaks": f"WITH {MS} SELECT gt_id, CAST(i - 1 AS BIGINT) AS pos, p[1] AS mz, p[2] AS intensity FROM (SELECT gt_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM mp)",
        "parse_dispatch": f"""WITH {POSITIONS}
            SELECT g.gt_id, g.test_type, count(p) AS n, min(p) AS lowest, max(p) AS highest FROM gt_tests g LEFT JOIN ps USING (gt_id) WHERE g.test_type IN ('1H NMR', '13C NMR', 'IR', 'MS') GROUP BY g.gt_id, g.test_type""",
        "splitting_sticks": f"""WITH {H_PEAKS}, f AS (SELECT gt_id, pos, shift AS c, lower(trim(mult)) AS m, coalesce(integ, 1.0::DOUBLE) AS i, coalesce(j[1], 7.0::DOUBLE) / greatest(mhz, 60.0::DOUBLE) AS j1, j[2] / greatest(mhz, 60.0::DOUBLE) AS j2 FROM hp),
            g AS (SELECT *, j1 / 2 AS d1, coalesce(j2 / 2, j1 / 2 * 0.7::DOUBLE) AS d2 FROM f),
            l AS (SELECT gt_id, pos, i, CASE WHEN m IS NULL OR starts_with(m, 's') OR starts_with(m, 'm') THEN [c] WHEN starts_with(m, 'dd') THEN list_sort(list_distinct([c - d1 - d2, c - d1 + d2, c + d1 - d2, c + d1 + d2]))
            WHEN starts_with(m, 'd') THEN [c - j1 / 2, c + j1 / 2] WHEN starts_with(m, 't') THEN [c - j1, c, c + j1] WHEN starts_with(m, 'q') THEN [c - j1 * 1.5::DOUBLE, c - j1 * 0.5::DOUBLE, c + j1 * 0.5::DOUBLE, c + j1 * 1.5::DOUBLE] ELSE [c] END AS l FROM g),
            s AS (SELECT gt_id, pos, i / len(l) AS h, unnest(l) AS ppm, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line FROM l)
            SELECT gt_id, pos, line, ppm, h / max(h) OVER (PARTITION BY gt_id) AS height FROM s""",
        "text_search": "SELECT doc_id, lang FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i)residual solvent|phase organique') ORDER BY doc_id LIMIT 20 OFFSET 20",
        "page_count": "SELECT rows, CASE WHEN rows = 0 THEN 0 ELSE (rows - 1) // 25 + 1 END AS pages FROM (SELECT count(*) AS rows FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i)solvent'))",
    }


def _quantiles(column: str, which: int) -> str:
    """quantile_cont takes constants only: one for each option."""
    return "CASE option " + " ".join(f"WHEN {o[0]} THEN quantile_cont({column}, {o[which] / 100})" for o in OPTIONS) + " END"
