"""Queries of the general data problems: nested records (2) and packed fields (4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.operators import nested, packed
from spectrail.session import spread, table

P2_CHILDREN = ("provenance", "bbox", "span", "peak", "component")
#: A provenance is written with its index even if a table has single ones only.
P2_LISTS = ("provenance",)
#: The columns of the child tables, null where no record of a table has them; numbers are marked.
P2_COLUMNS = {
    "molecule": "id smiles inchi label", "reaction": "id", "component": "molecule_id role",
    "spectrum": "id type molecule_id nucleus solvent frequency text_representation raw_text",
    "peak": "multiplicity shift# integration#", "provenance": "source role page_number# confidence#",
    "bbox": "x0# y0# x1# y1#", "span": "text start# end#",
    "method": "algorithm version confidence#", "coupling_constant": "value#", "error": "value",
}

#: fld, table, id column, kind of packing.
P4_FIELDS = (("image_path", "wide_records", "wide_id", "paths"), ("text_representation", "spectra", "spectrum_id", "peaks"), ("coupling_constants", "nmr_peaks", "peak_id", "numbers"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spread(table(spark, sf_dir, "extraction_records", "rec_id", "payload"))
    flat = nested.flatten(records, "rec_id", "payload", raw=False, lists=P2_LISTS)
    return flat.filter(F.col("child").isin(*P2_CHILDREN)).select("rec_id", "parent", "child", "pos")


def p2_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.merged_schema(table(spark, sf_dir, "extraction_records", "payload"), "payload")


def _p2_table(child: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        records = table(spark, sf_dir, "extraction_records", "rec_id", "payload")
        lv = nested.levels(records, "payload", P2_LISTS)
        names = [(n.rstrip("#"), "double" if n.endswith("#") else "string") for n in P2_COLUMNS[child].split()]
        out = nested.child_tables(nested.flatten(records, "rec_id", "payload", lv), "rec_id", lv, {"peak": "shift"}, tuple(n for n, kind in names if kind == "double")).get(child)
        if out is None:
            out = spark.createDataFrame([], "rec_id bigint, parent string, path string, pos bigint")
        return out.select("rec_id", "parent", "path", "pos", *((F.col(n) if n in out.columns else F.lit(None)).cast(kind).alias(n) for n, kind in names))

    return query


def p2_nmr_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed form: nmr_data.peaks as a child table, its span flattened."""
    rows = nested.explode_level(table(spark, sf_dir, "nmr_data", "nmr_id", "peaks"), ["nmr_id"], "peaks")
    return rows.select("nmr_id", "pos", "shift", "multiplicity", "integration", F.col("span.start_idx").cast("bigint").alias("start_idx"), F.col("span.end_idx").cast("bigint").alias("end_idx"), F.col("span.span_text").alias("span_text"))


def p2_nmr_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nmr_data", "nmr_id", "provenance").filter("provenance is not null")
    return rows.select("nmr_id", F.col("provenance.page_number").cast("bigint").alias("page_number"), *(F.col(f"provenance.bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")), "provenance.modality", "provenance.confidence")


def p2_nmr_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of nmr_data.provenance as a child table of p2_nmr_provenance, keyed by nmr_id."""
    rows = table(spark, sf_dir, "nmr_data", "nmr_id", F.col("provenance.span").alias("span")).filter("span is not null")
    return rows.select("nmr_id", F.col("span.start_idx").cast("bigint").alias("start_idx"), F.col("span.end_idx").cast("bigint").alias("end_idx"), F.col("span.span_text").alias("span_text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        packed.split_packed(table(spark, sf_dir, t, key, column), key, column, kind).select(F.lit(column).alias("fld"), F.col(key).alias("row_id"), "pos", "val")
        for column, t, key, kind in P4_FIELDS
    ]
    return reduce(DataFrame.unionByName, parts)


def queries() -> dict:
    return {
        "p2_found": p2_found,
        "p2_schema": p2_schema,
        **{f"p2_{c}_table": _p2_table(c) for c in P2_COLUMNS},
        "p2_nmr_peaks": p2_nmr_peaks,
        "p2_nmr_provenance": p2_nmr_provenance,
        "p2_nmr_spans": p2_nmr_spans,
        "p4_found": p4_found,
    }


#: All objects of the records in DuckDB's terms, with the members written out. Rows (rec_id, parent, child, pos, path, j).
_OBJECTS = r"""
WITH RECURSIVE raw AS (SELECT rec_id, CAST(payload AS JSON) AS j FROM extraction_records WHERE json_valid(payload)),
once AS (SELECT rec_id, CASE WHEN json_type(j) = 'ARRAY' AND json_array_length(j) = 1 THEN j->0
    WHEN json_type(j) = 'OBJECT' AND len(json_keys(j)) = 1 AND NOT list_contains(json_keys(j), 'source_filename') THEN json_extract(j, '$."' || json_keys(j)[1] || '"') ELSE j END AS j FROM raw),
record AS (SELECT rec_id, CASE WHEN json_type(j) = 'ARRAY' AND json_array_length(j) = 1 THEN j->0
    WHEN json_type(j) = 'OBJECT' AND len(json_keys(j)) = 1 AND NOT list_contains(json_keys(j), 'source_filename') THEN json_extract(j, '$."' || json_keys(j)[1] || '"') ELSE j END AS j FROM once),
level(holder, member, child, single, members) AS (VALUES
    ('$', 'molecules', 'molecule', false, ['id', 'smiles', 'inchi', 'label', 'provenance']),
    ('$', 'reactions', 'reaction', false, ['id', 'components', 'provenance']),
    ('$', 'spectra', 'spectrum', false, ['id', 'type', 'molecule_id', 'nucleus', 'solvent', 'frequency', 'text_representation', 'raw_text', 'peaks', 'provenance']),
    ('$', 'errors', 'error', false, []),
    ('molecule', 'provenance', 'provenance', false, ['page_number', 'bbox', 'source', 'role', 'span', 'method', 'confidence']),
    ('reaction', 'provenance', 'provenance', false, ['page_number', 'bbox', 'source', 'role', 'span', 'method', 'confidence']),
    ('spectrum', 'provenance', 'provenance', false, ['page_number', 'bbox', 'source', 'role', 'span', 'method', 'confidence']),
    ('peak', 'provenance', 'provenance', false, ['page_number', 'bbox', 'source', 'role', 'span', 'method', 'confidence']),
    ('reaction', 'components', 'component', false, ['molecule_id', 'role']),
    ('spectrum', 'peaks', 'peak', false, ['shift', 'multiplicity', 'integration', 'coupling_constants', 'provenance']),
    ('peak', 'coupling_constants', 'coupling_constant', false, []),
    ('provenance', 'bbox', 'bbox', true, []), ('provenance', 'span', 'span', true, []), ('provenance', 'method', 'method', true, [])),
obj AS (
    SELECT rec_id, '' AS parent, '$' AS child, 0 AS pos, '' AS path, j FROM record WHERE json_type(j) = 'OBJECT'
    UNION ALL
    SELECT rec_id, path, name, CAST(i AS INTEGER), CASE WHEN path = '' THEN '' ELSE path || '.' END || member || CASE WHEN single THEN '' ELSE '[' || i || ']' END, item
    FROM (
        SELECT rec_id, path, name, member, single, unnest(range(len(items))) AS i, unnest(items) AS e,
               CASE WHEN json_type(e) = 'VARCHAR' AND json_valid(e->>'$') AND regexp_matches(e->>'$', '^\s*[\[{]') THEN CAST(e->>'$' AS JSON) ELSE e END AS item
        FROM (
            SELECT rec_id, path, name, member, single,
                   CASE WHEN single AND CAST(v AS VARCHAR) NOT IN ('null', '""', '[]', '{}') THEN [v]
                        WHEN NOT single AND json_type(v) = 'ARRAY' THEN CAST(v AS JSON[])
                        WHEN NOT single AND json_type(v) = 'OBJECT' AND len(list_intersect(json_keys(v), members)) > 0 THEN [v]
                        WHEN NOT single AND json_type(v) = 'OBJECT' THEN list_transform(json_keys(v), lambda k: json_extract(v, '$."' || k || '"'))
                        ELSE [] END AS items
            FROM (
                SELECT o.rec_id, o.path, l.child AS name, l.member, l.single, l.members, json_extract(o.j, '$.' || l.member) AS w,
                       CASE WHEN json_type(w) = 'VARCHAR' AND json_valid(w->>'$') AND regexp_matches(w->>'$', '^\s*[\[{]') THEN CAST(w->>'$' AS JSON) ELSE w END AS v
                FROM obj o JOIN level l ON l.holder = o.child AND json_type(o.j) = 'OBJECT')
            WHERE v IS NOT NULL))
    WHERE item IS NOT NULL AND (single OR (json_type(item) = 'OBJECT' AND len(json_keys(item)) > 0)
        OR (name IN ('peak', 'coupling_constant') AND json_type(item) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT'))
        OR (name = 'error' AND json_type(item) = 'VARCHAR' AND regexp_matches(item->>'$', '\S')))
)
"""


def _p2_sql(child: str) -> str:
    """The child table of _OBJECTS with the columns of P2_COLUMNS."""
    columns = []
    for n in P2_COLUMNS[child].split():
        value = f"j->>'$.{n.rstrip('#')}'"
        if n.rstrip("#") == "value":
            value = "j->>'$'"
        elif (child, n) == ("peak", "shift#"):
            value = f"CASE WHEN json_type(j) = 'OBJECT' THEN {value} ELSE CAST(j AS VARCHAR) END"
        columns.append((f"TRY_CAST({value} AS DOUBLE)" if n.endswith("#") else value) + f" AS \"{n.rstrip('#')}\"")
    return f"{_OBJECTS} SELECT rec_id, parent, path, CAST(pos AS BIGINT) AS pos, {', '.join(columns)} FROM obj WHERE child = '{child}'"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"{_OBJECTS} SELECT rec_id, parent, child, CAST(pos AS BIGINT) AS pos FROM obj WHERE child IN ('provenance', 'bbox', 'span', 'peak', 'component')",
        **{f"p2_{c}_table": _p2_sql(c) for c in P2_COLUMNS},
        "p2_nmr_peaks": """
            SELECT nmr_id, CAST(i AS BIGINT) AS pos, p.shift AS shift, p.multiplicity AS multiplicity, p.integration AS integration,
                   CAST(p.span.start_idx AS BIGINT) AS start_idx, CAST(p.span.end_idx AS BIGINT) AS end_idx, p.span.span_text AS span_text
            FROM (SELECT nmr_id, unnest(peaks) AS p, generate_subscripts(peaks, 1) - 1 AS i FROM nmr_data)""",
        "p2_nmr_provenance": """
            SELECT nmr_id, CAST(provenance.page_number AS BIGINT) AS page_number, provenance.bbox.x0 AS x0, provenance.bbox.y0 AS y0,
                   provenance.bbox.x1 AS x1, provenance.bbox.y1 AS y1, provenance.modality AS modality, provenance.confidence AS confidence
            FROM nmr_data WHERE provenance IS NOT NULL""",
        "p2_nmr_spans": """
            SELECT nmr_id, CAST(provenance.span.start_idx AS BIGINT) AS start_idx, CAST(provenance.span.end_idx AS BIGINT) AS end_idx, provenance.span.span_text AS span_text
            FROM nmr_data WHERE provenance.span IS NOT NULL""",
    }
