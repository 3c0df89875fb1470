import json

from pyspark.sql import functions as F

from spectrail.operators import nested as N

BOX = {"x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0}


def found(spark, *payloads, **options):
    df = spark.createDataFrame(list(enumerate(payloads)), "rec_id bigint, payload string")
    flat = N.flatten(df.withColumn("parent", F.lit("clash")).withColumn("pos", F.lit(9)), "rec_id", "payload", raw=False, lists=("provenance",), **options)
    return sorted((r.rec_id, r.parent, r.child, r.pos) for r in flat.collect() if r.child not in ("molecule", "reaction", "spectrum"))


def test_forms_of_one_list(spark):
    molecules = [{"id": "m9", "provenance": [None, {"bbox": BOX}]}, {"id": "m1", "provenance": {"page_number": 1, "span": json.dumps({"start": 1})}}]
    wanted = [(0, "molecules[0]", "provenance", 1), (0, "molecules[0].provenance[1]", "bbox", 0), (0, "molecules[1]", "provenance", 0), (0, "molecules[1].provenance[0]", "span", 0)]
    record = {"source_filename": "a", "molecules": molecules}
    keyed = {"source_filename": "a", "molecules": {m["id"]: m for m in molecules}}
    text = {"source_filename": "a", "molecules": json.dumps(molecules)}
    for r in (record, keyed, text, [record], {"extracted_data": record}):
        assert found(spark, json.dumps(r)) == wanted, r


def test_peaks_and_empty_parts(spark):
    r = {"source_filename": "a", "spectra": [{"peaks": [1.5, None, {}, {"shift": 2.0, "provenance": {"bbox": {}}}, "x"]}, None, {}, {"peaks": None}], "reactions": [{"components": [{"role": "r"}, None, {"role": "p"}]}]}
    assert found(spark, json.dumps(r)) == [(0, "reactions[0]", "component", 0), (0, "reactions[0]", "component", 2), (0, "spectra[0]", "peak", 0), (0, "spectra[0]", "peak", 3), (0, "spectra[0].peaks[3]", "provenance", 0)]


def test_no_rows_for_incomplete(spark):
    good = json.dumps({"source_filename": "a", "spectra": [{"peaks": [1]}]})
    assert found(spark, None, "", "  ", good[:-3], good + " x", "[]", "7", "null", '{"a": 1}') == []


def test_empty_table_and_ties(spark):
    empty = spark.createDataFrame([], "rec_id bigint, payload string")
    assert N.flatten(empty, "rec_id", "payload").count() == 0
    assert N.merged_schema(empty, "payload").count() == 0
    good = json.dumps({"source_filename": "a", "spectra": [{"peaks": [1, 1]}]})
    df = spark.createDataFrame([(1, good), (1, good)], "rec_id bigint, payload string")
    assert N.flatten(df, "rec_id", "payload").filter("child = 'peak'").count() == 4


def test_child_tables_and_schema(spark):
    r = {"source_filename": "a", "spectra": [{"type": "IR", "peaks": [7, {"shift": 2.5, "multiplicity": "d"}], "provenance": {"bbox": {k: str(v) for k, v in BOX.items()}}}]}
    df = spark.createDataFrame([(1, json.dumps(r))], "rec_id bigint, payload string")
    schema = {(x.path, x.kind): x.n for x in N.merged_schema(df, "payload").collect()}
    assert schema["$.spectra[].peaks[]", "number"] == 1 and schema["$.spectra[].peaks[]", "object"] == 1
    lv = N.levels(df, "payload", ("provenance",))
    t = N.child_tables(N.flatten(df, "rec_id", "payload", lv), "rec_id", lv, {"peak": "shift"}, tuple(BOX))
    assert [(x.pos, x.shift, x.multiplicity) for x in t["peak"].orderBy("pos").collect()] == [(0, 7.0, None), (1, 2.5, "d")]
    assert t["bbox"].first().x1 == 3.0 and t["bbox"].first().parent == "spectra[0].provenance[0]"


def test_levels_come_from_the_records(spark):
    r = {"source_filename": "a", "errors": ["e1", None, ""], "spectra": [{"peaks": [{"shift": 1.0, "coupling_constants": [7.5, None, 2]}]}], "extra": {"deep": [{"x": 1}, {"x": 2}]}}
    df = spark.createDataFrame([(1, json.dumps(r))], "rec_id bigint, payload string")
    lv = N.levels(df, "payload")
    flat = N.flatten(df, "rec_id", "payload", lv)
    assert sorted((x.path, x.raw) for x in flat.collect() if x.child in ("error", "coupling_constant", "deep")) == [
        ("errors[0]", "e1"), ("extra.deep[0]", '{"x":1}'), ("extra.deep[1]", '{"x":2}'), ("spectra[0].peaks[0].coupling_constants[0]", "7.5"), ("spectra[0].peaks[0].coupling_constants[2]", "2")]
    t = N.child_tables(flat, "rec_id", lv)
    assert [x.value for x in t["coupling_constant"].orderBy("pos").collect()] == [7.5, 2.0] and t["deep"].agg(F.sum("x")).first()[0] == 3.0


def test_odd_records_do_not_change_others(spark):
    """Keys of maps, of one element too, don't become members by which other objects are read."""
    m = {"id": "m", "smiles": "C"}
    rows = [{"source_filename": "a", "molecules": {f"k{i}": m}} for i in range(3)] + [{"source_filename": "a", "molecules": {"k0": m, "k1": m}}, {"source_filename": "a", "molecules": [m]}, {"source_filename": "a", "molecules": m}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "rec_id bigint, payload string")
    assert sorted((x.rec_id, x.path) for x in N.flatten(df, "rec_id", "payload").collect()) == [(0, "molecules[0]"), (1, "molecules[0]"), (2, "molecules[0]"), (3, "molecules[0]"), (3, "molecules[1]"), (4, "molecules[0]"), (5, "molecules[0]")]


def test_more_members_than_are_listed(spark):
    many = {"source_filename": "a", **{f"list{i}": [{"x": i}] for i in range(N.NAMES + 5)}}
    df = spark.createDataFrame([(1, json.dumps(many))], "rec_id bigint, payload string")
    assert N.levels(df, "payload").under["$"] is None
    assert N.flatten(df, "rec_id", "payload").count() == N.NAMES + 5


def test_explode_level_clashes(spark):
    df = spark.sql("SELECT 1 AS id, 'k' AS shift, array(named_struct('shift', 1.0D, 'pos', 5), null) AS peaks UNION ALL SELECT 2, 'k', null UNION ALL SELECT 3, 'k', array()")
    rows = N.explode_level(df, ["id", "shift"], "peaks")
    assert rows.columns == ["id", "shift", "pos", "peaks_shift", "peaks_pos"]
    assert [tuple(r) for r in rows.orderBy("pos").collect()] == [(1, "k", 0, 1.0, 5), (1, "k", 1, None, None)]
    assert N.explode_level(df, ["id"], "peaks", outer=True).count() == 4


def test_whole_table(spark, data):
    df = spark.read.parquet(f"{data}/extraction_records.parquet")
    flat = N.flatten(df, "rec_id", "payload")
    assert flat.count() == flat.select("rec_id", "path").distinct().count() > 100
