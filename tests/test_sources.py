import json

from pyspark.sql import functions as F

from spectrail.sources import readers as R
from spectrail.sources import sinks as K
from spectrail.streaming import streams


def test_csv(spark, tmp_path):
    gt = tmp_path / "gt.csv"
    gt.write_text('f_name,molecule_name,test_type,test_text\na,b,IR,"x ""q"", y\nz"\n')
    r = R.ground_truth(spark, str(gt)).first()
    assert r.test_text == 'x "q", y\nz' and r.opsin_smiles is None
    tab = tmp_path / "w.csv"
    tab.write_text("Unnamed: 0\tmolecule_name\n0\ta,b,c\n")
    w = R.wide_csv(spark, str(tab)).first()
    assert (w.molecule_name, w.image_path) == ("a,b,c", "")


def test_json(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"source_filename": "a", "molecules": [{"id": "m", "provenance": [{"page_number": 1}]}], "spectra": []}))
    assert R.extraction_json(spark, str(p)).select("molecules.id").first()[0] == ["m"]
    a = tmp_path / "a.json"
    a.write_text(json.dumps([{"f1": 0.5}, {"f1": 1.0}]))
    assert [tuple(r) for r in R.json_array(spark, str(a), "f1 double").orderBy("_idx").collect()] == [(0, 0.5), (1, 1.0)]
    e = tmp_path / "e.json"
    e.write_text(json.dumps([{"id": 4, "annotations": [{"result": [{"id": "x"}]}]}]))
    assert json.loads(R.annotation_export(spark, str(e)).first().result) == [{"id": "x"}]


def test_third_party(spark):
    rec = [{"NmrSpectrum": {"nucleus": "1H", "compound": {"Compound": {"names": ["a"], "labels": ["1"]}}, "peaks": [{"NmrPeak": {"shift": "7.5–7.2"}}, {"NmrPeak": {"shift": "-0.85"}}, {"NmrPeak": {"shift": "x"}}]}}, {"Other": {"nucleus": "n"}}]
    r = R.third_party_records(spark.createDataFrame([("f", json.dumps(rec))], "k string, j string"), "k", "j").collect()
    assert [(x.kind, x.nucleus, x.shifts) for x in r] == [("NmrSpectrum", "1H", [7.5, 7.2, -0.85, -999.0])]


def test_files_and_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"plain text")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-broken")
    (tmp_path / "c.txt").write_bytes(b"no")
    pages = {r.path[-5:]: r for r in R.document_pages(R.files(spark, str(tmp_path))).collect()}
    assert set(pages) == {"a.pdf", "b.pdf"} and pages["a.pdf"].text == "plain text" and pages["b.pdf"].error


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, bytearray(b"x")), ("b", 2, None)], "f_name string, v int, pic binary")
    K.write_parts(df, str(tmp_path / "p"))
    part = K.read_part(spark, str(tmp_path / "p"), "a")
    assert [r.v for r in part.collect()] == [1]
    K.write_binary(df, str(tmp_path / "pics"), "f_name", "pic")
    assert [p.name for p in (tmp_path / "pics").iterdir()] == ["a.png"]
    K.write_wide_csv(df.select("f_name", "v"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    K.write_records(df.select(F.to_json(F.struct("v")).alias("record")), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_streams(spark, tmp_path):
    rows = [(1, 0, "a", "2024-01-01 00:00:00"), (1, 2, "b", "2024-01-01 00:10:00"), (1, 9, "c", "2024-01-01 01:10:00"), (1, 9, "c", "2024-01-01 01:10:00")]
    df = spark.createDataFrame(rows, "k bigint, pos bigint, kind string, t string").withColumn("t", F.col("t").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    once = streams.without_repeats(streams.read_table(spark, str(tmp_path / "in"), df.schema), ["k", "pos"], "t")
    counts = streams.counts_by_window(streams.read_table(spark, str(tmp_path / "in"), df.schema), "t", "k")
    for name, stream, mode in (("once", once, "append"), ("counts", counts, "complete")):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("once").count() == 3
    assert sorted(r.n for r in spark.table("counts").collect()) == [2, 2]
    seqs = streams.sequences(streams.read_table(spark, str(tmp_path / "in"), df.schema), "k", "pos", "kind", "t")
    q = seqs.writeStream.format("memory").queryName("seqs").outputMode("append").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert ("a,b") in [r.types for r in spark.table("seqs").collect()]


def test_a_part_without_rows(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([("a", 1)], "f_name string, v bigint")
    K.write_parts(df, str(tmp_path / "some"))
    K.write_parts(df.limit(0), str(tmp_path / "none"))
    assert K.read_part(spark, str(tmp_path / "some"), "b").count() == 0 and K.read_part(spark, str(tmp_path / "none"), "a", schema=df.schema).count() == 0
    with pytest.raises(ValueError):
        K.read_part(spark, str(tmp_path / "some"), "b", needed=True)
