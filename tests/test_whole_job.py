"""Cases that a query once left out."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from spectrail.operators import documents as D
from spectrail.operators import segments as S

LINE = "Yield 80%. 1H NMR (400 MHz, CDCl3): d 7.26 (s, 1H), 3.71 (s, 3H). IR (neat): 1710 (s), 1600 (m). Rf = 0.3 (hexane). HRMS (ESI): calcd 123.0441 (found)."


def test_every_family_of_a_line(spark):
    lines = spark.createDataFrame([(1, 0, "Benzene (1)"), (1, 1, LINE), (1, 2, "IR only")], "id bigint, seq bigint, text string").selectExpr("*", "1L AS segment")
    hits = S.keyword_lines(lines, ("NMR", "IR", "Rf", "HRMS"))
    assert sorted((r.seq, r.word) for r in hits.collect()) == [(1, "HRMS"), (1, "IR"), (1, "NMR"), (1, "Rf"), (2, "IR")]
    docs = spark.createDataFrame([(1, "Benzene (1)\n" + LINE)], "id bigint, text string").select("id", D.cut(F.split("text", "\n"), F.array(F.lit(0))).alias("segments"))
    found = {(r.hit, r.test_type, r.test_text.split(" ")[0]) for r in D.with_tests(docs).select(F.inline("tests")).collect()}
    assert found == {(1, "1H NMR", "1H"), (1, "IR", "IR"), (1, "Rf", "Rf"), (1, "MS", "HRMS")}


def test_spans_of_provenance(spark, tmp_path):
    kind = "nmr_id bigint, provenance struct<page_number: int, span: struct<start_idx: int, end_idx: int, span_text: string>>"
    rows = [(1, (1, (3, 7, "7.26"))), (2, (1, None)), (3, None), (4, (None, (None, None, "x")))]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/nmr_data.parquet")
    got = entry.queries()["p2_nmr_spans"](spark, str(tmp_path)).orderBy("nmr_id").collect()
    assert [tuple(r) for r in got] == [(1, 3, 7, "7.26"), (4, None, None, "x")]


def test_serials_of_all_molecules(spark, tmp_path):
    spark.createDataFrame([("mol_00_000007",), ("mol_00_000012",), ("mol_01_000012",)], "molecule_id string").write.parquet(f"{tmp_path}/molecules.parquet")
    got = entry.queries()["serial_groups"](spark, str(tmp_path)).orderBy("serial").collect()
    assert [tuple(r) for r in got] == [("000007", "mol_00_000007_full"), ("000012", "mol_00_000012_full;mol_01_000012_full")]


def test_all_pairs_of_a_file_with_test_scores(spark, tmp_path):
    gt = [("f", "Benzene", "C1CCCCC1", "MS", "MS m/z 78 (100)"), ("f", "Toluol", "Cc1ccccc1", "IR", None), ("g", "Other", None, "IR", None)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(gt)], "gt_id bigint, f_name string, molecule_name string, opsin_smiles string, test_type string, test_text string").write.parquet(f"{tmp_path}/gt_tests.parquet")
    wide = [("Benzcne", "C1CCCCC1", "MS m/z 78 (100)"), ("Methylbenzene", "Cc1ccccc1", None)]
    kind = "wide_id bigint, molecule_name string, file_name string, molecule_smiles_by_images string, h1_nmr string, c13_nmr string, ir string, ms string"
    spark.createDataFrame([(i, n, "f.pdf", x, None, None, None, ms) for i, (n, x, ms) in enumerate(wide)], kind).write.parquet(f"{tmp_path}/wide_records.parquet")
    q = entry.queries()
    got = {(r.molecule_name, r.extracted_name): r.score for r in q["pair_scores"](spark, str(tmp_path)).collect()}
    assert set(got) == {(a, b) for a in ("Benzene", "Toluol") for b in ("Benzcne", "Methylbenzene")}
    assert got["Benzene", "Benzcne"] == 0.97  # the mean of 1, 0.86, 1 and 1, to 2 decimals
    assert ("Benzene", "Benzcne") in {(r.molecule_name, r.extracted_name) for r in q["best_assignment"](spark, str(tmp_path)).collect()}
