import random

import pytest
from pyspark.sql import functions as F

from spectrail.functions import peaks as P
from spectrail.functions import text as X


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first().x


def test_proton(spark):
    p = one(spark, "1H NMR (400 MHz, CDCl3) δ 8.12 (dd, J = 7.8, 1.7 Hz, 1H), 7.52–7.40 (m, 3H), 2.37 (br s, 3H), 99.1", P.proton_peaks)
    assert [x.shift for x in p] == [8.12, pytest.approx(7.46), 2.37]
    assert [x.mult for x in p] == ["dd", "m", "br s"] and p[0].j == [7.8, 1.7] and p[0].integ == 1.0 and (p[1].lo, p[1].hi) == (7.40, 7.52)
    assert one(spark, None, P.proton_peaks) == [] and one(spark, "", P.proton_peaks) == []


def test_carbon_collapses_onto_last_kept(spark):
    assert one(spark, "13C NMR δ 1.08, 1.0, 2.0, 1.04, 300.0", P.carbon_shifts) == [1.0, 1.08, 2.0]


def test_ir(spark):
    b = one(spark, "3400 (br, s), 2950-2850 (m), 1710 vs cm-1; 120", P.ir_bands)
    assert [(x.wn, x.intensity, x.broad) for x in b] == [(3400.0, 0.5, True), (2900.0, 0.55, True), (1710.0, 1.0, False)]


def test_ms(spark):
    assert [tuple(x) for x in one(spark, "MS 273 (100), 275 (34)", P.ms_peaks)] == [(273.0, 100.0), (275.0, 34.0)]
    m = one(spark, "HRMS (ESI) calcd for C12H14N2O [M+H]+ 203.1179, found 203.1181", P.ms_peaks)
    assert [tuple(x) for x in m] == [(v, 100.0) for v in (12.0, 14.0, 203.1179, 203.1181)]
    assert one(spark, "MS none", P.ms_peaks) == []


def test_frequency(spark):
    assert one(spark, "(101 MHz)", P.frequency) == 101.0 and one(spark, "no", P.frequency) == 400.0


def brute(true, pred, tol=0.01):
    if not true:
        return 0, 0, 0
    taken, hit = set(), 0
    for p in pred:
        apart = [abs(t - p) for t in true]
        j = apart.index(min(apart))
        if apart[j] <= tol and j not in taken:
            taken.add(j)
            hit += 1
    return hit, len(pred) - hit, len(true) - hit


def test_confusion_is_the_loop(spark):
    r = random.Random(1)
    rows = [([r.randint(0, 12) / 256 for _ in range(r.randint(0, 5))], [r.randint(0, 12) / 256 for _ in range(r.randint(0, 5))]) for _ in range(300)] + [([1.0, 2.0], [1.005, 1.009, 5.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [tuple(x.c) for x in df.select(P.confusion(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [brute(a, b) for a, b in rows]
    assert got[-1] == (1, 2, 1)


def test_splitting(spark):
    df = spark.createDataFrame([("d", [8.0]), ("t", []), ("q", [4.0]), ("dd", [8.0, 4.0]), ("dd", []), ("m", []), (None, []), ("hept", [])], "m string, j array<double>")
    lines = [r.l for r in df.select(P.splitting(F.lit(5.0), F.col("m"), F.col("j"), F.lit(400.0)).alias("l")).collect()]
    assert [len(x) for x in lines] == [2, 3, 4, 4, 4, 1, 1, 1]
    assert lines[0] == [pytest.approx(4.99), pytest.approx(5.01)]


def test_texts(spark):
    cut = one(spark, "1H NMR x (y). 13C NMR z", lambda t: X.cut_at_second(t, "NMR"))
    assert cut == "1H NMR x (y). 13C "
    assert one(spark, "Aspirin (1a): white", X.compound_name) == "Aspirin" and one(spark, "(1a) Aspirin", X.compound_name) is None
    assert one(spark, ' a/b:c. ', X.safe_name) == "a b c"
    assert one(spark, "", X.first_number) == "0" and one(spark, "none", X.first_number) == "-999.0" and one(spark, "a 7.25 b", X.first_number) == "7.25"
    assert one(spark, "junk); 1H NMR S, J = 2", X.repair_labels) == "1H NMR s, J = 2"
    assert one(spark, "ab.c d", X.trim_left_junk) == "c d" and one(spark, "abc", X.trim_left_junk) == "abc"
    assert one(spark, "13C (101 MHz, x);y\n", X.clean_text) == "13C NMR (101 MHz, x) y"
