import pytest
from pyspark.sql import functions as F

from spectrail.operators import packed as P

CASES = {
    "paths": [
        ("a/x y_0.png; a/x_1.png;;", ["a/x y_0.png", "a/x_1.png"]),
        ("a/2,3-bis(4-y)_0.png,a/2,3-bis_1.png", ["a/2,3-bis(4-y)_0.png", "a/2,3-bis_1.png"]),
        ('["a/i[1,2-a]p_0.png", "a/s; t.PNG"]', ["a/i[1,2-a]p_0.png", "a/s; t.PNG"]),
        ("'a/s 3; m.png', 'a/b.png'", ["a/s 3; m.png", "a/b.png"]),
        ('a/b.png,"a/c.png",a/d.png', ["a/b.png", "a/c.png", "a/d.png"]),
        ("a/b.png | a/c.png", ["a/b.png", "a/c.png"]),
        ("a/b.png\na/c.png", ["a/b.png", "a/c.png"]),
        ("only one", ["only one"]),
        (" ", []),
        (None, []),
        (";;", []),
    ],
    "peaks": [
        ("1H NMR (400 MHz, CDCl3) δ (ppm): 8.12 (dd, J = 7.8, 1.7 Hz, 1H), 7.52–7.40 (m, 3H).", ["8.12 (dd, J = 7.8, 1.7 Hz, 1H)", "7.52–7.40 (m, 3H)"]),
        ("13C NMR (101 MHz, Pyridin-d5 (getrocknet über Molsieb 4 Å)) δ 196,1; 193,2", ["196,1", "193,2"]),
        ("13C NMR (75 MHz, D2O): δ 190.3,136.9,33.5.", ["190.3", "136.9", "33.5"]),
        ("IR (neat) cm-1: 2879 / 2874 (w) / 751", ["2879", "2874 (w)", "751"]),
        ("IR (KBr): 3483,3346,3101 (w)", ["3483", "3346", "3101 (w)"]),
        ('MS (EI) m/z = "613.1 (100)","586.1 (40)"', ["613.1 (100)", "586.1 (40)"]),
        ("MS (CI) m/z 198 (100);\n187.1 (25)", ["198 (100)", "187.1 (25)"]),
        ("213.1 (100), 194 (17)", ["213.1 (100)", "194 (17)"]),
        ("", []),
    ],
    "numbers": [
        ("J = 10.2, 5.7 Hz", ["10.2", "5.7"]),
        ("J1 = 12.6, J2 = 7.6", ["12.6", "7.6"]),
        ("7,6 Hz", ["7,6"]),
        ("8,2", ["8,2"]),
        ("9,9; 1,0 Hz", ["9,9", "1,0"]),
        ("[10.8, 1.0]", ["10.8", "1.0"]),
        ('"16.3","6.5"', ["16.3", "6.5"]),
        ("12.9 Hz 3.1 Hz", ["12.9", "3.1"]),
        ("1.4 and 1.4", ["1.4", "1.4"]),
        (None, []),
    ],
}


@pytest.mark.parametrize("kind", P.KINDS)
def test_cases(spark, kind):
    cases = CASES[kind]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "id bigint, v string").withColumn("val", F.lit("clash")).withColumn("skeleton", F.lit("clash"))
    rows = P.split_packed(df, "id", "v", kind).collect()
    for i, (value, wanted) in enumerate(cases):
        assert [r.val for r in sorted(rows) if r.id == i] == wanted, value
        assert sorted(r.pos for r in rows if r.id == i) == list(range(len(wanted)))


def test_empty_and_long(spark):
    assert P.split_packed(spark.createDataFrame([], "id bigint, v string"), "id", "v", "numbers").count() == 0
    many = "; ".join(["1.5"] * 20000)
    assert P.split_packed(spark.createDataFrame([(1, many), (1, many)], "id bigint, v string"), "id", "v", "numbers").count() == 40000


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        P.split_packed(spark.range(1), "id", "id", "other")


def test_rules_beyond_the_bound(spark, data):
    """Rules too large to broadcast are joined salted, with the same rows."""
    df = spark.read.parquet(f"{data}/spectra.parquet")
    whole, salted = (P.split_packed(df, "spectrum_id", "text_representation", "peaks", bound=n) for n in (P.BOUND, 0))
    assert whole.count() == salted.count() > 0 and whole.exceptAll(salted).count() == 0
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan and "broadcast" not in plan.lower()


def test_checkpoint_folder_must_be_shared():
    from types import SimpleNamespace

    import pytest

    from spectrail.session import ensure_checkpoint_dir

    sc = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))
