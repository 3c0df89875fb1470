import itertools
import random
import textwrap
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from spectrail.functions import geometry as G
from spectrail.functions.similarity import compared, ratio
from spectrail.operators import extraction as E
from spectrail.operators import grammar
from spectrail.operators import matching as M
from spectrail.operators import scoring as C
from spectrail.operators import segments as S
from spectrail.operators import sequences as Q
from spectrail.operators import tables as B


def test_lines_and_segments(spark):
    docs = spark.createDataFrame([(1, "a\nb\n"), (2, ""), (3, None)], "id bigint, t string").withColumn("line", F.lit("clash"))
    lines = S.document_lines(docs, "id", "t", 2)
    assert [tuple(r) for r in lines.orderBy("id", "seq").collect()] == [(1, 0, 0, 0, "a"), (1, 1, 0, 1, "b"), (1, 2, 1, 0, ""), (2, 0, 0, 0, "")]
    starts = spark.createDataFrame([(1, 1)], "id bigint, seq bigint")
    assert [tuple(r) for r in S.segments(lines, starts, "id").collect()] == [(1, 1, 1, 2, 0, 1, 2)]
    assert S.segments(lines, starts.limit(0), "id").count() == 0


def test_look_around_and_end_line(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["ab", "cNM", "Rd", "e"])], "id bigint, seq bigint, text string")
    j = S.joined_text(S.look_around(lines, lines.filter("seq = 2"), "id", 1, 2), "id")
    r = j.select("text", S.end_line(j, F.lit("NMR")).alias("end"), S.end_line(j, F.lit("zz")).alias("none")).first()
    assert (r.text, r.end, r.none) == ("cNMRde", 2, None)


def test_occurrences_and_sizes(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b", "a"], ["a", "b", "a"]), (["a"], ["a", "b"]), ([], ["a"])], "s array<string>, t array<string>")
    assert [r[0] for r in df.select(Q.occurrences(F.col("s"), F.col("t"))).collect()] == [2, 0, 0]


def test_sequences_do_not_depend_on_parts(spark):
    r = random.Random(9)
    rows = [(k, i, r.randint(0, 120), r.choice("abc")) for k in range(6) for i in range(r.randint(1, 40))]
    df = spark.createDataFrame(rows, "k bigint, tie bigint, pos bigint, kind string")
    got = {n: sorted(map(str, Q.test_sequences(df, "k", "pos", "pos", "kind", "tie", 4, n).collect())) for n in (3, 17, 10_000)}
    assert got[3] == got[17] == got[10_000]
    wanted = 0
    for k in range(6):
        pos = sorted(p for a, _, p, _ in rows if a == k)
        wanted += 1 + sum(b - a > 4 for a, b in zip(pos, pos[1:]))
    assert len(got[3]) == wanted


def test_common_sequence_tie_is_first(spark):
    df = spark.createDataFrame([(1, ["b"]), (2, ["a"]), (3, ["a"]), (4, ["b"])], "i bigint, types array<string>")
    assert Q.common_sequence(df, ["i"]).first().types == ["b"]


def test_plateau_against_loop(spark):
    r = random.Random(3)
    series = {k: [r.randint(0, 3) for _ in range(r.randint(3, 14))] for k in range(30)}
    df = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "k bigint, i bigint, v bigint")
    got = {x.k: x.plateau for x in Q.first_plateau(df, "k", "i", "v").collect()}
    for k, vs in series.items():
        g = np.gradient(np.diff(vs)) if len(vs) > 2 else []
        assert got[k] == next((i for i in range(len(g) - 4) if all(abs(x) <= 1 for x in g[i : i + 5])), -1)


def test_assignment_is_optimal():
    r = np.random.default_rng(5)
    for _ in range(60):
        n, m = int(r.integers(1, 5)), int(r.integers(1, 5))
        s = np.round(r.random((n, m)) * (r.random((n, m)) > 0.4), 2)
        pairs = M.assignment(s)
        assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})
        wide = np.hstack([s, np.zeros((n, n))])
        best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(n + m), n))
        assert abs(sum(s[i, j] for i, j in pairs) - best) < 1e-9


def test_greedy_match(spark):
    pairs = spark.createDataFrame([(1, 1, 10, 100, 1.0), (1, 1, 10, 101, 2.0), (1, 1, 11, 100, 3.0), (1, 1, 12, 100, 3.0), (1, 2, 13, 102, 0.0)], "d bigint, page bigint, pic bigint, segment bigint, distance double")
    caps = spark.createDataFrame([(1, 100, 1, 2), (1, 101, 1, 1), (1, 102, 0, 0)], "d bigint, segment bigint, min_cap bigint, max_cap bigint")
    pairs = pairs.join(caps, ["d", "segment"])
    assert sorted(map(tuple, M.greedy_match(pairs, "d").collect())) == [(1, 10, 100)]
    assert sorted(map(tuple, M.greedy_match(pairs, "d", True).collect())) == [(1, 10, 100), (1, 11, 100)]
    assert M.greedy_match(pairs.limit(0), "d").count() == 0


def test_best_assignment(spark):
    s = spark.createDataFrame([("f", "a", "x", 0.9), ("f", "a", "y", 0.95), ("f", "b", "y", 0.99), ("f", "c", "z", 0.2), ("g", "a", "x", 0.8)], "k string, l string, r string, score double")
    assert sorted(map(tuple, M.best_assignment(s, "k", "l", "r").collect())) == [("f", "a", "x", 0.9), ("f", "b", "y", 0.99), ("g", "a", "x", 0.8)]


def test_boxes(spark):
    df = spark.sql("SELECT named_struct('x0', 0D, 'y0', 0D, 'x1', 2D, 'y1', 2D) a, named_struct('x0', 1D, 'y0', 1D, 'x1', 3D, 'y1', 3D) b, named_struct('x0', 2D, 'y0', 0D, 'x1', 2D, 'y1', 2D) c")
    r = df.select(G.iou(F.col("a"), F.col("b")).alias("ab"), G.iou(F.col("a"), F.col("c")).alias("ac"), G.iou(F.col("c"), F.col("c")).alias("cc")).first()
    assert abs(r.ab - 1 / 7) < 1e-12 and r.ac == 0 and r.cc == 0


def test_similarity(spark):
    rows = [("abc", "xabcx"), ("kitten", "sitting"), ("", ""), (None, "a"), ("a" * 250 + "b", "b" + "a" * 250)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [tuple(r) for r in df.select(ratio(F.col("a"), F.col("b")), compared(F.col("a"), F.col("b"))).collect()]
    assert got[3] == (None, None) and got[0][1] == 1.0
    for (a, b), (x, _) in zip(rows, got):
        assert a is None or x == SequenceMatcher(None, a, b).ratio()


def test_entities(spark):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "e string")
    assert tuple(C.entity_scores(one("a", "a", None, "b"), one("b", "c"), "e").first())[:3] == (1, 1, 1)
    assert C.entity_scores(one("a").limit(0), one("a", "b"), "e").first().f1 == 0.0


def test_annotations(spark):
    rows = '[{"id":"1","value":{"x":1,"y":2,"width":3,"height":4,"rectanglelabels":["IR"]}},{"id":"1","value":{"x":1,"y":2,"width":3,"height":4,"text":["t"]}},{"id":"1","value":{"x":9,"y":2,"width":3,"height":4,"rectanglelabels":["IR"]}},{"id":"1","value":{"x":9,"y":2,"width":3,"height":4,"text":["t"]}}]'
    df = spark.createDataFrame([(7, rows), (8, "[]"), (9, None)], "k bigint, j string")
    got = B.read_annotations(df, ["k"], "j").collect()
    assert [(r.k, r.label, r.text, [b.x for b in r.boxes]) for r in got] == [(7, "IR", "t", [1.0, 9.0])]


def test_search_and_pages(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["Ab", None, "aB", "c"])], "i bigint, t string")
    assert [r.i for r in B.search(df, ["t"], "ab").orderBy("i").collect()] == [0, 2]
    assert [r.i for r in B.page_of(df, ["i"], 2, 3).collect()] == [3]
    assert tuple(B.page_count(df.limit(0), 3).first()) == (0, 0) and tuple(B.page_count(df, 3).first()) == (4, 2)


def test_columns():
    assert B.detect_columns(["name", "h1_nmr", "13C NMR", "ir", "ms"]) == {"1H NMR": "h1_nmr", "13C NMR": "13C NMR", "IR": "ir", "MS": "ms"}
    assert B.metric_columns(["1H NMR_F1", "MS_recall", "x"])["MS"] == ["MS_recall"]


def test_test_of():
    text = "white solid. 1H NMR (400 MHz): 7.2 (s, 1H). 13C NMR (101 MHz): 20.1"
    assert E.test_of(text, "NMR") == ("1H NMR", "1H NMR (400 MHz): 7.2 (s, 1H)")
    assert E.test_of("no tests", "NMR") is None and E.test_of("The IR spectrum of 3", "IR") is None and E.test_of("", "IR") is None


def test_wrap_and_models(spark):
    long = "word " * 80
    df = spark.createDataFrame([(1, "short"), (2, long), (3, "")], "id bigint, t string")
    got = {}
    for r in E.wrapped_lines(df, ["id"], "t", 100).orderBy("id", "piece").collect():
        got.setdefault(r.id, []).append(r.text)
    assert got == {1: ["short"], 2: textwrap.wrap(long, 100), 3: [""]}
    m = E.apply_model(df.withColumn("t", F.nullif("t", F.lit(""))), "t", lambda: lambda batch: [x[:2] for x in batch], "a")
    assert [r.a for r in m.orderBy("id").collect()] == ["sh", "wo", None]
    known = spark.createDataFrame([("short", "C")], "t string, smiles string")
    assert {r.smiles for r in E.resolve_names(df.limit(1), "t", [known]).collect()} == {"C"}


def test_grammar():
    p = grammar.parse("1H NMR (400 MHz, CDCl3) δ 12.05 (t, J = 12.7 Hz, 9H), 7.52–7.40 (m, 3H, aromatic), 2.37 (br s, 3H).")
    assert (p["nucleus"], p["frequency"], p["solvent"], p["error"]) == ("1H NMR", "400 MHz", "CDCl3", None)
    assert [(s["shift"], s["multiplicity"], s["integration"]) for s in p["shifts"]] == [("12.05", "t", "9H"), ("7.52–7.40", "m", "3H"), ("2.37", "br s", "3H")]
    assert p["shifts"][0]["coupling"] == "J = 12.7 Hz" and p["shifts"][1]["assignment"] == "aromatic"
    two = grammar.parse("1H NMR (CDCl3) major rotamer 7.1 (s, 1H) minor rotamer 6.9 (s, 1H)")["shifts"]
    assert [s["isomer"] for s in two] == ["major rotamer", "minor rotamer"]
    assert grammar.parse("")["error"] and grammar.parse(None)["error"] and grammar.parse("NMR")["shifts"] == []


def test_plateaus_and_cuts_in_blocks(spark):
    import random

    from spectrail.operators import sequences as Q

    r = random.Random(2)
    rows = [(k, 3 * i, v) for k, n in (("hot", 400), ("b", 30), ("c", 1), ("d", 7)) for i, v in enumerate(itertools.accumulate(r.choice([0, 0, 0, 1, 5]) for _ in range(n)))]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    whole, blocks = (sorted(map(tuple, Q.first_plateau(df, "k", "i", "v", block=b).collect())) for b in (10_000, 8))
    assert whole == blocks and len(whole) == 3
    cuts = spark.createDataFrame([("hot", 300), ("b", 12), ("c", 0), ("d", -1)], "k string, plateau bigint")
    whole, blocks = (dict(map(tuple, Q.cut_before_gap(df, "k", "i", "v", cuts, block=b).collect())) for b in (10_000, 8))
    values = {k: [v for kk, _, v in rows if kk == k] for k in ("hot", "b")}
    wanted = {k: max([i for i in range(1, c + 1) if values[k][i] - values[k][i - 1] > 2], default=0) for k, c in (("hot", 300), ("b", 12))}
    assert whole == blocks == wanted | {"c": 0, "d": -1}


def test_records_of_a_hot_file_in_parts(spark):
    import json

    from spectrail.operators import tables as B

    m = spark.createDataFrame([("hot", f"m{i}", None, "x", None) for i in range(50)] + [("b", "n1", "C", None, "1a")], "f string, id string, smiles string, inchi string, label string")
    s = spark.createDataFrame([("hot", f"m{i}", f"s{i}", "IR", "t") for i in range(50)] + [("z", "q", "s", "MS", "t")], "f string, molecule_id string, id string, type string, text_representation string")
    rows = B.records(m, s, "f", size=10).collect()
    hot = [json.loads(r.record) for r in rows if r.f == "hot"]
    assert 1 < len(hot) <= 5 and sorted(x["id"] for r in hot for x in r["molecules"]) == sorted(f"m{i}" for i in range(50))
    assert all({x["id"] for x in r["molecules"]} == {x["molecule_id"] for x in r["spectra"]} for r in hot)
    assert {r.f: r.part for r in rows if r.f != "hot"} == {"b": 0, "z": 0}


def test_fast_name_tokens_count_the_same(spark):
    import random

    from spectrail.functions.tokens import FRAGMENTS, NAME_TOKENS, NAME_TOKENS_FAST

    r = random.Random(4)
    texts = ["".join(r.choice([*FRAGMENTS, "-2,3-", "4-", "(2S)", "(R)", " ", "q", "X", *(f.capitalize() for f in FRAGMENTS)]) for _ in range(r.randint(0, 20))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(F.regexp_extract_all("t", F.lit(f"({NAME_TOKENS})"), F.lit(1)) != F.regexp_extract_all("t", F.lit(f"({NAME_TOKENS_FAST})"), F.lit(1))).count() == 0


def test_grammar_vocabulary():
    cases = {
        "1H NMR (300 MHz, CDCl3 over K2CO3, T = 298 K) δ 7.10 (dquin, J 4.6, 1.9 Hz, 1H, OC(O)CH3)": ("1H NMR", "300 MHz", "CDCl3 over K2CO3", "T = 298 K", None, [("7.10", "dquin", "J 4.6, 1.9 Hz", "1H", "OC(O)CH3", None)]),
        "13C{1H} NMR (d8-toluene/CD3CN mixture, 101 MHz) (as a mixture of diastereomers) δ/ppm 170.1, 20.5": ("13C{1H} NMR", "101 MHz", "d8-toluene/CD3CN mixture", None, "(as a mixture of diastereomers)", [("170.1",) + (None,) * 5, ("20.5",) + (None,) * 5]),
        "31P19F NMR (Et2O) Signals correspond to keto-tautomer: 1.20 (s, 3H); Signals correspond to enol-tautomer: 1.30 (t with further splitting, 2H)": ("31P19F NMR", None, "Et2O", None, None, [("1.20", "s", None, "3H", None, "keto-tautomer"), ("1.30", "t with further splitting", None, "2H", None, "enol-tautomer")]),
    }
    for text, wanted in cases.items():
        p = grammar.parse(text)
        shifts = [(s["shift"], s["multiplicity"], s["coupling"], s["integration"], s["assignment"], s["isomer"]) for s in p["shifts"]]
        assert (p["nucleus"], p["frequency"], p["solvent"], p["temperature"], p["mixture"], shifts) == wanted, text
    assert len(grammar.TOKENS) == 18
