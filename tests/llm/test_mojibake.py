import pytest

from spectrail.llm import mojibake as M

CLEAN = ["1H NMR δ 7.26 – méthanol, 20 °C, Büchner, größer, señal débil, São Brás, ångström, à 3 Å", "13C NMR (101 MHz) δ 20.1 – 30.2 °C sólido", "plain", "IR (KBr-Preßling, glänzend)"] * 20
PAGES = ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859-15"]


def damaged(text, page, times=1):
    for _ in range(times):
        text = "".join(bytes([b]).decode(page, "replace") if bytes([b]).decode(page, "replace") != "�" else chr(b) for b in text.encode())
    return text


def run(spark, texts, **options):
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "fld string, row_id bigint, text string")
    return {r.row_id: r for r in M.repair(df, ["fld", "row_id"], "text", **options).collect()}


def test_round_trips(spark):
    texts = CLEAN + [damaged(t, p) for p in PAGES for t in CLEAN[:2]] + [damaged(CLEAN[0], "cp1252", 2), damaged(CLEAN[1], "latin-1", 2)]
    wanted = [t for _ in PAGES for t in CLEAN[:2]] + CLEAN[:2]
    got = run(spark, texts)
    assert sorted(got) == list(range(len(CLEAN), len(texts)))
    assert [got[i].restored for i in sorted(got)] == wanted


def test_lost_characters_and_defined_cases(spark):
    got = run(spark, [*CLEAN, "δ � 7.2", "a \x93 b", None, "", "É", "Ã 20", CLEAN[0]])
    n = len(CLEAN)
    assert sorted(got) == [n, n + 1, n + 5]
    every = run(spark, [*CLEAN, None, ""], only_found=False)
    assert len(every) == n + 1 and all(not r.misread and r.restored == (CLEAN + [None, ""])[i] for i, r in every.items())


def test_empty_and_long(spark):
    assert run(spark, [CLEAN[0]])  == {}
    empty = spark.createDataFrame([], "fld string, row_id bigint, text string")
    assert M.repair(empty, ["fld", "row_id"], "text").count() == 0
    long = "méthanol " * 30_000
    got = run(spark, [*CLEAN, damaged(long, "cp1252")])
    assert got[len(CLEAN)].restored == long


def brute_segments(scores):
    """Maximal-scoring segments by recursion: the best segment (shortest of equals), then what lies left and right of it."""
    out = []

    def split(lo, hi):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
        if best[0] > 0:
            _, _, _, i, j = best
            split(lo, i)
            out.append((i, j))
            split(j, hi)

    split(0, len(scores))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_segments(seed):
    import random

    r = random.Random(seed)
    scores = [r.uniform(-3, 3) for _ in range(r.randint(0, 14))]
    assert M.segments(scores) == brute_segments(scores)


def greek(text):
    return text.encode("iso8859-7", "ignore").decode("latin-1")


NMR = [f"1H NMR (400 MHz, CDCl3) δ {i}.1 (s, 3H), nach Säulenchromatographie, glänzend" for i in range(200)]


def test_single_byte_pages_are_told_by_information(spark):
    texts = NMR + ["1H NMR (400 MHz, CDCl3) ä 7.1 (s, 3H), nach Chromatographie", "IR nach Säule glänzend"]
    got = run(spark, texts)
    assert {i: r.restored for i, r in got.items()} == {len(NMR): texts[len(NMR)].replace("ä", "δ")}


def test_nothing_without_the_scores():
    """Without the information no run is isolated, and nothing is tried; with it misread text is found."""
    import numpy as np

    table = np.zeros(M.PAIRS + M.SINGLES + 1, np.int64)
    bad = [damaged(NMR[0], "cp1252"), "δ \ufffd 7.2 Hz", NMR[3].replace(" δ ", " ä ")]
    table[-1] = M.count(NMR + bad, table[: M.PAIRS], table[M.PAIRS : -1])
    fix = M.Repair(table)
    assert all(fix(t)[0] for t in bad) and not any(fix(t)[0] for t in NMR)
    flat = M.Repair(table)
    flat.scores = lambda points: np.full(max(0, len(points) - 1), -M.THETA)
    assert not any(flat(t)[0] for t in bad)
    always = M.Repair(table)
    always.scores = lambda points: np.full(max(0, len(points) - 1), M.THETA)
    assert not always(bad[2])[0]


def test_long_runs_and_many_pages(spark):
    """A run far longer than a word, with a character that no page has in its middle."""
    long = "δ–é°" * 400
    bad = damaged(long, "cp1252") + "\u4e00" + damaged(long, "cp1252")
    got = run(spark, [*CLEAN, *NMR, bad])
    assert got[len(CLEAN) + len(NMR)].restored == long + "\u4e00" + long


def test_look_alikes_and_wide_letters_are_sound(spark):
    sound = ["１Ｈ ＮＭＲ （４００ ＭＨｚ） δ ７．１ Säulenchromatographie", "gave 19a as а light solid", "СDСl3 Нz", "mе\u200bthyl"]
    assert run(spark, CLEAN + NMR + sound) == {}
