import random

import numpy as np

from spectrail.llm import spam as S

R = random.Random(6)
NOUNS = "mixture solution product solvent residue layer signal spectrum column amine ketone catalyst flask sample yield shift".split()
VERBS = "stirred heated washed dried filtered measured isolated recorded purified observed".split()


def sentence():
    return f"The {R.choice(NOUNS)} of the {R.choice(NOUNS)} was {R.choice(VERBS)} in {R.choice(NOUNS)} at {R.randint(1, 99)} °C and then {R.choice(VERBS)} for {R.randint(1, 20)} h."


def data():
    return f"1H NMR ({R.choice((300, 400))} MHz, CDCl3) δ " + ", ".join(f"{R.randint(1, 9)}.{R.randint(10, 99)} ({R.choice('sdt')}, J = {R.randint(1, 9)}.1 Hz, {R.randint(1, 3)}H)" for _ in range(8)) + "."


PROSE = [" ".join(sentence() for _ in range(R.randint(4, 12))) for _ in range(300)] + ["\n".join(data() for _ in range(4)) for _ in range(60)]
KEYS = ["silica gel", "cheap solvents", "lab glassware sale", "buy reagents online"]
SPAM = [
    " | ".join(R.choice(KEYS) for _ in range(60)),
    "\n".join(R.choice(KEYS) for _ in range(60)),
    "\n".join(f"{R.choice(KEYS)} - https://shop{i}.test/cat/item-{i}" for i in range(40)),
    " ".join(f"#{R.choice(NOUNS)}_{R.choice(('kit', 'deal'))}" for _ in range(80)),
    " ".join(R.choice(KEYS) for _ in range(80)),
    PROSE[0] + "\n" + " | ".join(R.choice(KEYS) for _ in range(120)),
]
FINE = [PROSE[1] + " " + PROSE[2] + "\nsilica gel | cheap solvents", "", None, "ok", "#a #b", " \n"]


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 AS words", "2 AS slot")
    return sorted(r.doc_id for r in S.find_spam(df, "doc_id", "text").collect())


def test_found(spark):
    n = len(PROSE)
    assert run(spark, PROSE + SPAM + FINE + SPAM[:1]) == [*range(n, n + len(SPAM)), n + len(SPAM) + len(FINE)]


def test_defined_cases(spark):
    assert run(spark, [None, ""]) == []
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.find_spam(empty, "doc_id", "text").count() == 0
    assert run(spark, SPAM[:2]) == []  # without prose there is no measure


def test_counts_do_not_depend_on_blocks():
    whole, parts = np.zeros(S.SIZE, np.int64), np.zeros(S.SIZE, np.int64)
    texts = PROSE[:20]
    S.count(texts, whole)
    for t in texts:
        S.count([t], parts)
    assert abs(int(whole.sum()) - int(parts.sum())) <= 6 * len(texts)  # only the events before a text's first two differ


def test_words():
    w = S.Words(["The flask, https://a.test/x and #tag_1\n12.5 g", "x"])
    assert w.n == 8 and w.text.tolist()[-1] == 1 and w.function.tolist()[0]


def test_thresholds():
    hist = np.zeros(S.BINS)
    hist[4:9] = 1000
    hist[20] = 1
    assert S.thresholds(hist, 0.001, 0) == (4, 8) and S.thresholds(hist, 0.001, 2) == (2, 10) and S.thresholds(np.zeros(S.BINS)) == (0, S.BINS)


def test_pages_that_go_in_a_loop(spark):
    """The low side: nothing in a looped page is improbable by the model, only that it says the same again and again."""
    loop = " ".join([sentence()] * 40)
    twice = " ".join([sentence() for _ in range(12)] * 2)
    assert run(spark, PROSE + [loop, twice]) == [len(PROSE)]
    table = np.zeros(S.SIZE, np.int64)
    S.count(PROSE, table)
    model = S.Model(table.astype(np.float32))
    cells, _ = model.windows(S.Words([loop]))
    usual, _ = model.windows(S.Words(PROSE[:50]))
    assert (cells // S.LOWS).max() <= (usual // S.LOWS).max()  # not by the high side


def test_measured_data_has_no_unit_word(spark):
    plain = [t.replace(" MHz", "").replace("NMR", "data") for t in PROSE]
    assert run(spark, plain + SPAM) == list(range(len(PROSE), len(PROSE) + len(SPAM)))


def test_said_before():
    w = S.Words(["a b c a b c a b d", "a b c"])
    assert w.said_before().round(3).tolist() == [0, 0, 0, 0, 0, 0.5, 0.5, 0.5, 0, 0, 0, 0]


def test_abnormal_cells():
    trained = np.zeros((2, S.BINS, S.LOWS))
    trained[0, 4:9, 5:9] = 1000
    flags = S.abnormal_cells(trained.reshape(-1)).reshape(2, S.BINS, S.LOWS)
    assert flags[0, :, :5].all() and flags[0, 13:].all() and not flags[0, :13, 5:].any() and not flags[1].any()
