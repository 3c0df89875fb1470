from spectrail.llm import scans as S

PLAIN = "To a solution of the amine in toluene was added sodium hydride and the mixture was stirred overnight; extraction, drying and evaporation gave the product as a white solid. 1H NMR (400 MHz, CDCl3) δ 7.26 (d, J = 8.1 Hz, 2H, exchangeable), 3.31 (s, 3H)"
HEAD = "Letters in Practice 20{:02d}, {}, 3002"


def wrapped(text, width=48, at=None, extra=(), hyphen=None):
    import textwrap

    lines = textwrap.wrap(text, width, break_on_hyphens=False)
    if hyphen:
        i = next(i for i in range(len(lines) - 1) if len(lines[i + 1].split(" ")[0]) >= 7 and lines[i + 1].split(" ")[0].isalpha())
        lines[i], lines[i + 1] = f"{lines[i]} {lines[i + 1][:4]}{hyphen}", lines[i + 1][4:]
    if at is not None:
        lines[at:at] = extra
    return "\n".join(lines)


def run(spark, texts, **options):
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "fld string, row_id bigint, text string")
    return {r.row_id: r for r in S.read(df, ["fld", "row_id"], "text", **options).collect()}


def corpus():
    clean = [PLAIN] * 60 + [wrapped(PLAIN, w) for w in (40, 50, 60, 70)]
    bad = [wrapped(PLAIN, 50 + i, 2, [f"S{10 + i}", HEAD.format(i, i)]) for i in range(6)]
    bad += [wrapped(PLAIN, 48, 3, ["Page 4 of 119"]), wrapped(PLAIN, 48, 3, ["- 12 -"]), wrapped(PLAIN, 52, 2, [HEAD.format(7, 7)])]
    bad += [wrapped(PLAIN, 44, hyphen="-"), wrapped(PLAIN, 44, hyphen="\xad"), wrapped(PLAIN, 44, hyphen="¬")]
    bad += [PLAIN.replace("1H NMR", "lH NMR"), PLAIN.replace("the", "tbe"), PLAIN.replace("δ", "8"), PLAIN.replace("7.26", "7.2b").replace("3.31", "3.3I"), PLAIN.replace("MHz", "MHx"), PLAIN.replace("J =", "j' =")]
    return clean, bad


def test_found_and_repaired(spark):
    clean, bad = corpus()
    assert all(wrapped(PLAIN, 44, hyphen=h) != wrapped(PLAIN, 44) for h in "-¬")
    got = run(spark, clean + bad)
    assert sorted(got) == list(range(len(clean), len(clean) + len(bad)))
    wrong = [r.repaired for i, r in got.items() if r.repaired != PLAIN and "7.2b" not in (clean + bad)[i]]
    assert wrong == []


def test_defined_cases(spark):
    got = run(spark, [None, "", "one\ntwo", "12"], only_found=False)
    assert {i: (r.scanned, r.repaired) for i, r in got.items()} == {1: (False, ""), 2: (False, "one two"), 3: (False, "12")}
    empty = spark.createDataFrame([], "fld string, row_id bigint, text string")
    assert S.read(empty, ["fld", "row_id"], "text").count() == 0
    long = "\n".join([PLAIN] * 500)
    assert run(spark, [long], only_found=False)[0].repaired == " ".join([PLAIN] * 500)


def test_page_numbers():
    for x in ("S12", "S-93", "- 147 -", "[p. 18]", "24 / 94", "Page 4 of 119", "83"):
        assert S.PAGE.match(x), x
    for x in ("7.26", "1H", "(12)", "a 12", "S12 of this file"):
        assert not S.PAGE.match(x), x
    page, _ = S._edges(["IR 2366, 1810,", "1044"])
    assert page == [False, False]  # the end of an open list is a value


def test_size_of_the_corpus_does_not_matter(spark):
    """Rare words and headers stay what they are within a much larger corpus."""
    clean, bad = corpus()
    alone = run(spark, clean + bad)
    def word(i):
        return "".join("bdfgkmprtv"[int(d)] + "aeiou"[int(d) // 2] for d in f"{i:03d}")

    other = [f"{word(7 * i)} {word(7 * i + 1)} {word(7 * i + 2)}\n{word(7 * i + 3)} {word(7 * i + 4)}" for i in range(12 * len(clean))]
    among = run(spark, clean + bad + other)
    assert {i: r.repaired for i, r in among.items()} == {i: r.repaired for i, r in alone.items()}


def test_words_are_decided_by_exact_counts(spark):
    words = spark.createDataFrame([("methyl", 40), ("rnethyl", 2), ("ethyI", 3), ("ethyl", 59), ("tbe", 1), ("the", 20), ("pheno1", 1), ("5a", 1)], "item string, n bigint")
    got = {r.word: r.fixed for r in S.corrections(words).collect()}
    assert got == {"rnethyl": "methyl", "tbe": "the", "pheno1": "phenol"}  # 59 isn't 20 times 3; undone figures need no entry


def test_characters_without_print_are_no_misreadings(spark):
    texts = [PLAIN] * 40 + [PLAIN.replace("toluene", "tolu‍ene"), PLAIN.replace("CDCl3", "D﻿2O"), PLAIN.replace("white", "whi⁠te")]
    assert run(spark, texts) == {}


def test_hot_rows_and_ties(spark):
    """Repeated rows of one damaged text, and repeated keys, each get their result."""
    df = spark.createDataFrame([("f", 1, PLAIN)] * 90 + [("f", 2, PLAIN.replace("the", "tbe"))] * 3, "fld string, row_id bigint, text string")
    assert [(r.row_id, r.repaired) for r in S.read(df, ["fld", "row_id"], "text").collect()] == [(2, PLAIN)] * 3
