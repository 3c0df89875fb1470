import random

import pytest
from pyspark.sql import functions as F

from spectrail.llm import lookalike as L


def frame(spark, texts, fld="f"):
    return spark.createDataFrame([(fld, i, t) for i, t in enumerate(texts)], "fld string, id bigint, text string")


def brute(texts):
    form = {i: L.by_table(t.replace("\r\n", "\n")) for i, t in enumerate(texts) if t is not None}
    return {(a, b) for a in form for b in form if a < b and form[a] == form[b] and texts[a] != texts[b]}


BASE = "13C NMR (101 MHz, méthanol-d4): δ 201.3, 20.1 fluoro Å"
SAME = [BASE.replace("C", "С"), BASE.replace(" ", "　"), BASE.replace("é", "é"), BASE.replace("fl", "ﬂ"), BASE.replace("-", "‑"), "﻿" + BASE, BASE.replace("1", "１"), BASE.replace("Å", "Å"), BASE.replace("M", "М‍")]
OTHER = [BASE.replace("é", "e"), BASE.replace("M", "m"), BASE.replace("0", "O"), BASE.replace(" ", "\n"), BASE.replace("-", "–"), BASE.replace("20", "21"), "", None]


def test_pairs(spark):
    texts = [BASE, *SAME, *OTHER, BASE]
    got = {(r.id_a, r.id_b) for r in L.pairs(frame(spark, texts)).collect()}
    assert got == brute(texts)
    n = len(SAME) + 2
    assert len(got) == n * (n - 1) // 2 - 1  # all but the two equal ones


def test_fields_stay_apart_and_empty(spark):
    both = frame(spark, [BASE], "a").unionByName(frame(spark, [SAME[0]], "b"))
    assert L.pairs(both).count() == 0 and L.pairs(both.limit(0)).count() == 0


def test_consistent(spark):
    got = {r.id: r.canonical for r in L.consistent(frame(spark, [BASE, *SAME, "", None])).collect()}
    assert set(got.values()) == {BASE, ""} and len(got) == len(SAME) + 2


def test_random_against_brute(spark):
    r = random.Random(4)
    back: dict[str, list[str]] = {}
    for odd, plain in L.LOOKALIKE.items():
        back.setdefault(plain, []).append(odd)
    texts = []
    for _ in range(40):
        base = "".join(r.choice("CMHox 13.fi") for _ in range(6))
        for _ in range(4):
            texts.append("".join((r.choice(back[c]) if c in back and r.random() < 0.3 else c) + (r.choice(L.IGNORABLE) if r.random() < 0.1 else "") for c in base))
    got = [(x.id_a, x.id_b) for x in L.pairs(frame(spark, texts)).collect()]
    assert set(got) == brute(texts) and len(set(got)) == len(got)


def test_trie_budget():
    t = L.Trie()
    for w, n in (("proton", 5), ("protons", 9), ("carbon", 2)):
        t.add(w, n)
    assert t.spell("рrоtоn") == "proton" and t.spell("protxn") is None
    assert t.spell("protxn", 1) == "proton" and t.spell("carbn", 1) == "carbon" and t.spell("carboon", 1) == "carbon"


def test_long_text(spark):
    long = "word " * 50_000
    assert L.pairs(frame(spark, [long, long.replace("w", "w​", 1)])).count() == 1


@pytest.mark.parametrize("column", ["raw", "word", "form"])
def test_clashing_names(spark, column):
    df = frame(spark, [BASE, SAME[0]]).withColumn(column, F.lit("x"))
    assert L.pairs(df).count() == 1


RUSSIAN = ["раствор", "он", "сосна"]  # a solution, he, pine


def test_the_vocabulary_decides(spark):
    """The table alone would write these words in Latin letters in part; the trie holds how the corpus spells them."""
    mixed = [w.replace("о", "o").replace("а", "a") for w in RUSSIAN]
    got = {r.id: r.canonical for r in L.consistent(frame(spark, RUSSIAN + mixed + ["Нz", "Hz", "соl", "col"])).collect()}
    assert [got[i] for i in range(6)] == RUSSIAN * 2
    assert [got[i] for i in range(6, 10)] == ["Hz", "Hz", "col", "col"]
    assert all(L.by_table(w) != w for w in RUSSIAN)
    pairs = {(r.id_a, r.id_b) for r in L.pairs(frame(spark, RUSSIAN + mixed)).collect()}
    assert pairs == {(0, 3), (1, 4), (2, 5)}


def test_without_the_trie_nothing_is_spelled(spark, monkeypatch):
    monkeypatch.setattr(L, "is_clean", lambda word: False)  # an empty vocabulary leaves the table
    words = spark.createDataFrame([(L.by_table(w), w, True, 3) for w in RUSSIAN], "form string, word string, odd boolean, n bigint")
    local = {w: L.Trie().spell(w) or L.by_table(w) for w in RUSSIAN}
    monkeypatch.undo()
    assert {r.word: r.spelling for r in L.spellings(words).collect()} == {w: w for w in RUSSIAN} != local


def test_frequent_and_plain_spellings_win():
    t = L.Trie()
    for w, n in (("µm", 2), ("μm", 9), ("он", 5), ("oн", 7)):
        if L.is_clean(w):
            t.add(w, n)
    assert t.spell("µm") == "μm" and t.spell("o​н") == "он"
    t = L.Trie()
    t.add("с", 50)
    t.add("c", 1)
    assert t.spell("с") == "c" and L.Trie().spell("c") is None


def test_precomposed_and_other_signs():
    for odd, plain in (("ё", "ë"), ("ї", "ï"), ("ό", "ó"), ("\U0001d5a0\U0001d7e3", "A1"), ("aᅟb\U000e0041", "ab")):
        assert L.by_table(odd) == plain, odd


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_budget_does_not_depend_on_partitions(spark, parts):
    """Every odd word one visible edit from a spelling finds it, wherever the edit is."""
    r = random.Random(9)
    good = ["".join(r.choice("bdgkt") for _ in range(r.randint(3, 9))) for _ in range(60)]
    rows, wanted = [(w, w, False, 5) for w in set(good)], {}
    for w in good:
        i, kind = r.randrange(len(w)), r.randrange(3)
        made = "o" + [w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :]][kind]
        word = "о" + made[1:]
        rows.append((L.by_table(word), word, True, 1))
        wanted[word] = "o" + w
        rows.append(("o" + w, "o" + w, False, 2))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {x.word: x.spelling for x in L.spellings(spark.createDataFrame(rows, "form string, word string, odd boolean, n bigint"), 1).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 3)

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    vocabulary = {w for _, w, odd, _ in rows if not odd}
    for word, spelling in got.items():
        assert spelling in vocabulary and far(L.by_table(word), spelling) == min(far(L.by_table(word), v) for v in vocabulary), word
    with pytest.raises(ValueError):
        L.spellings(spark.createDataFrame(rows, "form string, word string, odd boolean, n bigint"), 2)


def test_classes(spark):
    texts = [BASE, *SAME, *OTHER, BASE]
    got = {r.id: (r.class_id, r.n_rows, r.n_texts) for r in L.classes(frame(spark, texts)).collect()}
    n = len(SAME)
    assert all(got[i] == (0, n + 2, n + 1) for i in [*range(n + 1), len(texts) - 1])
    assert all(got[i] == (i, 1, 1) for i, t in enumerate(texts) if n < i < len(texts) - 1 and t is not None) and len(got) == len(texts) - 1
