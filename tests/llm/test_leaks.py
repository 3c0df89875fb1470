import random

from spectrail.llm import leaks as L

R = random.Random(8)
VOCAB = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 8))) for _ in range(800)] + ["the", "of", "and"] * 40
ITEMS = [(i, " ".join(R.choice(VOCAB) for _ in range(R.randint(80, 160)))) for i in range(30)]


def prose(n):
    return [R.choice(VOCAB) for _ in range(n)]


def leaked(doc: str, item: str) -> bool:
    """The rule by brute force."""
    d, w = ([x for x in ("".join(c for c in t.lower() if c.isalnum()) for t in s.split()) if x] for s in (doc, item))
    runs = {tuple(w[i : i + L.RUN]) for i in range(len(w) - L.RUN + 1)}
    if any(tuple(d[i : i + L.RUN]) in runs for i in range(len(d) - L.RUN + 1)):
        return True
    size = len(w) * 3 // 2
    return any(L.common([hash(x) for x in w], [hash(x) for x in d[i : i + size]]) >= L.SHARE * len(w) for i in range(0, max(1, len(d) - size + 1), 5))


def edited(words, every):
    out = []
    for i, x in enumerate(words):
        if i % every == every - 1:
            kind = R.randint(0, 2)
            out += [["other"], [x, "added"], []][kind]
        else:
            out.append(x)
    return out


def corpus():
    docs = []
    for i, t in ITEMS:
        w = t.split()
        a = R.randint(0, len(w) - 20)
        docs.append(prose(100) + w + prose(50))
        docs.append(prose(60) + w[a : a + L.RUN] + prose(60))
        docs.append(prose(60) + w[a : a + L.RUN - 3] + prose(60))
        docs.append(prose(30) + edited(w, R.randint(6, 11)) + prose(30))
        docs.append(prose(200))
        docs.append(w[: L.RUN])
    texts = [" ".join(d) for d in docs]
    texts[0] = texts[0].upper().replace(" ", " ")
    texts[6] = "> " + texts[6].replace(" ", "\n> ") + "."
    texts[12] = "<p>" + texts[12].replace(" ", ",<br>") + "</p>"
    return texts


def test_against_brute_force():
    texts = corpus()
    index = L.Block(ITEMS)
    index.build()
    got = {(d, i) for d, i in index.leaks(texts)}
    plain = [L.plain(t) for t in texts]
    wanted = {(d, i) for d, t in enumerate(plain) for i, item in ITEMS if leaked(t, item)}
    assert wanted and got == wanted


def test_radius_is_guaranteed():
    import numpy as np

    (index,) = L.Block(ITEMS).indexes
    index.build()
    r = np.random.default_rng(1)
    for k in range(40):
        mark = index.marks[k]
        for b in r.choice(64, L.RADIUS, replace=False):
            mark ^= np.uint64(1) << np.uint64(b)
        parts = np.array([mark]).view(np.uint16)
        assert any(k in t[0][t[1][v] : t[1][v + 1]] for t, v in zip(index.tables, parts.astype(np.int64)))


def test_common():
    for _ in range(200):
        a, b = ([R.randint(0, 5) for _ in range(R.randint(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
        assert L.common(a, b) == row[-1]


def test_frame(spark):
    texts = corpus()[:8] + [None, "", " ", "word"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id bigint, text string").selectExpr("*", "1 AS item_id")
    items = spark.createDataFrame([*ITEMS, (99, None), (98, ""), (97, "short one")], "item_id bigint, text string")
    got = sorted(map(tuple, L.find_leaks(docs, items, "doc_id", "text", "item_id", "text").collect()))
    assert got.count((0, 0)) == 2 and (1, 0) in got and all(d < 8 for d, _ in got)
    assert L.find_leaks(docs, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert L.find_leaks(docs.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0


def test_every_fourth_word_replaced():
    """Exactly three quarters of an item are kept, and the others are words that no item has."""
    index = L.Block(ITEMS)
    index.build()
    for first in range(4):
        texts = []
        for _, t in ITEMS:
            w = t.split()
            w = w[: len(w) // 4 * 4]  # the share of the whole item may fall below the rule
            texts.append(" ".join(prose(20) + [f"foreign{i}{first}" if i % 4 == first else x for i, x in enumerate(w)] + prose(20)))
        wanted = {(d, i) for d, t in enumerate(texts) for i, item in ITEMS if leaked(t, item)}
        assert len(wanted) > 5 and set(index.leaks(texts)) >= wanted


def test_short_items(spark):
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in range(1, 25)]
    docs = [(n, f"before it {t} after it") for n, t in items] + [(100 + n, " ".join(["w", "other", *t.split()[2:]]) if n > 8 else t.replace(f"w{n}x1", "other")) for n, t in items if n >= 4] + [(200 + n, " ".join(t.split()[: n // 2])) for n, t in items if 2 <= n < 18]
    block = L.Block(items)
    block.build()
    got = {(docs[d][0], i) for d, i in block.leaks([t for _, t in docs])}
    assert got == {(n, n) for n, _ in items} | {(100 + n, n) for n, _ in items if n >= 4}


def test_blocks_give_the_same(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    whole, parts = (sorted(map(tuple, L.find_leaks(docs, items, "doc_id", "text", "item_id", "text", block=n).collect())) for n in (1000, 7))
    assert whole == parts and len(whole) > 60


def test_long_markup():
    assert L.plain("a <p class='" + "x" * 5000 + "'>b") == "a  b"
