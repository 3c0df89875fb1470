import random

import pytest

from spectrail.llm import tokenize as T

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    entries = T.read_ranks(T.default_path())
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={b: i for i, b in enumerate(entries)}, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(*T.prepared(T.default_path()))


def split(encoder, texts):
    ids, counts = encoder.encode(texts)
    out, at = [], 0
    for n in counts.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_random_texts(reference, encoder):
    r = random.Random(2)
    al = "ab's'tre'll ve  \n\t 　é日1 2²½.,!?'\"<|endoftext|>🙂́ßΩ'd'm\x85\x1c"
    texts = ["".join(r.choice(al) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    for t, ids in zip(texts, split(encoder, texts)):
        assert ids == reference.encode_ordinary(t), t


def test_perfect_hash_finds_all(encoder):
    import numpy as np

    entries = [b for b, _ in sorted(encoder.rank.items(), key=lambda x: x[1])]
    buffer = np.frombuffer(b"".join(entries) + bytes(16), np.uint8)
    length = np.array([len(e) for e in entries])
    start = np.cumsum(length) - length
    words = T._words(buffer)
    assert (encoder.perfect.find(words, start, length, T.hash_spans(words, start, length)) == np.arange(len(entries))).all()
    assert sorted(encoder.perfect.slot.tolist()) == list(range(len(entries)))


def test_merge_is_byte_pair_encoding(reference, encoder):
    r = random.Random(3)
    for _ in range(300):
        b = bytes(r.choice(b"abetion xyz") for _ in range(r.randint(1, 25)))
        assert T.merge(b, encoder.rank) == reference._encode_single_piece(b)


def test_frame(spark, reference):
    long = "trifluoromethylphenyl " * 40_000
    rows = [(1, "a b"), (2, None), (3, ""), (4, long), (4, "a b"), (5, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS ids")
    got = sorted(map(tuple, T.encode_column(spark, df, "doc_id", "text").collect()), key=lambda x: (x[0], len(x[1])))
    assert got == sorted(((i, reference.encode_ordinary(t or "")) for i, t in rows), key=lambda x: (x[0], len(x[1])))
    assert T.encode_column(spark, df.limit(0), "doc_id", "text").count() == 0
