"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Method, in two tiers, for a batch of texts at once with array operations:

1. Pre-tokens are found without a regular expression: every code point has a class (letter, number, blank, other), runs of one class are
   bounded, and the rules of the pattern for blanks before a word and for English contractions move the bounds.
2. A minimal perfect hash over the vocabulary (hash and displace; one slot for each entry) resolves all pre-tokens that are entries. The
   bytes are compared, so a foreign pre-token never resolves.
3. The others, a few percent, are merged with a heap over linked bytes, once for each distinct pre-token and kept by its bytes.

The vocabulary, which is of fixed size, is read on the driver from a path (a parameter) and broadcast with the hash.

Defined results: null and empty texts give an empty list; names of special tokens in a text are ordinary text; invalid UTF-16 can't occur in
a Spark string; texts of any length are encoded whole. Two texts that are equal get equal ids.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points of white space that Python's isspace counts but Unicode's White_Space doesn't.
_NO_BLANK = frozenset("\x1c\x1d\x1e\x1f")
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)
#: Code points encoded at once; bounds a task's memory whatever the texts' lengths.
CHUNK = 1 << 19
#: Merged pre-tokens kept in a worker; beyond it the store starts anew.
KEEP = 1 << 18


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a file of base64 entries and ranks; the place in the list is the rank."""
    with open(path, "rb") as f:
        entries = [line.split() for line in f if line.strip()]
    out = [b""] * len(entries)
    for token, rank in entries:
        out[int(rank)] = base64.b64decode(token)
    return out


# --- arrays of bytes ----------------------------------------------------------------------------------------------------------------


def _words(buffer: np.ndarray) -> np.ndarray:
    """A view of the 8 bytes from every position; the buffer ends in 8 spare bytes."""
    return np.ndarray((len(buffer) - 8,), np.dtype("<u8"), buffer=buffer.data, strides=(1,))


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MUL
    return h ^ (h >> np.uint64(29))


def hash_spans(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of bytes."""
    h = _mix((words[start] & _MASK[np.minimum(length, 8)]) + length.astype(np.uint64) * _MIX)
    at, k = np.flatnonzero(length > 8), 8
    while len(at):
        rest = length[at] - k
        h[at] = _mix(h[at] * _MIX + (words[start[at] + k] & _MASK[np.minimum(rest, 8)]))
        at, k = at[rest > 8], k + 8
    return h


class Perfect:
    """A minimal perfect hash from the entries of a vocabulary to their ranks."""

    def __init__(self, entries: list[bytes]) -> None:
        self.n = n = len(entries)
        self.buffer = np.frombuffer(b"".join(entries) + bytes(16), np.uint8)
        self.length = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.length) - self.length
        h = hash_spans(_words(self.buffer), self.start, self.length)
        if len(np.unique(h)) != n:
            raise ValueError("entries aren't distinct")
        self.buckets = max(1, n // 3)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)  # a displacement, or -1 - slot for a bucket of one
        self.slot = np.full(n, -1, np.int64)
        sizes = np.diff(bounds)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own = order[bounds[b] : bounds[b + 1]]
            for base in itertools.count(0, 64):  # 64 displacements are tried at once
                at = self._place(h[own][None, :], np.arange(base, base + 64)[:, None])
                good = (self.slot[at] < 0).all(axis=1)
                d = next((d for d in np.flatnonzero(good) if len(set(at[d].tolist())) == len(own)), None)
                if d is not None:
                    break
            self.slot[at[d]], self.shift[b] = own, base + d
        free = np.flatnonzero(self.slot < 0)
        ones = np.flatnonzero(sizes == 1)
        self.slot[free] = order[bounds[ones]]
        self.shift[ones] = -1 - free

    def _place(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix((h >> np.uint64(17)) + d.astype(np.uint64) * _MIX) % np.uint64(self.n)).astype(np.int64)

    def find(self, words: np.ndarray, start: np.ndarray, length: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The rank of each span, -1 where it is no entry."""
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, self._place(h, np.maximum(shift, 0)))
        rank = self.slot[slot]
        same = self.length[rank] == length
        own, k = _words(self.buffer), 0
        at = np.flatnonzero(same)
        while len(at):
            rest = length[at] - k
            mask = _MASK[np.minimum(rest, 8)]
            ok = (words[start[at] + k] & mask) == (own[self.start[rank[at]] + k] & mask)
            same[at[~ok]] = False
            at, k = at[ok & (rest > 8)], k + 8
        return np.where(same, rank, -1)


# --- pre-tokens ---------------------------------------------------------------------------------------------------------------------


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
        elif chr(c).isspace() and chr(c) not in _NO_BLANK:
            out[c] = BLANK
    return out


def pre_token_starts(points: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point; first holds the place of each text's first one, kinds the class of every code point.

    The pattern: contractions 's 't 're 've 'm 'll 'd, then a run of letters, of numbers or of other characters, each with one blank before
    it if there is one, then blanks, of which the last before a word stays apart.
    """
    n = len(points)
    cls = kinds[points]
    starts = np.empty(n, bool)
    starts[0] = True
    np.not_equal(cls[1:], cls[:-1], out=starts[1:])
    head = np.zeros(n, bool)
    head[first] = True
    starts |= head
    words = np.flatnonzero(starts & (cls != BLANK) & ~head)
    words = words[cls[words - 1] == BLANK]
    starts[words - 1] = True
    starts[words[points[words - 1] == 32]] = False
    marks = np.flatnonzero((points == 39) & starts)
    marks = marks[marks + 1 < n]
    marks = marks[(cls[marks + 1] == LETTER) & ~head[marks + 1]]
    if len(marks):
        pad = np.concatenate([points, np.zeros(3, points.dtype)])
        c1, c2 = pad[marks + 1], np.where(np.concatenate([head, [True] * 3])[marks + 2], 0, pad[marks + 2])
        size = np.where(np.isin(c1, [ord(c) for c in "stmd"]), 2, 0)
        for pair in ("re", "ve", "ll"):
            size = np.where((c1 == ord(pair[0])) & (c2 == ord(pair[1])), 3, size)
        marks, size = marks[size > 0], size[size > 0]
        starts[marks + 1] = False
        after = marks + size
        starts[after[after < n]] = True
    return starts


def merge(token: bytes, rank: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one pre-token, by a heap over linked bytes."""
    n = len(token)
    nxt = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    end = list(range(1, n + 1))  # of the part that begins here; 0 when it was merged away
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(token[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if end[i] else n
        if j >= n or not end[i] or end[j] != stop:
            continue  # one of the parts has changed since
        end[i], end[j] = stop, 0
        nxt[i] = nxt[j]
        if nxt[i] < n:
            before[nxt[i]] = i
            if (r := rank.get(token[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if (p := before[i]) >= 0 and (r := rank.get(token[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [rank[token[i : end[i]]] for i in range(n) if end[i]]


class Encoder:
    """Encodes lists of texts; built from a vocabulary, its perfect hash and the classes of code points."""

    def __init__(self, entries: list[bytes], perfect: Perfect, kinds: np.ndarray) -> None:
        self.kinds = kinds
        self.rank = {e: i for i, e in enumerate(entries)}
        self.perfect = perfect
        self.kept: dict[bytes, np.ndarray] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has."""
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        data = joined.encode("utf-8", "surrogatepass")
        if not data:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        filled = np.flatnonzero(sizes)
        first = (np.cumsum(sizes) - sizes)[filled]
        at = np.flatnonzero(pre_token_starts(points, first, self.kinds))
        of_text = np.searchsorted(first, at, "right") - 1
        if len(data) != len(points):
            width = np.ones(len(points), np.int64)
            for limit in (0x80, 0x800, 0x10000):
                width += points >= limit
            start = (np.cumsum(width) - width)[at]
        else:
            start = at
        length = np.diff(start, append=len(data))
        buffer = np.frombuffer(data + bytes(16), np.uint8)
        words = _words(buffer)
        h = hash_spans(words, start, length)
        ids = self.perfect.find(words, start, length, h)
        count = np.ones(len(ids), np.int64)
        missed = np.flatnonzero(ids < 0)
        parts: list[np.ndarray] = []
        if len(missed):
            spans = [data[s : s + k] for s, k in zip(start[missed].tolist(), length[missed].tolist())]
            kept = self.kept
            for s in set(spans):
                if s not in kept:
                    if len(kept) >= KEEP:
                        kept.clear()
                        kept |= {x: np.array(merge(x, self.rank), np.int32) for x in set(spans)}
                        break
                    kept[s] = np.array(merge(s, self.rank), np.int32)
            parts = [kept[s] for s in spans]
            count[missed] = [len(p) for p in parts]
        out = np.empty(int(count.sum()), np.int32)
        place = np.cumsum(count) - count
        hit = ids >= 0
        out[place[hit]] = ids[hit]
        if parts:
            flat = np.concatenate(parts)
            k = count[missed]
            out[np.repeat(place[missed] - (np.cumsum(k) - k), k) + np.arange(len(flat))] = flat
        total = np.zeros(len(texts), np.int64)
        total[filled] = np.bincount(of_text, weights=count, minlength=len(filled)).astype(np.int64)
        return out, total


@lru_cache(4)
def prepared(path: str) -> tuple[list[bytes], Perfect, np.ndarray]:
    """What an Encoder is built from; computed once in a driver."""
    entries = read_ranks(path)
    return entries, Perfect(entries), classes()


_encoders: dict[str, Encoder] = {}


def encode_column(spark: SparkSession, df: DataFrame, key: str, column: str, path: str | None = None) -> DataFrame:
    """Rows (key, ids) for all rows."""
    source = path or default_path()
    shared = spark.sparkContext.broadcast(prepared(source))
    kind = df.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if source not in _encoders:
            _encoders[source] = Encoder(*shared.value)
        encoder = _encoders[source]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            i = 0
            while i < len(texts):
                j, size = i + 1, len(texts[i])
                while j < len(texts) and size + len(texts[j]) <= CHUNK:
                    size += len(texts[j])
                    j += 1
                ids, counts = encoder.encode(texts[i:j])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], [key, "ids"])
                i = j

    return df.select(F.col(key), F.col(column)).mapInArrow(scan, f"`{key}` {kind}, ids array<int>")
