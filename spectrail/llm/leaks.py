"""Which documents contain passages of held-out items, fully or partly.

Method: items and documents become sequences of word hashes (blanks separate words; case, punctuation and markup don't count). Of every item,
windows of WINDOW words are kept as probes, so close that any copied run of RUN words holds one whole. Every window of a document that shares
enough adjacent word pairs with the items gets a 64-bit SimHash of its weighted words (weight: rarity among the items; words that no item has
weigh little). A multi-index over four blocks of 16 bits lists, for each block, the probes within 3 bits of a value; a fingerprint within 15
bits of a probe is within 3 bits in some block, so none of those is missed. A candidate is verified by the exact weighted similarity of its
word pairs, and each document and item left then by the rule itself: RUN consecutive words of the item, or SHARE of its words in order in one
stretch.

Items of fewer than WINDOW words have shorter probes: as many words as stay together somewhere if a quarter of the item's words are replaced
or dropped (three to one), at every place, and fingerprints must be equal.

The items are the stated query set. They come to the driver in blocks of BLOCK items, one after the other; each becomes an index that is
broadcast (about 5 kB an item, 100 kB where a worker has built its tables) and takes a pass over the documents of its own, so that no worker
holds more than one block's tables, however many items there are. Documents are processed whole and nothing about them is gathered or
shuffled.

Defined results: null and empty texts give no row, an item shorter than RUN words only the whole-stretch case; equal documents each give
their own rows; a pair is given once.
"""

from __future__ import annotations

import html
import itertools
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

RUN = 18  # consecutive words that make a leak
SHARE = 0.75  # of an item's words, in order in one stretch
WINDOW = 12
STEP = RUN - WINDOW + 1  # between probes: a run of RUN words holds a whole one
FOREIGN = 2  # weight of words that no item has
RADIUS = 15
SIMILAR = 0.3  # weighted similarity of word pairs of a window and a probe; three words in four leave 0.4 and more
BLOCK = 500  # items of an index; its tables take 50 MB of a worker, 200 MB while they are made
CHUNK = 1 << 19

_INLINE = re.compile(r"</?(?:a|b|i|u|em|strong|sub|sup|span|font|small|mark|code)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[/!a-z][^<>]*>", re.I)
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _C1
    h = (h ^ (h >> np.uint64(29))) * _C2
    return h ^ (h >> np.uint64(32))


def plain(text: str) -> str:
    """The text without markup."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    return html.unescape(text) if "&" in text else text


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point 1 if it is a blank, 0 if it doesn't count, else its lower-case form (2 or more)."""
    out = np.zeros(0x110000, np.uint32)
    for c in itertools.chain(range(0x3000), range(0xF900, 0x10000)):
        ch = chr(c)
        if ch.isspace():
            out[c] = 1
        elif ch.isalnum() or unicodedata.category(ch)[0] == "M":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    out[0x3000] = 1
    rest = np.concatenate([np.arange(0x3001, 0xD800), np.arange(0x10000, 0x30000)])
    out[rest] = rest
    return out


_POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and the text of each."""
    joined = " ".join(map(plain, texts)) + " "
    sizes = np.array([len(plain(t)) + 1 for t in texts], np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _letters()[points]
    keep = np.flatnonzero(low > 1)
    if not len(keep):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.cumsum(low == 1, dtype=np.int32)[keep]  # blanks so far
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    count = np.diff(first, append=len(keep))
    pos = np.arange(len(keep)) - np.repeat(first, count)
    value = (low[keep].astype(np.uint64) * _C2) * _POWER[pos % len(_POWER)]
    h = _mix(np.add.reduceat(value, first) + count.astype(np.uint64))
    of = np.searchsorted(np.cumsum(sizes), keep[first], "right")
    return h, of


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of adjacent words."""
    return _mix(h[:-1] * _C1 + (h[1:] ^ _C2))


def probe_size(n: int) -> int:
    """The words of an item's probes."""
    if n >= WINDOW:
        return WINDOW
    lost = n - math.ceil(SHARE * n)
    return max(1, math.ceil((n - lost) / (lost + 1)))


class Index:
    """Probes of a block of items, all of one size, with their fingerprints; ``build`` makes the tables that a worker needs."""

    def __init__(self, ids: list, words: list[np.ndarray], window: int, step: int, radius: int) -> None:
        self.ids, self.words, self.window, self.radius = ids, words, window, radius
        #: adjacent word pairs that a window shares with the items: a quarter of its words break two each, and one more may fall away
        self.least = max(0, window - 1 - 2 * (window // 4) - (window == WINDOW))
        every, counts = np.unique(np.concatenate([np.unique(w) for w in words] or [np.zeros(0, np.uint64)]), return_counts=True)
        self.known = every
        self.weight = np.maximum(1, np.round(8 * np.log(1 + len(words) / counts))).astype(np.int32)
        item, at = [], []
        for k, w in enumerate(words):
            last = len(w) - window
            for a in sorted({*range(0, last + 1, step), last}) if last >= 0 else ():
                item.append(k)
                at.append(a)
        self.item, self.at = np.array(item, np.int32), np.array(at, np.int32)
        self.pairs = np.array([_pairs(words[k][a : a + window]) for k, a in zip(item, at)], np.uint64).reshape(len(item), window - 1)
        self.flat = np.concatenate([words[k][a : a + window] for k, a in zip(item, at)]) if item else np.zeros(0, np.uint64)
        self.marks = self.simhash(self.flat, np.arange(0, len(self.flat), window))
        self.all_pairs = np.unique(np.concatenate([_pairs(w) for w in words if len(w) > 1] or [np.zeros(0, np.uint64)]))
        self.runs: dict[int, set[int]] = {}
        self.lists: dict[int, list[int]] = {}

    def weights(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(h), FOREIGN, np.int32)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.weight[at], FOREIGN).astype(np.int32)

    def simhash(self, h: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows from each start."""
        if not len(start):
            return np.zeros(0, np.uint64)
        bits = np.unpackbits(_mix(h * _C2 + _C1).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8)
        signed = (bits * 2 - 1) * self.weights(h)[:, None]
        total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signed, axis=0, dtype=np.int32)])
        return np.packbits(total[start + self.window] - total[start] > 0, axis=1).reshape(-1).view(np.uint64)

    def build(self) -> None:
        """For each block of 16 bits, the probes within radius // 4 bits of every value; and a bit map of word pairs, or of words."""
        near = [sum(1 << b for b in c) for k in range(self.radius // 4 + 1) for c in itertools.combinations(range(16), k)]
        masks = np.array(near, np.uint16)
        blocks = self.marks.view(np.uint16).reshape(-1, 4)
        small = np.uint16 if len(self.item) <= 1 << 16 else np.int32
        self.tables = []
        for b in range(4):
            values = (blocks[:, b][:, None] ^ masks[None, :]).reshape(-1)
            order = np.argsort(values, kind="stable")
            bounds = np.searchsorted(values[order], np.arange(65537))
            self.tables.append(((order // len(masks)).astype(small), bounds.astype(np.int64)))
        asked = self.all_pairs if self.least else self.known
        self.slots = np.uint64((1 << max(22, (16 * len(asked)).bit_length())) - 1)
        self.map = np.zeros(int(self.slots) + 1, bool)
        self.map[(asked & self.slots).astype(np.int64)] = True

    def drop(self) -> None:
        """Free what ``build`` made."""
        self.tables, self.map = [], np.zeros(0, bool)
        self.runs.clear()
        self.lists.clear()

    @staticmethod
    def _runs(w: np.ndarray) -> np.ndarray:
        """Hashes of all runs of RUN words."""
        n = len(w) - RUN + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for k in range(RUN):
            out = out * _C1 + w[k : k + n]
        return _mix(out)

    def candidates(self, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows and probes that pass fingerprint and weighted similarity."""
        none = np.zeros(0, np.int64)
        n = len(h) - self.window + 1
        if n <= 0 or not len(self.item):
            return none, none
        pairs = _pairs(h)
        hit = self.map[((pairs if self.least else h) & self.slots).astype(np.int64)]
        shared = np.concatenate([[0], np.cumsum(hit)])
        span = self.window - 1 if self.least else self.window
        start = np.flatnonzero((shared[span:][:n] - shared[:n] >= max(1, self.least)) & (of[self.window - 1 :][:n] == of[:n]))
        if not len(start):
            return none, none
        used = np.zeros(len(h) + 1, np.int32)
        np.add.at(used, start, 1)
        np.add.at(used, start + self.window, -1)
        at = np.flatnonzero(np.cumsum(used)[:-1] > 0)
        where = np.zeros(len(h), np.int64)
        where[at] = np.arange(len(at))
        marks = self.simhash(h[at], where[start])  # the words of a window stay adjacent
        found_w, found_p = [], []
        for lo in range(0, len(start), 20_000):
            part = marks[lo : lo + 20_000]
            ws, ps = [], []
            for b, (probe, bounds) in enumerate(self.tables):
                v = part.view(np.uint16).reshape(-1, 4)[:, b].astype(np.int64)
                k = bounds[v + 1] - bounds[v]
                w = np.repeat(np.arange(len(part)), k)
                p = probe[np.repeat(bounds[v] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
                near = np.bitwise_count(part[w] ^ self.marks[p]) <= self.radius
                ws.append(w[near])
                ps.append(p[near])
            key = np.unique(np.concatenate(ws).astype(np.int64) * len(self.item) + np.concatenate(ps))
            found_w.append(start[lo + key // len(self.item)])
            found_p.append(key % len(self.item))
        w, p = np.concatenate(found_w), np.concatenate(found_p)
        if self.window == 1:
            return w, p
        keep = np.zeros(len(w), bool)
        span = np.arange(self.window - 1)
        words = self.flat.reshape(-1, self.window)
        for lo in range(0, len(w), 20_000):
            mine, probe = pairs[w[lo : lo + 20_000, None] + span], self.pairs[p[lo : lo + 20_000]]
            both = (probe[:, :, None] == mine[:, None, :]).any(axis=2)
            ph = words[p[lo : lo + 20_000]]
            weight = self.weights(ph.reshape(-1)).reshape(ph.shape)
            weight = weight[:, :-1] + weight[:, 1:]
            keep[lo : lo + 20_000] = (both * weight).sum(axis=1) >= SIMILAR * weight.sum(axis=1)
        return w[keep], p[keep]

    def leaks(self, h: np.ndarray, of: np.ndarray) -> list[tuple[int, object]]:
        """(place of the text, item id) of every leak in texts of the word hashes h."""
        w, p = self.candidates(h, of)
        if not len(w):
            return []
        doc, item = of[w], self.item[p].astype(np.int64)
        diagonal = w - self.at[p]
        order = np.lexsort((diagonal, item, doc))
        out, first = [], np.searchsorted(of, np.arange(of[-1] + 2))
        runs = self._runs(h)
        for (d, k), group in itertools.groupby(zip(doc[order].tolist(), item[order].tolist(), diagonal[order].tolist()), key=lambda x: x[:2]):
            if self._is_leak(h, runs, int(first[d]), int(first[d + 1]), k, [x[2] for x in group]):
                out.append((d, self.ids[k]))
        return out

    def _is_leak(self, h: np.ndarray, runs: np.ndarray, start: int, stop: int, item: int, diagonals: list[int]) -> bool:
        """The rule for the document of the words [start, stop), around the candidates' diagonals."""
        if item not in self.lists:
            self.runs[item] = set(self._runs(self.words[item]).tolist())
            self.lists[item] = self.words[item].tolist()
        words = self.lists[item]
        size = len(words)
        slack = size // 6 + RUN
        lo, hi = max(start, diagonals[0] - slack), min(stop, diagonals[-1] + size + slack)
        if not self.runs[item].isdisjoint(runs[lo : max(lo, hi - RUN + 1)].tolist()):
            return True
        need, tried = SHARE * size, None
        for at in diagonals:
            if tried is not None and at - tried < max(min(4, size // 4), size // 20, 1):
                continue
            tried = at
            stretch = h[max(start, at - size // 6) : min(stop, at + size + size // 4)].tolist()
            inside = set(stretch)
            if sum(w in inside for w in words) >= need and common(words, stretch) >= need:
                return True
        return False


class Block:
    """The indexes of some items, one for each size of probes; items without words are in none."""

    def __init__(self, items: list[tuple]) -> None:
        hashes, of = word_hashes([t for _, t in items])
        bounds = np.searchsorted(of, np.arange(len(items) + 1))
        sizes: dict[int, tuple[list, list]] = {}
        for (key, _), a, b in zip(items, bounds, bounds[1:]):
            if b > a:
                ids, words = sizes.setdefault(probe_size(int(b - a)), ([], []))
                ids.append(key)
                words.append(hashes[a:b])
        self.indexes = [Index(ids, words, n, *((STEP, RADIUS) if n == WINDOW else (1, 0))) for n, (ids, words) in sorted(sizes.items())]

    def build(self) -> None:
        for index in self.indexes:
            index.build()

    def drop(self) -> None:
        for index in self.indexes:
            index.drop()

    def leaks(self, texts: list[str]) -> list[tuple[int, object]]:
        """(place in texts, item id) of every leak."""
        h, of = word_hashes(texts)
        return [x for index in self.indexes for x in index.leaks(h, of)] if len(h) else []


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if m := places.get(x):
            both = row & m
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def _blocks(items: DataFrame, key: str, text: str, block: int) -> Iterator[list[tuple]]:
    """The items in blocks; the driver holds one block at a time."""
    rows: list[tuple] = []
    for r in items.select(key, text).filter(F.col(text).isNotNull()).toLocalIterator():
        rows.append(tuple(r))
        if len(rows) == block:
            yield rows
            rows = []
    if rows:
        yield rows


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, block: int = BLOCK) -> DataFrame:
    """Rows (doc_key, item_key). block: items of an index; each block takes a pass over the documents."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(doc_key, docs.schema[doc_key].dataType), T.StructField(item_key, items.schema[item_key].dataType)])
    kind = to_arrow_type(items.schema[item_key].dataType)

    def against(rows: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Block(rows))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            index.build()
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                i = 0
                while i < len(texts):
                    j, size = i + 1, len(texts[i])
                    while j < len(texts) and size + len(texts[j]) <= CHUNK:
                        size += len(texts[j])
                        j += 1
                    found = index.leaks(texts[i:j])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + d for d, _ in found], pa.int32())), pa.array([k for _, k in found], kind)], [doc_key, item_key])
                    i = j
            index.drop()

        return docs.select(doc_key, doc_text).mapInArrow(scan, schema)

    parts = [against(rows) for rows in _blocks(items, item_key, item_text, block)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
