"""Keyword-stuffed pages, link lists, tags and offers instead of prose or measured data.

Method: every word becomes a class: function words of four languages stand for themselves, other words for their make (number, link, tag,
capital, ending of a lower-case word, ...) and the punctuation behind them; line breaks count as blanks. A trigram model with back-off is
trained on the prose of the corpus: sentences with enough function words, no repeated words and not said before on the page, and stretches
dense with decimal numbers, as lists of measured values are. Words are then scored over a sliding window in two ways. By the model, a window's
mean surprisal is abnormally high above what the training windows show (all but a share TAIL of them, and a MARGIN of one bit; dense windows
have their own range). By the model mixed in equal parts with what the page itself has said so far, the mean is abnormally low below what the training
windows show: text that goes in a loop. A page is spam if more than half of its words lie in abnormal windows.

Two narrow passes over the texts. The counts of the first go into tables of fixed size, are summed by slot before and after the shuffle,
and are broadcast (about 5 MB at any size of the corpus). The second keeps, for each page, a sparse histogram of its windows; the thresholds
come from the histograms of all training windows.

Defined results: null and empty texts and texts under LEAST words give no row; texts of any length are scored whole; equal texts get equal
results; a corpus without any prose flags nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrail.session import cut

# Function words.
FUNCTION_WORDS = {
    "en": "a an the this that these those it its he she we you they i our your their his her and or but nor if then than because while when where which who what why how as of to in on at by for from with without into onto over under after before between during about against through is are was were be been being has have had do does did not no can could may might must shall should will would there here also only both each some any all most more such very so up out off",
    "fr": "le la les un une des du de et ou mais donc or ni car que qui quoi dont où ce cet cette ces il elle ils elles nous vous on se sa son ses leur leurs ne pas plus moins très à au aux dans par pour sur sous avec sans entre vers chez après avant pendant est sont était été être a ont avait avoir en y si comme même puis aussi d'une d'un l'on s'il",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber denn sondern wenn dass weil als wie wo was wer er sie es wir ihr ich man sich nicht kein keine nur auch noch schon sehr mehr in im an am auf aus bei beim mit nach von vom vor zu zum zur über unter durch für gegen ohne um zwischen während ist sind war waren wird wurde wurden werden worden hat haben hatte kann konnte muss soll",
    "es": "el la los las un una unos unas y o pero sino que quien cual cuyo donde cuando como este esta estos estas ese esa eso aquel él ella ellos ellas nosotros se su sus lo le les no ni muy más menos ya también solo de del a al en por para con sin sobre entre hasta desde tras durante es son era fue fueron ser está están ha han había haber hay si",
}
DENSE = 0.2  # share of decimal numbers in a window of measured data
LEAST = 15  # words of a page
HALF = 10  # words on each side of a window's middle
TAIL = 0.0001  # share of training windows beyond each end of the normal range
MARGIN = 4  # bins beyond that range that still pass, one bit
BINS, STEP = 56, 0.25  # of the histograms, in bits
LOWS, FINE = 16, 0.125  # of those of the model mixed with the page
CELLS = 2 * BINS * LOWS
TRI, BI = 1 << 20, 1 << 18
CHUNK = 1 << 19

_QUOTED = re.compile(r"\n(?:>[ \t]?)+")  # marks of quoted lines are no words
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
LOWER, UPPER, DIGIT, SLASH, TAG, DASH, FOREIGN, SYMBOL, COLON = (1 << k for k in range(9))
_ENDINGS, _PUNCT = 24, 5
_KINDS = {k: i for i, k in enumerate("number decimal link tag mixed name joined capitals capital foreign pipe angle bar equals symbol".split())}
_POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _C1
    return h ^ (h >> np.uint64(29))


@lru_cache(1)
def _chars() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point its flags, its lower-case form if it is a letter (else 0), and 1 for a blank, 2 for a line break."""
    flags = np.full(0x110000, SYMBOL, np.uint16)
    low = np.zeros(0x110000, np.uint32)
    blank = np.zeros(0x110000, np.uint8)
    for c in range(0x3100):
        ch = chr(c)
        if ch.isspace():
            blank[c], flags[c] = (2 if ch in "\n\r\x0b\x0c\x85  " else 1), 0
        elif ch.isalpha():
            flags[c] = (UPPER if ch.isupper() else LOWER) if c < 0x250 else FOREIGN
            low[c] = ord(ch.lower()[0])
        elif ch.isdigit():
            flags[c] = DIGIT
    flags[0x3100:0xE000] = FOREIGN
    for chars, flag in (("/", SLASH), ("_#@", TAG), ("-–‑", DASH), (":", COLON), (".,;!?()[]{}\"'’%°", 0)):
        for ch in chars:
            flags[ord(ch)] = flag
    return flags, low, blank


@lru_cache(1)
def _functions() -> tuple[np.ndarray, np.ndarray, int]:
    """A table from hashes to function words (id + 1), their hashes, and how many there are."""
    words = sorted({w for text in FUNCTION_WORDS.values() for w in text.split()})
    _, low, _ = _chars()

    def hashed(word: str) -> int:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for i, ch in enumerate(word):
                h = h + (np.uint64(low[ord(ch)]) * _C2) * _POWER[i]
        return int(_mix(np.array([h]))[0])

    table = np.zeros(1 << 16, np.int16)
    own = np.zeros(len(words) + 1, np.uint64)
    n = 0
    for w in words:
        h = hashed(w)
        if not table[h & 0xFFFF]:  # a clash of two words leaves the later one an ordinary word
            n += 1
            table[h & 0xFFFF], own[n] = n, h
    return table, own, n


class Words:
    """The classes of all words of some texts, one text after the other."""

    def __init__(self, texts: list[str]) -> None:
        texts = [_QUOTED.sub("\n", t) if "\n>" in t else t for t in texts]
        joined = "".join(t + "\n" for t in texts)
        flags_of, low_of, blank_of = _chars()
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = blank_of[points]
        solid = blank == 0
        first = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]))
        self.n = len(first)
        self._said: np.ndarray | None = None
        if not self.n:
            return
        last = np.flatnonzero(solid & np.concatenate([~solid[1:], [True]]))
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, "right")
        low = low_of[points]
        place = np.arange(len(points)) - np.repeat(first, np.diff(first, append=len(points))) if first[0] == 0 else np.arange(len(points)) - np.concatenate([np.zeros(first[0], np.int64), np.repeat(first, np.diff(first, append=len(points)))])
        h = _mix(np.add.reduceat((low.astype(np.uint64) * _C2) * _POWER[place & 4095], first))
        self.hash = h
        flags = np.bitwise_or.reduceat(flags_of[points], first)
        letters = np.where(low > 0, np.arange(len(points)), -1)
        end = np.maximum.reduceat(letters, first)
        has = end >= first
        e1 = np.where(has, low[np.maximum(end, 0)], 0)
        e2 = np.where(has & (end > first), low[np.maximum(end - 1, 0)], 0)
        tail = points[last]
        punct = np.zeros(self.n, np.int64)
        for k, chars in ((1, ","), (2, "."), (3, ";:"), (4, "!?")):
            punct[np.isin(tail, [ord(c) for c in chars])] = k
        table, own, count = _functions()
        f = table[(h & np.uint64(0xFFFF)).astype(np.int64)]
        is_f = (f > 0) & (own[f] == h) & (flags & (DIGIT | SLASH | TAG | SYMBOL) == 0) & has
        self.function = is_f
        size = last - first + 1
        inner = (flags & COLON > 0) & (tail != ord(":"))
        k = np.full(self.n, _KINDS["symbol"], np.int64)
        alpha, digit = flags & (LOWER | UPPER) > 0, flags & DIGIT > 0
        k[digit & ~alpha] = _KINDS["number"]
        dots = np.add.reduceat((points == 46).astype(np.int32), first) - (tail == 46)
        k[digit & ~alpha & (dots > 0)] = _KINDS["decimal"]
        k[alpha & digit] = _KINDS["mixed"]
        k[alpha & digit & (flags & DASH > 0)] = _KINDS["name"]
        plain = alpha & ~digit
        lower = plain & (flags & UPPER == 0)
        k[lower] = len(_KINDS) + ((e1 * 7 + e2 * 31) % _ENDINGS)[lower]
        k[plain & (flags & UPPER > 0)] = _KINDS["capital"]
        k[plain & (flags & LOWER == 0) & (size > 1)] = _KINDS["capitals"]
        k[plain & (flags & DASH > 0)] = _KINDS["joined"]
        k[(flags & FOREIGN > 0) & ~alpha] = _KINDS["foreign"]
        k[alpha & ((flags & TAG > 0) | (inner & (flags & SLASH == 0)))] = _KINDS["tag"]
        k[alpha & (flags & SLASH > 0) & (dots > 0)] = _KINDS["link"]
        for name, chars in (("pipe", "|"), ("angle", ">»"), ("bar", "-–"), ("equals", "=")):
            k[(size == 1) & np.isin(tail, [ord(c) for c in chars])] = _KINDS[name]
        self.word = alpha | digit | (flags & FOREIGN > 0)  # what counts as a word
        self.decimal = k == _KINDS["decimal"]
        self.content = self.word & ~is_f
        classes = np.where(is_f, f.astype(np.int64), count + 1 + k * _PUNCT + punct)
        # texts begin with an event of class 0; line breaks are blanks, as prose may be wrapped anywhere
        breaks = np.concatenate([[0], np.cumsum(blank == 2)])
        lines = np.diff(np.concatenate([[-1], breaks[first]])) > 0
        lines[0] = True
        opens = np.concatenate([[True], self.text[1:] != self.text[:-1]])
        self.at = np.arange(self.n) + np.cumsum(opens) + 1
        self.punct = punct
        self.events = np.zeros(self.at[-1] + 1, np.int64)
        self.events[self.at] = classes
        self.opens = opens
        # a sentence also ends where a line ends and the next begins with a capital or a figure
        self.breaks = lines & (flags_of[points[first]] & (UPPER | DIGIT) > 0)

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every event but the first two, the slots of its trigram, of the two events before it, and of its bigram."""
        a, b, c = self.events[:-2].astype(np.uint64), self.events[1:-1].astype(np.uint64), self.events[2:].astype(np.uint64)
        ab = _mix(a * _C1 + b * _C2 + np.uint64(1))
        bc = (_mix(b * _C1 + c * _C2 + np.uint64(1)) & np.uint64(BI - 1)).astype(np.int64)
        return (_mix(ab + c * _C1) & np.uint64(TRI - 1)).astype(np.int64), (ab & np.uint64(BI - 1)).astype(np.int64), bc

    def around(self) -> tuple[np.ndarray, np.ndarray]:
        """The window around each word, [from, to): at most HALF words on either side in its text."""
        bounds = np.searchsorted(self.text, np.arange(self.text[-1] + 2))
        i = np.arange(self.n)
        return np.maximum(i - HALF, bounds[self.text]), np.minimum(i + HALF + 1, bounds[self.text + 1])

    def said_before(self) -> np.ndarray:
        """How often, of the times that a text had the two words before each word, it went on with that word."""
        if self._said is not None:
            return self._said
        context = _mix(self.text.astype(np.uint64) * _C1 + np.concatenate([[0, 0], self.hash[:-2]]).astype(np.uint64) * _C2 + np.concatenate([[0], self.hash[:-1]]).astype(np.uint64))

        def earlier(keys: np.ndarray) -> np.ndarray:
            order = np.argsort(keys, kind="stable")
            first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
            start = np.flatnonzero(first)
            out = np.empty(len(keys), np.int64)
            out[order] = np.arange(len(keys)) - np.repeat(start, np.diff(start, append=len(keys)))
            return out

        self._said = earlier(_mix(context * _C1 + self.hash)) / (earlier(context) + 1)
        return self._said

    def dense(self) -> np.ndarray:
        """Whether the window around each word is dense with decimal numbers, as lists of measured values are."""
        lo, hi = self.around()
        decimals = np.concatenate([[0], np.cumsum(self.decimal)])
        return decimals[hi] - decimals[lo] >= DENSE * (hi - lo)

    def trained(self) -> np.ndarray:
        """Whether each event is trained: of a sentence of prose without repeated words that the page hasn't said before, or in a dense
        window."""
        ends = (self.punct == 2) | (self.punct == 4)
        starts = np.concatenate([[True], ends[:-1]]) | self.opens | self.breaks
        s = np.cumsum(starts) - 1
        n = np.bincount(s)
        repeated = np.zeros(self.n, bool)
        for k in range(1, 9):
            repeated[k:] |= (self.hash[k:] == self.hash[:-k]) & (s[k:] == s[:-k]) & self.content[k:]
        content = np.bincount(s, self.content)
        prose = (n >= 5) & (np.bincount(s, self.function) >= 0.2 * n) & (np.bincount(s, repeated) <= 0.15 * np.maximum(content, 1))
        prose &= (np.bincount(s, ends) > 0) & (np.bincount(s, self.said_before() > 0.5) <= 0.5 * n)
        good = prose[s] | self.dense()
        out = np.zeros(len(self.events), bool)
        out[self.at] = good
        out[self.at[self.opens] - 1] = good[self.opens]  # the beginning of the text
        return out


def count(texts: list[str], table: np.ndarray) -> None:
    """Add the events of the training sentences of some texts to a table of trigrams, bigrams and single events."""
    w = Words(texts)
    if w.n < 2:
        return
    tri, _, bc = w.slots()
    on = w.trained()[2:]
    table[:TRI] += np.bincount(tri[on], minlength=TRI)
    table[TRI : TRI + BI] += np.bincount(bc[on], minlength=BI)
    own = np.bincount(w.events[2:][on])
    table[TRI + BI : TRI + BI + len(own)] += own


class Model:
    """Surprisal in bits of events, by trigrams with back-off."""

    def __init__(self, table: np.ndarray) -> None:
        self.tri, self.bi, self.one = (table[:TRI].astype(np.float32), table[TRI : TRI + BI].astype(np.float32), table[TRI + BI :].astype(np.float32))
        self.total = float(self.one.sum())

    def surprisal(self, w: Words) -> np.ndarray:
        tri, ab, bc = w.slots()
        b, c = w.events[1:-1], w.events[2:]
        single = (self.one[c] + 0.02) / (self.total + 0.02 * len(self.one))
        context = self.one[b]
        pair = (self.bi[bc] + 3 * single) / (np.maximum(context, self.bi[bc]) + 3)
        before = self.bi[ab]
        triple = (self.tri[tri] + 3 * pair) / (np.maximum(before, self.tri[tri]) + 3)
        return np.concatenate([[0.0, 0.0], np.minimum(-np.log2(triple), BINS * STEP)]).astype(np.float32)

    def windows(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each word's window: whether it is dense, the bin of its mean surprisal, and that of the mixture with the page; and
        which windows are trained as a whole."""
        lo, hi = w.around()
        whole = self.surprisal(w)
        mixed = -np.log2(0.5 * np.exp2(-whole[w.at]) + 0.5 * w.said_before())
        own = whole[w.at]
        sums = np.concatenate([[0.0], np.cumsum(np.where(w.opens, whole[w.at - 1], 0) + own, dtype=np.float64)])
        events = np.concatenate([[0], np.cumsum(1 + w.opens)])
        high = np.minimum(((sums[hi] - sums[lo]) / (events[hi] - events[lo]) / STEP).astype(np.int64), BINS - 1)
        sums = np.concatenate([[0.0], np.cumsum(mixed, dtype=np.float64)])
        low = np.minimum(((sums[hi] - sums[lo]) / (hi - lo) / FINE).astype(np.int64), LOWS - 1)
        trained = np.concatenate([[0], np.cumsum(w.trained()[w.at])])
        return (BINS * w.dense() + high) * LOWS + low, trained[hi] - trained[lo] == hi - lo


SIZE = TRI + BI + 2048


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= CHUNK:
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def train(docs: DataFrame, column: str) -> np.ndarray:
    """The table of counts over all texts; SIZE slots whatever the corpus."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SIZE, np.int64)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for i, j in _chunks(texts):
                count(texts[i:j], table)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], ["slot", "n"])

    rows = docs.select(column).mapInArrow(scan, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SIZE rows at most
    table = np.zeros(SIZE, np.float32)
    table[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return table


def histograms(docs: DataFrame, key: str, column: str, table: np.ndarray) -> DataFrame:
    """Rows (key, words, cells, windows, trained): how many words, and for the cells that a text has, how many of its windows and how many of
    those that are trained as a whole."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in _chunks(texts):
                n = j - i
                at, all_, own = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                w = Words(texts[i:j])
                if w.n >= 2:
                    cell, whole = model.windows(w)
                    at, of = np.unique(w.text[w.word] * CELLS + cell[w.word], return_inverse=True)
                    all_ = np.bincount(of, minlength=len(at))
                    own = np.bincount(of, whole[w.word], minlength=len(at)).astype(np.int64)
                bounds = np.searchsorted(at, np.arange(n + 1) * CELLS)
                words = np.concatenate([[0], np.cumsum(all_)])
                lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (at % CELLS, all_, own)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(words[bounds[1:]] - words[bounds[:-1]]), *lists], [key, "words", "cells", "windows", "trained"])

    lists = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("cells", "windows", "trained")]
    return docs.select(key, column).mapInArrow(scan, T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("words", T.LongType()), *lists]))


def thresholds(hist: np.ndarray, tail: float = TAIL, margin: int = MARGIN) -> tuple[int, int]:
    """The first and last bin of normal windows, from the histogram of training windows: all but the tails, and a margin."""
    total = hist.sum()
    if not total:
        return 0, len(hist)
    share = np.cumsum(hist) / total
    return max(0, int(np.searchsorted(share, tail)) - margin), int(np.searchsorted(share, 1 - tail)) + margin


def abnormal_cells(trained: np.ndarray) -> np.ndarray:
    """Which cells are abnormal, from the histogram of training windows."""
    hist = trained.reshape(2, BINS, LOWS)
    out = np.zeros((2, BINS, LOWS), bool)
    for k in (0, 1):
        out[k, thresholds(hist[k].sum(axis=1))[1] + 1 :, :] = True
        out[k, :, : thresholds(hist[k].sum(axis=0), margin=0)[0]] = True
    return out.reshape(-1)


def abnormal_share(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, words, abnormal): words of each text and how many lie in abnormal windows."""
    scored = cut(histograms(docs, key, column, train(docs, column)))
    sums = scored.select(F.explode(F.arrays_zip("cells", "trained")).alias("c")).groupBy("c.cells").agg(F.sum("c.trained").alias("n")).collect()  # CELLS rows at most
    trained = np.zeros(CELLS)
    for cell, n in sums:
        trained[cell] = n
    flags = F.array(*(F.lit(bool(x)) for x in abnormal_cells(trained)))
    counted = F.zip_with("cells", "windows", lambda c, n: F.when(F.get(flags, c), n).otherwise(0))
    return scored.select(key, "words", F.aggregate(counted, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("abnormal"))


def find_spam(docs: DataFrame, key: str, column: str, least: int = LEAST) -> DataFrame:
    """Rows (key): texts of which more than half the words lie in abnormal windows."""
    return abnormal_share(docs, key, column).filter((F.col("words") >= least) & (F.col("abnormal") * 2 > F.col("words"))).select(key)
