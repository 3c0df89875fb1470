"""Text that was decoded with the wrong character encoding: which rows, and the original where it can be restored.

Method: a first pass counts all characters, and the adjacent pairs with a character outside ASCII, over the whole corpus. The pointwise mutual
information of a pair, shrunk for rare characters (each counts as if it had been seen SHRINK of all characters, LEAST times at least, more often), tells how well
two characters keep company. Improbable are a character outside ASCII beside an ASCII one that it avoids, and two characters outside ASCII
that are bound to each other as misread bytes are. The maximum-scoring segments of these scores, less THETA, are the improbable runs of a
text, and nothing outside them is looked at. Inside them inverse mappings are tried:

- to UTF-8: stretches outside ASCII are written as bytes of a code page, and valid sequences read as UTF-8, up to DEEP times;
- from one single-byte page to another: a character, but blanks and soft hyphens, is written as a byte of a Western page and read by any
  other.

An outcome is taken if its characters are Latin letters of the first page or occur in the corpus, and if by the same information it is less
improbable where it stands: by anything for UTF-8, whose sequences are evidence by their form, by MARGIN for single bytes. Replacement
characters and C1 controls in a run can't be restored alone; nor can a lead byte before what was a no-break space, but for "à".

The counts go into tables of fixed size, are summed in each task and by slot after the shuffle, and are broadcast (5 MB at any size).

Defined results: null and empty texts give no row; a text without improbable runs comes out unchanged; equal texts get equal results; texts
are processed whole.
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

#: Code pages that bytes are taken for; fixed values, in the order they are tried.
CODE_PAGES = ("cp1252", "latin-1", "iso8859-15", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp1254", "cp1253", "cp1257", "iso8859-2", "koi8-r", "cp866", "cp852", "mac_cyrillic")
#: Western pages, by which single bytes of other pages are read, and those other pages. Fixed values.
WESTERN = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850")
SINGLE_BYTE = ("cp1252", "mac_roman", "cp437", "cp850", "iso8859-7", "cp1253", "iso8859-2", "cp1250", "cp1251", "koi8-r", "iso8859-5", "cp866", "cp1254", "cp1257")
THETA = 1.0
APART = -2.0  # score of two ASCII characters
SHRINK, LEAST = 1 / 4096, 32
MARGIN = 8.0  # bits
ALSO = 3.0  # by how much THETA is lower in a text in which something was restored
DEEP = 3
PAIRS, SINGLES = 1 << 19, 1 << 16
CHUNK = 1 << 20

_SEQUENCE = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_FAR = re.compile("[^\x00-\x7f]+")
_LOST = re.compile("[\ufffd\x80-\x9f]|[ÂÃ](?=[ \n\r]|$)")
_BLANKED = re.compile("(?<![^ \n\r])Ã(?=[ \n\r])")
_MUL = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def inverse() -> list[dict[str, int]]:
    """For each code page the byte of every character outside ASCII; bytes without a character stand for the control of that number."""
    out = []
    for page in CODE_PAGES:
        table = {}
        for b in range(128, 256):
            c = bytes([b]).decode(page, "replace")
            table[chr(b) if c == "\ufffd" else c] = b
        if page != "latin-1":  # text that went through two tools may mix a code page with plain controls
            for b in range(128, 160):
                table.setdefault(chr(b), b)
        out.append(table)
    return out


@lru_cache(1)
def swaps() -> list[dict[str, str]]:
    """For each pair of a Western and another page what a character outside ASCII was, where that is another one."""
    out = []
    for west in WESTERN:
        for other in SINGLE_BYTE:
            table = {}
            for b in range(128, 256):
                seen, was = bytes([b]).decode(west, "replace"), bytes([b]).decode(other, "replace")
                if seen != was and "\ufffd" not in (seen, was) and ord(was) > 159:
                    table[seen] = was
            if table:
                out.append(table)
    return out


def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a.astype(np.uint64) * np.uint64(0x110000) + b.astype(np.uint64)) * _MUL
    return (h >> np.uint64(45)).astype(np.int64)  # 19 bits


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def count(texts: list[str], pairs: np.ndarray, singles: np.ndarray) -> int:
    """Add the characters, and the adjacent pairs with one outside ASCII, to the tables; gives the number of all characters."""
    points = _points("\n".join(texts))
    singles += np.bincount(points & np.uint32(SINGLES - 1), minlength=SINGLES)
    far = points > 127
    at = np.flatnonzero(far[:-1] | far[1:])
    if len(at):
        pairs += np.bincount(_slots(points[at], points[at + 1]), minlength=PAIRS)
    return len(points)


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal-scoring segments [start, end), of disjoint positive runs none of which can be extended to a higher score."""
    # each candidate: start, end, total before it, total with it
    found: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = (i, i + 1, before, total)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:]
    return [(a, b) for a, b, _, _ in found]


class Repair:
    """Finds and restores misread runs, given the counts of a corpus."""

    def __init__(self, table: np.ndarray) -> None:
        self.pairs, self.singles, self.total = table[:PAIRS], table[PAIRS : PAIRS + SINGLES], max(1, int(table[PAIRS + SINGLES]))
        self.shrink = max(self.total * SHRINK, LEAST)
        self.inverse, self.swaps = inverse(), swaps()
        self.found: dict[str, list[list[tuple[int, int, str]]]] = {}
        self.cache: dict[str, tuple[float, float]] = {}

    def scores(self, points: np.ndarray) -> np.ndarray:
        """How improbable each pair of adjacent characters is."""
        far = points > 127
        at = np.flatnonzero(far[:-1] | far[1:])
        out = np.full(max(0, len(points) - 1), APART)
        if len(at):
            a, b = points[at], points[at + 1]
            n = self.singles[a & np.uint32(SINGLES - 1)] + self.shrink, self.singles[b & np.uint32(SINGLES - 1)] + self.shrink
            information = np.log2((self.pairs[_slots(a, b)] + 0.5) * self.total / (n[0] * n[1]))
            out[at] = np.where((a > 127) & (b > 127), information, -information) - THETA
        return out

    def scored(self, texts: list[str | None]) -> Iterator[tuple[int, str, np.ndarray | None]]:
        """(place, text, scores) of the texts that aren't null; scores is None if none is above 0."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < CHUNK):
                size += len(texts[hi] or "") + 1
                hi += 1
            part = [t or "" for t in texts[lo:hi]]
            scores = self.scores(_points("\n".join(part)))
            ends = np.cumsum([len(t) + 1 for t in part])
            hit = np.zeros(len(part), bool)
            hit[np.searchsorted(ends, np.flatnonzero(scores > 0), "right").clip(0, len(part) - 1)] = True
            for k, t in enumerate(part):
                if texts[lo + k] is not None:
                    # the pairs with the line breaks between texts belong to none
                    start = ends[k] - len(t) - 1
                    yield lo + k, t, scores[start : start + len(t) - 1] if hit[k] and len(t) > 1 else None
            lo = hi

    def improbable(self, text: str, company: bool = False) -> float:
        """The sum of the scores of the pairs of a short text; with company, of how all of them avoid each other."""
        if (known := self.cache.get(text)) is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            points = _points(text)
            scores = self.scores(points)
            far = points > 127
            bound = far[:-1] & far[1:]
            known = self.cache[text] = (float(scores.sum()), float(np.where(bound, -2 * THETA - scores, scores).sum()))
        return known[company]

    def runs(self, text: str, scores: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Improbable runs of characters, [start, end)."""
        if scores is None:
            scores = self.scores(_points(text))
        if not (scores > 0).any():
            return []
        return [(i, j + 1) for i, j in segments(scores.tolist())]

    def _known(self, text: str) -> bool:
        """Latin letters of the first page, and what the corpus holds."""
        return all(ord(c) < 128 or (0xC0 <= ord(c) < 0x100 and c.isalpha()) or (ord(c) not in range(128, 160) and c != "\ufffd" and self.singles[ord(c) & (SINGLES - 1)] > 0) for c in text)

    def by_pages(self, stretch: str, depth: int = DEEP) -> list[list[tuple[int, int, str]]]:
        """For each code page the (start, end, original) of the valid sequences in a stretch outside ASCII."""
        if depth == DEEP and (known := self.found.get(stretch)) is not None:
            return known
        out = []
        for table in self.inverse:
            mine = []
            data = bytes(table.get(c, 0) for c in stretch)
            for m in _SEQUENCE.finditer(data):
                try:
                    text = m.group().decode("utf-8")
                except UnicodeDecodeError:  # a surrogate or an overlong form
                    continue
                if depth > 1 and len(text) > 1:
                    text = self._deeper(text, depth - 1)
                if self._known(text):
                    mine.append((m.start(), m.end(), text))
            out.append(mine)
        if depth == DEEP:
            if len(self.found) > 50_000:
                self.found.clear()
            self.found[stretch] = out
        return out

    def _deeper(self, text: str, depth: int) -> str:
        """A text that came out of an inverse mapping, with what is still misread in it."""

        def one(m: re.Match) -> str:
            return _replaced(m.group(), max(self.by_pages(m.group(), depth), key=lambda parts: (_gain(parts), min((int(self.singles[ord(c) & (SINGLES - 1)]) for _, _, t in parts for c in t), default=0))))

        return _FAR.sub(one, text)

    @staticmethod
    def _touched(text: str, runs: list[tuple[int, int]]) -> list[re.Match]:
        """The stretches outside ASCII that lie in runs, at least in part."""
        inside = np.zeros(len(text) + 1, bool)
        for i, j in runs:
            inside[i:j] = True
        return [m for m in _FAR.finditer(text) if inside[m.start() : m.end()].any()]

    def __call__(self, text: str, scores: np.ndarray | None = None, again: bool = False) -> tuple[bool, str]:
        """Whether the text was misread, and the text with what can be restored."""
        if not (runs := self.runs(text, scores)):
            return False, text
        if not (stretches := self._touched(text, runs)):
            return False, text
        options = [self.by_pages(m.group()) for m in stretches]
        context = [(text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]) for m in stretches]

        def fit(k: int, n: int) -> tuple[int, float]:
            """How many bytes of a stretch a page explains, and how probable the outcome is."""
            parts = options[n][k]
            return (_gain(parts), -self.improbable(context[n][0] + _replaced(stretches[n].group(), parts) + context[n][1])) if parts else (0, 0.0)

        # all of a text was mostly misread in one way
        fits = [[fit(k, n) for n in range(len(stretches))] for k in range(len(self.inverse))]
        votes = [tuple(map(sum, zip(*f))) for f in fits]
        best = votes.index(max(votes))
        out, at, found = [], 0, False
        for n, (m, (before, after)) in enumerate(zip(stretches, context)):
            k = max(range(len(votes)), key=lambda k, n=n: (fits[k][n][0], k == best, fits[k][n][1]))
            if (parts := options[n][k]) and -fits[k][n][1] < self.improbable(before + m.group() + after) + 2 * fits[k][n][0]:
                out.extend((text[at : m.start()], _replaced(m.group(), parts)))
                at, found = m.end(), True
        rest = "".join([*out, text[at:]])
        if found and not again:  # what else was misread in this text needs to be less improbable
            _, rest = self(rest, self.scores(_points(rest)) + ALSO, True)
        inside = np.zeros(len(text) + 1, bool)
        for i, j in runs:
            inside[i:j] = True
        lost = any(inside[m.start()] for m in _LOST.finditer(text))
        if found or lost:  # a lead byte before what was a no-break space
            rest = _BLANKED.sub("à", rest)
        if not found and not lost and not again:
            swapped = self._single_bytes(text, inside)
            return swapped is not None, text if swapped is None else swapped
        return found or lost, rest

    def _single_bytes(self, text: str, inside: np.ndarray) -> str | None:
        """The text with the characters that another single-byte page explains by MARGIN better, all by the same pair of pages."""
        places = [m.start() for m in re.finditer("[\xa0-\uffff]", text) if inside[m.start()] and not m.group().isspace() and m.group() != "\xad"]
        best, most = None, 0.0
        around = [(text[max(0, i - 1) : i], text[i], text[i + 1 : i + 2]) for i in places]
        now = [self.improbable("".join(x), True) for x in around]
        for table in self.swaps:
            new, gain = {}, 0.0
            for i, (before, c, after), old in zip(places, around, now):
                was = table.get(c)
                if was is not None and self.singles[ord(was) & (SINGLES - 1)] and (better := old - self.improbable(before + was + after, True)) >= MARGIN:
                    new[i] = was
                    gain += better
            if gain > most:
                best, most = new, gain
        return None if best is None else "".join(best.get(i, c) for i, c in enumerate(text))


def _gain(parts: list[tuple[int, int, str]]) -> int:
    """Bytes that a page explains."""
    return sum(j - i for i, j, _ in parts)


def _replaced(text: str, parts: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for i, j, new in parts:
        out.extend((text[at:i], new))
        at = j
    return "".join([*out, text[at:]])


def statistics(texts: DataFrame, column: str) -> np.ndarray:
    """The table of counts over all texts; its size doesn't depend on the corpus."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(PAIRS + SINGLES + 1, np.int64)
        for batch in batches:
            values = [t for t in batch.column(0).to_pylist() if t]
            for lo in range(0, len(values), 2000):
                table[-1] += count(values[lo : lo + 2000], table[:PAIRS], table[PAIRS:-1])
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], ["slot", "n"])

    rows = texts.select(column).mapInArrow(scan, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # bounded by the slots
    table = np.zeros(PAIRS + SINGLES + 1, np.int64)
    table[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return table


def repair(texts: DataFrame, keys: list[str], column: str, only_found: bool = True, text: bool = True) -> DataFrame:
    """Rows (keys, misread, restored) of all texts, or of the misread ones only; text=False leaves the texts out."""
    shared = texts.sparkSession.sparkContext.broadcast(statistics(texts, column))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Repair(shared.value)
        for batch in batches:
            at, bad, out = [], [], []
            for i, t, scores in fix.scored(batch.column(len(keys)).to_pylist()):
                found, fixed = fix(t, scores) if scores is not None else (False, t)
                if found or not only_found:
                    at.append(i)
                    bad.append(found)
                    out.append(fixed)
            own = [batch.column(k).take(pa.array(at, pa.int32())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(bad, pa.bool_()), *([pa.array(out, pa.string())] * text)], names)

    names = [*keys, "misread"] + ["restored"] * text
    schema = T.StructType([*(texts.schema[k] for k in keys), T.StructField("misread", T.BooleanType())] + [T.StructField("restored", T.StringType())] * text)
    return texts.select(*keys, column).mapInArrow(scan, schema)
