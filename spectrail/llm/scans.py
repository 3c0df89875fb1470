"""Text read from scanned pages: which rows carry traces of the page, and continuous text for each.

Method, with statistics over the whole corpus first:

- Lines. A line is at a page's edge if it stands next to a page number or a form feed, or breaks the flow: the next line's first word would
  still have fitted. Line templates (figures masked; fuzzily also with one word left open) that mostly stand at edges and come again are
  running headers and footers.
- Words. The counts of all words are the vocabulary. A word is misread if undoing confusions of the optical reader gives a word that is
  RATIO times as frequent; this is found for all distinct words by a join of the words they may have been with the counts.

All counts are exact and stay tables: nothing is left out for being rare, and no threshold depends on the size of the corpus. The texts ask
their questions (is this line's template a header, is this word one, what was it) by a join; sketches of fixed size keep out the questions
whose answer can only be no.

Then, row by row: page-number lines and header lines are removed; a line that ends in a hyphen is joined to the next, without the hyphen if
the joined word occurs unbroken or its halves don't; other lines are joined by a blank; misread words are replaced, and numbers with letters
in them, a figure in the place of a chemical shift sign and a letter in the place of a coupling sign.

Defined results: null and empty texts give no row; lines broken at blanks only are joined but are no case; a text is processed whole; equal
texts get equal results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrail.session import cut

SLOTS = 1 << 23  # bits of a sketch, 1 MB
SALTS = 8
RATIO = 20
EDGE = 0.5  # share of a template's lines at edges
AGAIN = 3  # lines of a template

#: What the reader takes one for the other, as read and as printed. Fixed values.
CONFUSIONS = tuple(
    tuple(x.split(">"))
    for x in "l>1 I>1 1>l 1>I I>l l>I 0>o 0>O o>0 O>0 Q>O 5>S S>5 8>B B>8 8>3 2>z x>z rn>m cl>d c1>d li>h h>li b>h h>b c>e e>c G>C K>R 1H>H ll>H II>H 1l>H vv>w ii>u u>ii n>u q>g f>t t>f 6>b nn>m in>m".split()
)

_NUMBER = r"[\dOoIlSBZ]"
#: A line that is a page number.
PAGE = re.compile(rf"[ \t]*(?:(?:S-?|p\. ?|- |\[p\. |\[|Page |page |Seite |Página |– )?{_NUMBER}{{1,4}}(?: ?/ ?{_NUMBER}{{1,4}}| (?:of|von|de|sur) {_NUMBER}{{1,4}})?(?:\]| -| –)?)[ \t]*$")
_BARE = re.compile(r"[ \t]*\d{1,4}[ \t]*$")
_HYPHEN = re.compile(r"(?<=[^\W\d_])(?:Ã‚|Ã\x82|ÃƒÂ)?[ÂВ┬¬]?[-¬\xad¡≠‐][ \t]*$")
_UNSEEN = "\u00ad\u200b-\u200f\u2060-\u2064\ufeff"  # characters without print don't end a word
_WORD = re.compile(rf"(?=\d*[^\W\d_])[^\W_]+(?:[{_UNSEEN}]+[^\W_]+)*")
_UNSEEN_RUN = re.compile(f"[{_UNSEEN}]+")
_BREAK = re.compile(r"[ \t]*[\r\n\f]+[ \t]*")
_L = "OoIlSBZ"
_LETTERED = re.compile(rf"(?<![\w.])(?=[\d{_L}.]*\d)(?=[\d.]*[{_L}])[\d{_L}]+(?:\.[\d{_L}]+)?(?!\w)|(?<![\w.])\d*\.(?=\d*[{_L}])[\d{_L}]+(?!\w)|(?<![\w.])[{_L}]+\.\d+(?!\w)")
_LABEL = re.compile(r"\d{1,3}[a-h]")
_INSIDE = re.compile(r"[^\W\d_]{3,}[01]+[a-zà-ÿ]*|[^\W\d_]+[01]+[a-zà-ÿ]{3,}")  # a figure in a word
_SHIFT = re.compile(r"(N[MN][A-Z] ?\((?:[^()]|\([^()]*\))*\):?\s+)([86SB5])(?=\s+(?:\(ppm\)|=|\d))")
_COUPLING = re.compile(r"(?<=, )(?:j'|j|I|T|l|\])(?= = ?[\dOoIlSB])")
_BAR = re.compile(r"(?<=\w)\|(?=\w)")
_FIGURES = str.maketrans("OoIlSBQZ", "00115802")


def lines_of(text: str) -> list[str]:
    """The lines of a text; a form feed stays at the end of its line."""
    return re.sub(r"\r\n?", "\n", text).replace("\f\n", "\f").replace("\f", "\f\n").split("\n")


def template(line: str) -> str:
    return re.sub(r"\d+", "#", line.strip(" \t\f"))


def templates(line: str) -> list[str]:
    """The line's template, and with one word left open each."""
    t = template(line)
    words = t.split()
    out = [t]
    if len(words) > 1:
        out += [" ".join([*words[:i], "*", *words[i + 1 :]]) for i in range(len(words))]
    return out


def _could_be_header(line: str) -> bool:
    s = line.strip(" \t\f")
    letters = sum(c.isalpha() for c in s)
    return bool(s) and letters >= 0.5 * len(s) and sum(len(w) > 2 for w in s.split()) >= 2 and s[0].isupper() and s[-1] not in ".,;:-(" and "=" not in s


def _edges(lines: list[str]) -> tuple[list[bool], list[bool]]:
    """For each line whether it is a page number, and whether it stands at an edge."""
    width = max([len(x.rstrip(" \f")) for x in lines if not _could_be_header(x)] or [0])
    n = len(lines)
    page = [False] * n
    for i, x in enumerate(lines):
        if PAGE.match(x.replace("\f", "")) and x.strip(" \t\f"):
            if _BARE.match(x.replace("\f", "")) and n > 1:
                # a bare number may be a value: it is, first or at the end of an open list
                before = next((y for y in reversed(lines[:i]) if y.strip()), "")
                last = not any(y.strip() for y in lines[i + 1 :])
                page[i] = not (last and before.rstrip()[-1:] in (",", ";", "(", "=", "–", "-"))
            else:
                page[i] = n > 1
    edge = [False] * n
    for i in range(n):
        if page[i] or not lines[i].strip(" \t\f"):
            continue
        near = (i and (page[i - 1] or lines[i - 1].endswith("\f"))) or (i + 1 < n and page[i + 1]) or lines[i].endswith("\f")
        following = next((y for y in lines[i + 1 :] if y.strip()), "").split()
        room = bool(following) and len(lines[i].rstrip(" \f")) + 1 + len(following[0]) <= width
        edge[i] = bool(near or room or len(lines[i].rstrip(" \f")) > width)
    return page, edge


# --- statistics ---------------------------------------------------------------------------------------------------------------------


def _broken(lines: list[str], page: list[bool], passed: list[bool]) -> Iterator[tuple[str, str, str]]:
    """(left, hyphen, right) of each line's end in a hyphen with the words it may go on with: passed lines may be left out."""
    for i, x in enumerate(lines):
        if page[i] or not (m := _HYPHEN.search(x.replace("\f", ""))):
            continue
        left = re.search(r"[^\W\d_]*$", x[: m.start()]).group()
        for j in range(i + 1, len(lines)):
            if page[j]:
                continue
            if lines[j][:1].isalpha():
                yield left, x[m.start()], re.match(r"[^\W\d_]*", lines[j]).group()
            if lines[j].strip() and not passed[j]:
                break


def _has_lines(text: str) -> bool:
    return "\n" in text or "\f" in text or "\r" in text


def statistics(texts: DataFrame, column: str) -> DataFrame:
    """Rows (kind, item, n, edge): kind w for words and their counts, h for line templates, how many lines and how many at edges.

    Halves of words broken at a line's end don't count; the words they may make have a row, with 0 where they occur nowhere as a whole.
    """

    def emit(words: Counter, heads: dict) -> pa.RecordBatch:
        rows = [("w", w, n, 0) for w, n in words.items()] + [("h", t, n, e) for t, (n, e) in heads.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["kind", "item", "n", "edge"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        heads: dict[str, list[int]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                words.update(_WORD.findall(_BAR.sub("l", text)))
                if _has_lines(text):
                    lines = lines_of(text)
                    page, edge = _edges(lines)
                    may = [_could_be_header(x) for x in lines]
                    for left, _, right in set(_broken(lines, page, may)):
                        words[left + right] += 0
                    for left, _, right in _broken(lines, page, [False] * len(lines)):
                        words[left] -= 1
                        words[right] -= 1
                    for x, e, m in zip(lines, edge, may):
                        if m:
                            for t in templates(x):
                                v = heads.setdefault(t, [0, 0])
                                v[0] += 1
                                v[1] += e
            if len(words) + len(heads) > 400_000:
                yield emit(words, heads)
                words.clear()
                heads.clear()
        yield emit(words, heads)

    return texts.select(column).mapInArrow(scan, "kind string, item string, n bigint, edge bigint").groupBy("kind", "item").agg(F.sum("n").alias("n"), F.sum("edge").alias("edge"))


class Sketch:
    """A set of strings as SLOTS bits, whatever their number: those in it are found, and few others while it is sparse. A lookup decides then."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.seen: dict[str, bool] = {}

    def __contains__(self, item: str) -> bool:
        if (known := self.seen.get(item)) is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            k = zlib.crc32(item.encode("utf-8", "surrogatepass")) & (SLOTS - 1)
            known = self.seen[item] = bool(self.bits[k >> 3] >> (k & 7) & 1)
        return known


def sketch(items: DataFrame, column: str) -> np.ndarray:
    """The bits of a Sketch of a column; at most SLOTS numbers come to the driver."""
    slots = items.select(F.crc32(F.col(column).cast("binary")).bitwiseAND(SLOTS - 1).cast("int").alias("k")).distinct().toArrow()["k"].to_numpy()
    bits = np.zeros(SLOTS, np.uint8)
    bits[slots] = 1
    return np.packbits(bits, bitorder="little")


def _undone(word: str) -> Iterator[str]:
    for read, printed in CONFUSIONS:
        i = word.find(read)
        while i >= 0:
            yield word[:i] + printed + word[i + len(read) :]
            i = word.find(read, i + 1)


def corrections(words: DataFrame) -> DataFrame:
    """Rows (word, fixed) for the misread words of rows (item, n), all exactly and by the counts of the whole corpus.

    Undoing one confusion, else two, gives a word that is RATIO times as frequent (the most frequent such, of equals the first in order); or
    a figure in a word, where the word without it isn't that much rarer. A word may have been misread again, up to three times.
    """
    often = words.sparkSession.sparkContext.broadcast(sketch(words.filter(F.col("n") >= RATIO), "item"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Sketch(often.value)
        for batch in batches:
            rows: list[tuple[str, str, int, int]] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(word) < 2 or _LABEL.fullmatch(word):
                    continue
                made = {word: 0}
                for once in _undone(word):
                    made.setdefault(once, 1)
                if len(word) >= 3:
                    for once in [x for x, d in made.items() if d == 1]:
                        for twice in _undone(once):
                            made.setdefault(twice, 2)
                rows.extend((x, word, n, d) for x, d in made.items() if d and x in frequent)
                if _INSIDE.fullmatch(word):
                    rows.append((word.replace("1", "l").replace("0", "o"), word, n, 3))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int32()))], ["item", "word", "own", "steps"])

    made = words.select("item", "n").mapInArrow(scan, "item string, word string, own bigint, steps int")
    own = F.greatest("own", F.lit(1))
    n = F.coalesce("n", F.lit(0))
    good = F.when(F.col("steps") < 3, n >= RATIO * own).otherwise(F.col("own") <= RATIO * F.greatest(n, F.lit(1)))
    best = made.join(words.select("item", "n"), "item", "left").filter(good).groupBy("word").agg(F.min(F.struct("steps", (-n).alias("n"), "item"))["item"].alias("fixed"))
    again = best.select(F.col("word").alias("fixed"), F.col("fixed").alias("further"))
    for _ in range(2):
        best = best.join(again, "fixed", "left").select("word", F.coalesce("further", "fixed").alias("fixed"))
    return best.filter("word != fixed")


def knowledge(texts: DataFrame, column: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows (asked, answer): h and a header's template, w and a word that occurs as a whole, f and a misread word with the right one; and the
    sketches of the templates and of the misread words."""
    stats = cut(statistics(texts, column))
    words = stats.filter("kind = 'w'").select("item", "n")
    heads = stats.filter((F.col("kind") == "h") & (F.col("edge") >= AGAIN) & (F.col("edge") >= EDGE * F.col("n"))).select("item")
    fixes = cut(corrections(words))

    def rows(mark: str, item: str, df: DataFrame, answer: str | None = None) -> DataFrame:
        return df.select(F.concat(F.lit(mark), item).alias("asked"), (F.col(answer) if answer else F.lit("")).alias("answer"))

    answers = rows("h", "item", heads).unionByName(rows("w", "item", words.filter("n > 0"))).unionByName(rows("f", "word", fixes, "fixed"))
    return answers, sketch(heads, "item"), sketch(fixes, "word")


# --- reading ------------------------------------------------------------------------------------------------------------------------


def _lettered(text: str) -> list[re.Match]:
    """Numbers with letters in them, but what goes on behind a character without print."""
    return [m for m in _LETTERED.finditer(text) if not re.search(rf"[\w.][{_UNSEEN}]+$", text[max(0, m.start() - 5) : m.start()]) and not (re.fullmatch(r"S\d+", m.group()) and re.search(r"(?:page|pages|Seite|p\.)\s$", text[max(0, m.start() - 7) : m.start()]))]


def _damaged(text: str) -> bool:
    """Whether a text holds misreadings that need no vocabulary; characters without print don't count."""
    text = _UNSEEN_RUN.sub("", text)
    return bool(_BAR.search(text) or _SHIFT.search(text) or _COUPLING.search(text) or _lettered(text))


def questions(text: str, heads: Sketch, fixes: Sketch, whole: bool) -> tuple[bool, list[str]]:
    """Whether the text carries traces by itself, and what the corpus must be asked; nothing if that is enough and the repair isn't wanted."""
    sure = _damaged(text) or (_has_lines(text) and _damaged(_BREAK.sub(" ", text)))
    asked: set[str] = set()
    if _has_lines(text):
        lines = lines_of(text)
        page, _ = _edges(lines)
        sure |= any(page)
        passed = [False] * len(lines)
        for i, x in enumerate(lines):
            if not page[i] and _could_be_header(x):
                mine = [t for t in templates(x) if t in heads]
                passed[i] = bool(mine)
                asked.update("h" + t for t in mine)
        for left, hyphen, right in _broken(lines, page, passed):
            asked.update("w" + w for w in (left + right, left, right))
            if left + right in fixes:
                asked.add("f" + left + right)
            sure |= hyphen not in "-‐"
    if sure and not whole:
        return True, []
    asked.update("f" + w for w in set(_WORD.findall(_BAR.sub("l", text))) if w in fixes)
    return sure, sorted(asked)


def repaired(text: str, answers: dict[str, str]) -> tuple[bool, str]:
    """Whether the text carries traces of the page, and the text without them, given the answers to its questions."""
    found = False
    if _has_lines(text):
        lines = lines_of(text)
        page, _ = _edges(lines)
        keep = []
        for i, x in enumerate(lines):
            if page[i] or (_could_be_header(x) and any("h" + t in answers for t in templates(x))):
                found = True
            else:
                keep.append(x.replace("\f", ""))
        out = ""
        for x in keep:
            m = _HYPHEN.search(out)
            if m and x[:1].isalpha():
                left = re.search(r"[^\W\d_]*$", out[: m.start()]).group()
                right = re.match(r"[^\W\d_]*", x).group()
                if out[m.start()] not in "-‐" or "w" + left + right in answers or not ("w" + left in answers and "w" + right in answers):
                    found = True
                    out = out[: m.start()] + x
                else:
                    out = out.rstrip() + x
            elif out:
                out = out.rstrip() + " " + x.lstrip()
            else:
                out = x
        text = out.strip() if found else out
    odd = {w for w in _WORD.findall(_BAR.sub("l", text)) if "f" + w in answers}
    found |= bool(odd) or _damaged(text)
    return found, _corrected(text, {w: answers["f" + w] for w in odd}) if found else text


def _corrected(text: str, fixes: dict[str, str]) -> str:
    text = _BAR.sub("l", _COUPLING.sub("J", text))
    out, at = [], 0
    for m in _lettered(text):
        out.extend((text[at : m.start()], m.group().translate(_FIGURES)))
        at = m.end()
    text = "".join([*out, text[at:]])
    if fixes:
        text = _WORD.sub(lambda m: fixes.get(m.group(), m.group()), text)
    return _SHIFT.sub(lambda m: m.group(1) + "δ", text)


def read(texts: DataFrame, keys: list[str], column: str, only_found: bool = True, text: bool = True) -> DataFrame:
    """Rows (keys, scanned, repaired) of all texts, or of those with traces only; text=False leaves the texts out.

    A pass over the texts asks questions, with sketches of fixed size for what can't matter; the texts with questions, few, are written, their
    distinct questions joined with the corpus' answers, and these brought back with the askers of a frequent question spread over SALTS.
    """
    answers, head_bits, fix_bits = knowledge(texts, column)
    shared = texts.sparkSession.sparkContext.broadcast((head_bits, fix_bits))
    key_fields = [texts.schema[k] for k in keys]
    carried = T.StructType([*key_fields, T.StructField("__text", T.StringType()), T.StructField("__sure", T.BooleanType()), T.StructField("__asked", T.ArrayType(T.StringType()))])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, fixes = map(Sketch, shared.value)
        for batch in batches:
            at, kept, bad, all_ = [], [], [], []
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                if t is None:
                    continue
                sure, asked = questions(t, heads, fixes, text)
                if sure or asked or not only_found:
                    at.append(i)
                    kept.append(t if asked or text else None)
                    bad.append(sure)
                    all_.append(asked)
            own = [batch.column(k).take(pa.array(at, pa.int32())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(kept, pa.string()), pa.array(bad, pa.bool_()), pa.array(all_, pa.list_(pa.string()))], carried.names)

    asking = cut(texts.select(*keys, column).mapInArrow(ask, carried))
    salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int").alias("__salt")
    asked = asking.select(*keys, salt, F.explode("__asked").alias("asked"))
    known = asked.select("asked").distinct().join(answers, "asked").select("asked", "answer", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    given = asked.join(known, ["asked", "__salt"]).groupBy(*keys).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("asked", "answer")))).alias("__given"))
    # texts without questions need no join; a question without an answer is answered by that
    with_answers = asking.filter(F.size("__asked") > 0).join(given, keys, "left").select(*keys, "__text", "__sure", "__given")
    alone = asking.filter(F.size("__asked") == 0).select(*keys, "__text", "__sure", F.lit(None).cast("map<string,string>").alias("__given"))
    names = [*keys, "scanned"] + ["repaired"] * text
    schema = T.StructType([*key_fields, T.StructField("scanned", T.BooleanType())] + [T.StructField("repaired", T.StringType())] * text)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bad, out = [], [], []
            k = len(keys)
            for i, (t, sure, given) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(k, k + 3)))):
                found, better = (sure, t) if t is None else repaired(t, dict(given or ()))
                if found or not only_found:
                    at.append(i)
                    bad.append(found)
                    out.append(better)
            own = [batch.column(c).take(pa.array(at, pa.int32())) for c in range(k)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(bad, pa.bool_()), *([pa.array(out, pa.string())] * text)], names)

    return with_answers.unionByName(alone).mapInArrow(answer, schema)
