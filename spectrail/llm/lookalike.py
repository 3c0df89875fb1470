"""One consistent form for texts that print alike but are stored with different characters.

Method: characters that print alike have one sign (``by_table``, the table form of a text); words of one table form print alike. The clean
words of the corpus are the vocabulary: those without ignorables, compatibility forms or loose accents, whose letters are of one script. It
is spread by table form and sorted, so that a task builds a trie of at most SHARD words at a time, and every odd word walks that trie with a
weighted edit automaton: look-alikes (full-width forms, look-alike letters, precomposed or not, ligatures, mathematical letters, kinds of
hyphen) and ignorables (zero-width characters, soft hyphens, byte-order marks) cost nothing, any other edit costs one. Of the spellings
within the budget the cheapest wins; of these one in plain characters, then the most frequent, then the first in order. So a Russian word
comes out Russian, though the table would write half of it in Latin letters, and a Latin word with Russian letters comes out Latin. A word
without a match is normalised by the table. Kinds of blank become one blank.

At budget 0, which keeps visible differences apart, two words get one form if and only if they print alike: all words of a table form meet
the same vocabulary. With budget 1 an odd word also takes a spelling that differs by one visible edit. Such a spelling shares the first or
the last half of its table form with the word, so the vocabulary is spread by both halves, and none is missed. Other budgets are refused.

Defined results: null texts give no row; empty texts keep their form; equal texts aren't a pair; line breaks, case, accents, figures, dashes
and the number of blanks are visible and stay. Texts of any length are processed whole.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrail.session import cut

# Letters of other scripts that print like Latin ones, in pairs.
_CYRILLIC = "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw"
_GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo"
_OTHER = "\u2010- \u2011- \ufe63- \u00b5\u03bc \u2206\u0394 \u2215/ \u2044/ \u0261g \u0251a \u0585o"

LOOKALIKE = {pair[0]: pair[1] for pair in f"{_CYRILLIC} {_GREEK} {_OTHER}".split()}
LOOKALIKE |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFF5F)}  # full-width forms
LOOKALIKE |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)}  # ligatures
LOOKALIKE |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2160, 0x2180)}  # Roman numerals
LOOKALIKE |= {c: unicodedata.normalize("NFC", c) for c in "\u212a\u212b\u2126\u037e\u0387\u1fef"}  # letter-like signs with a canonical form
#: Upright mathematical letters and figures print as plain ones; slanted, bold or doubled ones are seen to be others.
LOOKALIKE |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0x1D5A0, 0x1D5D4), *range(0x1D7E2, 0x1D7EC))}


def _precomposed() -> dict[str, str]:
    """Letters with accents whose base letter prints like a Latin one, to the Latin letter with the same accents, if that is one character."""
    out = {}
    for c in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(c))
        if marks and base in LOOKALIKE and not set(marks) & set("\u0313\u0314\u0342\u0345"):
            made = unicodedata.normalize("NFC", LOOKALIKE[base] + "".join(marks))
            if len(made) == 1:
                out[chr(c)] = made
    return out


LOOKALIKE |= _precomposed()
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
IGNORABLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u3164\ufeff\uffa0"
IGNORABLE += "".join(map(chr, [*range(0xFE00, 0xFE10), *range(0xE0001, 0xE0080), *range(0xE0100, 0xE01F0)]))

_TABLE = str.maketrans(LOOKALIKE | dict.fromkeys(IGNORABLE, "") | dict.fromkeys(BLANKS, " "))
_SPACES = str.maketrans(dict.fromkeys(BLANKS, " "))
#: A text that holds anything but plain characters; a Russian letter makes a word odd, as others of its letters may be Latin ones. Characters
#: beyond the first plane are one range, as single ones would make the pattern slow.
_ODD = re.compile("[" + "".join(sorted(c for c in {*LOOKALIKE, *IGNORABLE, *BLANKS} if c < "\U00010000")).replace("-", "\\-") + "\u0300-\u036f\u0400-\u052f\U00010000-\U0010ffff]|\r\n")
_SCRIPTS = {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G"}
SHARD = 50_000  # words of a trie
SALTS = 8


def by_table(text: str) -> str:
    """The table form: look-alikes replaced, ignorables dropped, blanks of one kind, accents composed."""
    return unicodedata.normalize("NFC", text.translate(_TABLE)) if _ODD.search(text) else text


def tokens(text: str) -> list[str]:
    """The words of a text and, between them, its blanks and line breaks; joined they give the text."""
    return re.split(r"([ \n\t\f\v]+)", text.replace("\r\n", "\n").translate(_SPACES))


@lru_cache(1 << 16)
def _script(c: str) -> str:
    return _SCRIPTS.get(unicodedata.name(c, "").partition(" ")[0], "") if c.isalpha() else ""


def is_clean(word: str) -> bool:
    """Whether a word may stand in the vocabulary: composed, without ignorables and compatibility forms, and of one script; Greek letters that
    look like no Latin ones may stand in Latin words, as signs."""
    if not _ODD.search(word):
        return True
    if any(c in IGNORABLE or "\u0300" <= c <= "\u036f" for c in word) or unicodedata.normalize("NFKC", word) != word:
        return False
    scripts = {_script(c) for c in word if c in LOOKALIKE or _script(c) in "LC"} - {""}
    return len(scripts) <= 1 and not any(c in LOOKALIKE and not _script(c) for c in word)


@lru_cache(1 << 16)
def _sign(c: str) -> str:
    """What a character stands for in table forms; nothing for an ignorable."""
    return "" if c in IGNORABLE else LOOKALIKE.get(c, c)


class Trie:
    """Words with their counts; ``spell`` is the weighted edit automaton over it."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, n: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = node.get("", 0) + n

    def spell(self, word: str, budget: int = 0) -> str | None:
        """The best spelling within the budget: the cheapest, a plain one, the most frequent, the first in order.

        The automaton reads the signs of the word. A state is a node, how far the signs are read, and what of the node's last character
        (a ligature stands for several signs) is still due; states of equal cost stay apart, as they spell different words.
        """
        signs = by_table(word)
        # (cost, place, due, node, spelled)
        stack: list[tuple[int, int, str, dict, str]] = [(0, 0, "", self.root, "")]
        seen: dict[tuple[int, int, str], int] = {}
        best: tuple | None = None
        while stack:
            cost, at, due, node, made = stack.pop()
            if cost > budget or (best is not None and cost > best[0]):
                continue
            key = (id(node), at, due)
            if seen.get(key, budget + 1) <= cost:
                continue
            seen[key] = cost
            if due:
                if at < len(signs) and signs[at] == due[0]:
                    stack.append((cost, at + 1, due[1:], node, made))
                if cost < budget:
                    stack.append((cost + 1, at, due[1:], node, made))  # a sign of the spelling that the word lacks
                    if at < len(signs):
                        stack.append((cost + 1, at + 1, due[1:], node, made))
                        stack.append((cost + 1, at + 1, due, node, made))
                continue
            if at == len(signs) and "" in node:
                found = (cost, _ODD.search(made) is not None, -node[""], made)
                best = found if best is None else min(best, found)
            if at < len(signs) and cost < budget:
                stack.append((cost + 1, at + 1, "", node, made))
            for c, below in node.items():
                if c:
                    sign = _sign(c)
                    if cost < budget or not sign or (at < len(signs) and sign[0] == signs[at]):
                        stack.append((cost, at, sign, below, made + c))
        return None if best is None else best[3]


def vocabulary(texts: DataFrame) -> DataFrame:
    """Rows (form, word, odd, n) of the words with letters in all texts: form is the table form, odd whether it holds odd characters.

    Each task counts before anything is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(text.split() if not _ODD.search(text) else (w for w in tokens(text) if w.strip()))
            if len(seen) > 500_000:
                yield emit(seen)
                seen.clear()
        yield emit(seen)

    def emit(seen: Counter[str]) -> pa.RecordBatch:
        rows = [(by_table(w), w, _ODD.search(w) is not None, n) for w, n in seen.items() if not w.isascii() or any(map(str.isalpha, w))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64()))], ["form", "word", "odd", "n"])

    return texts.mapInArrow(scan, "form string, word string, odd boolean, n bigint").groupBy("form", "word", "odd").agg(F.sum("n").alias("n"))


def _halves(words: DataFrame) -> DataFrame:
    """The words under every key (length of the spelling, first or last half) that a spelling one edit away has in common with them."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, asks = [], [], []
            for i, (form, word, odd) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                n = len(form)
                mine = {(m, odd_) for m, odd_ in [(n, False)] * is_clean(word) + [(m, True) for m in (n - 1, n, n + 1)] * odd}
                for m, ask in sorted(mine):
                    h = m // 2
                    for key in (f"{m} {form[:h]}", f"{m} {form[n - (m - h):] if n >= m - h else form}\n"):
                        at.append(i)
                        keys.append(key)
                        asks.append(ask)
            part = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), part.column(1), pa.array(asks, pa.bool_()), part.column(3)], ["form", "word", "odd", "n"])

    return words.select("form", "word", "odd", "n").mapInArrow(spread, "form string, word string, odd boolean, n bigint")


def spellings(words: DataFrame, budget: int = 0) -> DataFrame:
    """Rows (word, spelling) for every odd word.

    Words that print alike share their table form, so the sorted words of a form hold all candidates; tries end between forms.
    """
    if budget not in (0, 1):
        raise ValueError("the budget is 0 or 1")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)))

        trie, odd, held = Trie(), [], 0

        def flush() -> pa.RecordBatch:
            found = [(w, trie.spell(w, budget)) for w in odd]
            out = [(w, s, 0 if s is not None else 1) for w, s in found]
            fixed = [by_table(w) if s is None else s for w, s, _ in out]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _, _ in out], pa.string()), pa.array(fixed, pa.string()), pa.array([m for _, _, m in out], pa.int32())], ["word", "spelling", "missed"])

        for _, group in itertools.groupby(rows(), key=lambda r: r[0]):
            plain = []
            asked = False
            for _, word, ask, n in group:
                if ask:
                    odd.append(word)
                    asked = True
                if (budget == 0 or not ask) and is_clean(word):
                    plain.append((word, n))
            if asked:  # the vocabulary of a form that nobody asks for isn't needed
                for word, n in plain:
                    trie.add(word, n)
                held += len(plain)
            if held + len(odd) > SHARD:
                yield flush()
                trie, odd, held = Trie(), [], 0
        yield flush()

    keyed = words.select("form", "word", "odd", "n") if budget == 0 else _halves(words)
    found = keyed.repartition("form").sortWithinPartitions("form").mapInArrow(resolve, "word string, spelling string, missed int")
    if budget == 0:
        return found.select("word", "spelling")
    # of the answers under several keys: a spelling rather than none, as equal to the word as can be
    form = F.levenshtein("word", "spelling")
    return found.groupBy("word").agg(F.min(F.struct("missed", form.alias("far"), "spelling"))["spelling"].alias("spelling"))


def _pieces(text: str) -> list[dict]:
    """The odd words of a text in order, each with the stretch before it, the last also with what follows it; blanks are of one kind."""
    out: list[dict] = []
    plain: list[str] = []
    for word in tokens(text):
        if _ODD.search(word):
            out.append({"before": "".join(plain), "word": word, "after": ""})
            plain.clear()
        else:
            plain.append(word)
    if out:
        out[-1]["after"] = "".join(plain)
    else:  # only blanks were odd
        out.append({"before": "".join(plain), "word": None, "after": ""})
    return out


def _md5(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def canonical_odd(texts: DataFrame, keys: list[str], column: str, budget: int = 0) -> DataFrame:
    """Rows (keys, raw, canonical) for the texts with odd characters only; all other texts are their own canonical form. raw is a digest.

    Only odd words travel to their spellings, those of a frequent word over SALTS tasks.
    """
    rule = spellings(vocabulary(texts.select(column)), budget)
    piece = pa.struct([("before", pa.string()), ("word", pa.string()), ("after", pa.string())])

    def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(keys)).to_pylist()
            at = [i for i, t in enumerate(values) if t is not None and _ODD.search(t)]
            own = [batch.column(k).take(pa.array(at, pa.int32())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, pa.array([_md5(values[i]) for i in at], pa.binary()), pa.array([_pieces(values[i]) for i in at], pa.list_(piece))], [*keys, "raw", "__words"])

    part = T.StructType([T.StructField(n, T.StringType()) for n in ("before", "word", "after")])
    schema = T.StructType([*(texts.schema[k] for k in keys), T.StructField("raw", T.BinaryType()), T.StructField("__words", T.ArrayType(part))])
    salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int").alias("__salt")
    words = texts.select(*keys, column).mapInArrow(cut_words, schema).select(*keys, "raw", salt, F.posexplode("__words").alias("__pos", "__p")).select(*keys, "raw", "__salt", "__pos", "__p.*")
    salted = rule.select("word", "spelling", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    joined = words.join(salted, ["word", "__salt"], "left")
    made = F.concat("before", F.coalesce("spelling", "word", F.lit("")), "after")
    whole = joined.groupBy(*keys, "raw").agg(F.array_sort(F.collect_list(F.struct("__pos", made.alias("w")))).alias("__all"))
    return whole.select(*keys, "raw", F.array_join(F.transform("__all", lambda x: x["w"]), "").alias("canonical"))


def _plain(texts: DataFrame, keys: list[str], column: str, digest: bool) -> DataFrame:
    """Rows (keys, canonical or its digest as form) for the texts without odd characters. Java's character classes took ten times as long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(keys)).to_pylist()
            at = [i for i, t in enumerate(values) if t is not None and not _ODD.search(t)]
            own = [batch.column(k).take(pa.array(at, pa.int32())) for k in range(len(keys) + (not digest))]
            yield pa.RecordBatch.from_arrays([*own, *([pa.array([_md5(values[i]) for i in at], pa.binary())] if digest else [])], names)

    names = [*keys, "form" if digest else "canonical"]
    last = T.StructField("form", T.BinaryType()) if digest else T.StructField("canonical", T.StringType())
    return texts.select(*keys, column).mapInArrow(scan, T.StructType([*(texts.schema[k] for k in keys), last]))


def _long(texts: DataFrame, key: str, column: str, fld: str) -> DataFrame:
    return texts.select(F.lit(fld).alias("fld"), F.col(key).alias("id"), F.col(column).alias("text")).filter(F.col("text").isNotNull())


def stack(fields: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Rows (fld, id, text) of several (fld, table, key, column)."""
    out = None
    for fld, df, key, column in fields:
        part = _long(df, key, column, fld)
        out = part if out is None else out.unionByName(part)
    return out


def consistent(texts: DataFrame, budget: int = 0) -> DataFrame:
    """Rows (fld, id, canonical) for all rows (fld, id, text)."""
    odd = canonical_odd(texts, ["fld", "id"], "text", budget)
    return _plain(texts, ["fld", "id"], "text", False).unionByName(odd.select("fld", "id", "canonical"))


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c.cast("binary")))


def _forms(texts: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Rows (fld, id, form, raw) of the texts with odd characters, digests of the canonical form and of the text; rows (fld, id, form) of
    the others, whose form is the text itself."""
    odd = cut(canonical_odd(texts, ["fld", "id"], "text", budget).select("fld", "id", _digest(F.col("canonical")).alias("form"), "raw"))
    return odd, _plain(texts, ["fld", "id"], "text", True)


def classes(texts: DataFrame, budget: int = 0) -> DataFrame:
    """Rows (fld, id, class_id, n_rows, n_texts): each text's class of texts with one canonical form, by the smallest id in it, how many rows
    it has and how many different texts. Partial sums make it independent of a class' size."""
    odd, plain = _forms(texts, budget)
    every = odd.unionByName(plain.select("fld", "id", "form", F.col("form").alias("raw")))
    texts_of = every.groupBy("fld", "form", "raw").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    sizes = texts_of.groupBy("fld", "form").agg(F.min("id").alias("class_id"), F.sum("n").alias("n_rows"), F.count("*").alias("n_texts"))
    salt = F.pmod(F.col("id"), F.lit(SALTS)).cast("int")
    salted = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    return every.select("fld", "id", "form", salt.alias("__salt")).join(salted, ["fld", "form", "__salt"]).select("fld", "id", "class_id", "n_rows", "n_texts")


def pairs(texts: DataFrame, budget: int = 0) -> DataFrame:
    """Rows (fld, id_a, id_b), id_a < id_b: texts that differ but have one canonical form.

    One side of every pair has odd characters, so only those rows, few, are matched against all; digests travel instead of texts. The rows of
    a form meet over SALTS tasks. The result has all pairs of a class by its definition; ``classes`` has one row for each text.
    """
    odd, plain = _forms(texts, budget)
    a = odd.select("fld", "form", F.col("id").alias("a"), "raw", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salt = F.pmod(F.col("id"), F.lit(SALTS)).cast("int").alias("__salt")
    with_plain = a.join(plain.select("fld", "form", salt, F.col("id").alias("b")), ["fld", "form", "__salt"])
    with_odd = a.join(odd.select("fld", "form", salt, F.col("id").alias("b"), F.col("raw").alias("raw_b")), ["fld", "form", "__salt"]).filter((F.col("a") < F.col("b")) & (F.col("raw") != F.col("raw_b")))
    ends = (F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    # a text whose odd characters are canonical where they stand (a mark that doesn't compose) may equal a plain one
    return with_plain.filter(F.col("raw") != F.col("form")).select("fld", *ends).unionByName(with_odd.select("fld", *ends))
