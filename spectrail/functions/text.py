"""Column functions on texts: cleaning, names, tests, metadata. Null in, null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spectrail.functions.tokens import CHAPTER, ENDERS, ILLEGAL, LABEL_REPAIRS, LINE_NOISE, NAME_TOKENS_FAST, STEREO_MARKS, TAG


def _lit(x: str | Column) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def clean_text(text: Column) -> Column:
    """Line breaks, private bullets and semicolons to blanks, no blanks at the end; ``13C (101 MHz...)`` gets its ``NMR``."""
    return F.regexp_replace(F.rtrim(F.translate(text, "\n;", "   ")), r"13C \(([^)]*MHz[^)]*)\)", "13C NMR ($1)")


def without_noise(text: Column) -> Column:
    for noise in LINE_NOISE:
        text = F.replace(text, F.lit(noise), F.lit(""))
    return text


def name_likelihood(text: Column) -> Column:
    """200 times the name tokens per character; 0 for an empty text."""
    return F.when(F.length(text) > 0, F.lit(200.0) * F.regexp_count(text, F.lit(NAME_TOKENS_FAST)) / F.length(text)).otherwise(F.lit(0.0))


def count_of(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def compound_tag(text: Column) -> Column:
    """The first tag such as (12a), null if there is none."""
    return F.nullif(F.regexp_extract(text, TAG, 0), F.lit(""))


def compound_name(text: Column) -> Column:
    """What stands before the first tag, stripped; null if nothing does."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?s)^(.*?){TAG}", 1)), F.lit(""))


def safe_name(text: Column) -> Column:
    """A name that can be a file name: illegal characters to blanks, no blanks or full stops at the ends."""
    return F.regexp_replace(F.regexp_replace(text, ILLEGAL, " "), r"^[ .]+|[ .]+$", "")


def cut_at_second(text: Column, name: str) -> Column:
    """Ends at the next mention of a test's name, looked for from the 16th character; whole if there is none."""
    at = F.locate(name, text, 16)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)


def cut_at_enders(text: Column, enders: tuple[str, ...] = ENDERS) -> Column:
    """Cut before the first ender of the list that occurs (order of the list, not of the text)."""
    out = None
    for e in enders:
        at = F.instr(text, e)
        cut = F.rtrim(F.substring(text, F.lit(1), at - 1))
        out = F.when(at > 0, cut) if out is None else out.when(at > 0, cut)
    return text if out is None else out.otherwise(text)


def cut_after_bracket(text: Column) -> Column:
    """Cut after the last closing bracket, if what remains has a colon."""
    head = F.regexp_extract(text, r"(?s)^(.*\))", 1)
    return F.when(F.contains(head, F.lit(":")), head).otherwise(text)


def trim_left_junk(text: Column) -> Column:
    """Drops the first word through the last of its first ``.``, ``;`` and ``)``."""
    first = F.substring_index(text, " ", 1)
    at = F.greatest(*(F.instr(first, c) for c in (".", ";", ")")))
    return F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text)


def delete_marks(text: Column, notes: tuple[str, ...] = ()) -> Column:
    return F.regexp_replace(text, "|".join([CHAPTER, STEREO_MARKS, *notes]), "")


def repair_labels(text: Column) -> Column:
    """Labels of tests as optical readers and typesetters spoil them (LABEL_REPAIRS): what stands before the last label of a line goes, an
    upper-case multiplicity before a coupling is lower-case."""
    out = text
    for pattern, label in LABEL_REPAIRS:
        out = F.regexp_replace(out, pattern, label)
    for m in "STDQ":
        out = F.regexp_replace(out, rf"{m}(\s*,\s*J\s*=)", f"{m.lower()}$1")
    return out


def test_type(name: Column, text: Column) -> Column:
    """The type that a test's text names: of NMR the text through its first R, MS for names with MS, else the name."""
    return F.when(F.contains(name, F.lit("NMR")), F.substring(text, F.lit(1), F.instr(text, "R"))).when(F.contains(name, F.lit("MS")), F.lit("MS")).otherwise(name)


def normal_type(kind: Column) -> Column:
    """Any type with 13C and NMR is 13C NMR."""
    return F.when(F.contains(kind, F.lit("13C")) & F.contains(kind, F.lit("NMR")), F.lit("13C NMR")).otherwise(kind)


def same_type(gt: Column, other: Column) -> Column:
    """Whether types match: for 13C NMR any NMR does."""
    return F.when(gt == "13C NMR", F.contains(other, F.lit("NMR"))).otherwise(gt == other)


def without_brackets(text: Column) -> Column:
    """One level of (...), then of [...], removed."""
    return F.regexp_replace(F.regexp_replace(text, r"\([^()]*\)", ""), r"\[[^\[\]]*\]", "")


def first_number(text: Column) -> Column:
    """The first number as text; "0" of an empty text, "-999.0" if there is none."""
    found = F.regexp_extract(text, r"\d+(?:\.\d+)?", 0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("0")).when(found == "", F.lit("-999.0")).otherwise(found)


def plain_peaks_text(text: Column) -> Column:
    """The text of a test without brackets, units and label, its commas spaced."""
    s = without_brackets(text)
    s = F.replace(F.replace(F.replace(s, F.lit("\n"), F.lit(" ")), F.lit("cm-1"), F.lit("")), F.lit("–"), F.lit("-"))
    s = F.replace(F.replace(s, F.lit(", "), F.lit(",")), F.lit(","), F.lit(", "))
    s = F.regexp_replace(F.trim(s), r"\.+$", "")
    s = F.regexp_replace(s, r"13C$", "")
    at = F.instr(s, "NMR")
    return F.trim(F.when((at > 0) & (at + 2 <= F.length(s) - 10), F.substring(s, at + 3, F.length(s))).otherwise(s))


def peak_strings(text: Column) -> Column:
    """The peaks of a test as strings, split at commas and hyphens."""
    return F.transform(F.flatten(F.transform(F.split(plain_peaks_text(text), ","), lambda p: F.split(p, "-"))), first_number)


def ms_or_all(text: Column, kind: Column) -> Column:
    """Peaks as numbers; of a mass text with ``found`` only those behind it."""
    tail = F.substring(text, F.instr(text, "found") + 5, F.length(text))
    source = F.when((kind == "MS") & F.contains(text, F.lit("found")), tail).otherwise(text)
    return F.transform(peak_strings(source), lambda x: x.cast("double"))


#: Labelled headings of a document. Fixed values.
METADATA_LABELS = {"title": "Title|Thesis Title", "author": "Author|Candidate", "university": "University|Institution", "year": "Year|Date", "subject": "Subject|Discipline"}


def labelled(text: Column, key: str) -> Column:
    value = r"(\d{4})" if key == "year" else r"([^\n]*)"
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?i)(?:{METADATA_LABELS[key]}):\s*{value}", 1)), F.lit(""))


def decimals(text: Column) -> Column:
    """Digits behind the decimal point of a number written as text."""
    return F.length(F.regexp_extract(text, r"^-?\d+\.(\d+)$", 1))
