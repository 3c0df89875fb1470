"""Peak parsers of 1H, 13C, IR and MS texts as Column expressions; no Python runs for a row.

Numbers outside a test's range are dropped. Null and blank texts give an empty list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spectrail.functions.bind import bind

# Ranges of positions, the merging distance, and the patterns of peaks, multiplicities and couplings.
RANGES = {"1H NMR": (0, 16), "13C NMR": (0, 250), "IR": (400, 4000), "MS": (10, 5000)}
MERGE = 0.05  # shifts of 13C nearer than this to the last kept one are one
_H = r"(\d{1,2}(?:\.\d+)?(?:\s*[–-]\s*\d{1,2}(?:\.\d+)?)?)\s*(?:\(([^)]*)\))?"
_MULTIPLICITY = r"\b(dd|dt|td|dq|qt|tt|s|d|t|q|quin|quint|sext|sept|hept|m)\b"
_COUPLINGS = r"J[^=\d]*=\s*([\d.]+(?:\s*,\s*[\d.]+)*)"


def one_line(text: Column) -> Column:
    return F.trim(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\n"), F.lit(" ")), F.lit("\n"), F.lit(" ")))


def after_delta(text: Column) -> Column:
    """The text behind the first δ, else behind ``NMR...:``, else all of it."""

    def behind(s: Column) -> Column:
        label = bind(F.regexp_extract(s, r"(?i)NMR[^:]*:\s*", 0), lambda head: F.when(head != "", F.substring(s, F.instr(s, head) + F.length(head), F.length(s))).otherwise(s))
        return F.when(F.contains(s, F.lit("δ")), F.substring(s, F.instr(s, "δ") + 1, F.length(s))).otherwise(label)

    return bind(one_line(text), behind)


def frequency(text: Column) -> Column:
    """Of the instrument in MHz, 400 if it isn't named."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)(\d{2,4})\s*MHz", 1), F.lit("")).cast("double"), F.lit(400.0))


def _within(x: Column, kind: str) -> Column:
    lo, hi = RANGES[kind]
    return x.between(float(lo), float(hi))


def proton_peaks(text: Column) -> Column:
    """array<struct<shift, lo, hi, mult, j array<double>, integ, label>>, in the order written; a range has its centre as shift."""

    def peak(shift: Column, info: Column) -> Column:
        return bind(F.transform(F.split(shift, r"\s*[–-]\s*"), lambda x: x.cast("double")), lambda ends: described(ends, info))

    def described(ends: Column, info: Column) -> Column:
        low = F.lower(info)
        mult = F.regexp_extract(low, _MULTIPLICITY, 1)
        return F.struct(
            F.when(F.size(ends) == 2, (ends[0] + ends[1]) / 2).otherwise(ends[0]).alias("shift"),
            F.when(F.size(ends) == 2, F.array_min(ends)).alias("lo"),
            F.when(F.size(ends) == 2, F.array_max(ends)).alias("hi"),
            F.when(mult == "", F.lit(None).cast("string")).when(low.rlike(r"\bbr\b"), F.concat(F.lit("br "), mult)).otherwise(mult).alias("mult"),
            F.transform(F.regexp_extract_all(F.regexp_extract(info, _COUPLINGS, 1), F.lit(r"([\d.]*\d)"), F.lit(1)), lambda x: x.try_cast("double")).alias("j"),
            F.nullif(F.regexp_extract(info, r"(\d+(?:\.\d+)?)\s*H\b", 1), F.lit("")).cast("double").alias("integ"),
            F.trim(info).alias("label"),
        )

    both = bind(after_delta(text), lambda s: F.zip_with(F.regexp_extract_all(s, F.lit(_H), F.lit(1)), F.regexp_extract_all(s, F.lit(_H), F.lit(2)), peak))
    ok = F.filter(both, lambda p: F.when(p["lo"].isNotNull(), _within(p["lo"], "1H NMR") & _within(p["hi"], "1H NMR")).otherwise(_within(p["shift"], "1H NMR")))
    return F.coalesce(ok, F.array().cast("array<struct<shift:double,lo:double,hi:double,mult:string,j:array<double>,integ:double,label:string>>"))


def carbon_shifts(text: Column) -> Column:
    """array<double>, sorted, near-duplicates collapsed onto the last kept shift."""
    found = F.transform(F.regexp_extract_all(after_delta(text), F.lit(r"(\d{1,3}(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    ordered = F.array_sort(F.filter(found, lambda x: _within(x, "13C NMR")))
    return F.aggregate(ordered, F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) == 0) | (F.abs(x - F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))) > MERGE), F.concat(acc, F.array(x))).otherwise(acc))


def ir_bands(text: Column) -> Column:
    """array<struct<wn, intensity, broad, raw>>: bands of the pieces between ; and , with the piece's intensity word; a range is broad."""
    pieces = F.filter(F.transform(F.split(F.lower(one_line(text)), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")

    def bands(raw: Column) -> Column:
        level = F.lit(0.5)
        for word, value in (("w", 0.3), ("m", 0.55), ("s", 0.8), ("vw", 0.2), ("vs", 1.0)):  # the last that fits counts
            level = F.when(raw.rlike(rf"(?<![a-z]){word}(?![a-z])"), F.lit(value)).otherwise(level)
        broad = raw.rlike(r"(?U)\bbr\b|broad")
        pattern = F.lit(r"(\d{3,4}(?:\.\d+)?)(?:\s*[–-]\s*(\d{3,4}(?:\.\d+)?))?")

        def band(a: Column, b: Column) -> Column:
            x, y = a.cast("double"), F.nullif(b, F.lit("")).cast("double")
            ranged = y.isNotNull() & _within(y, "IR")
            return F.struct(F.when(ranged, (x + y) / 2).otherwise(x).alias("wn"), level.alias("intensity"), (F.coalesce(ranged, F.lit(False)) | broad).alias("broad"), raw.alias("raw"), x.alias("first"))

        return F.filter(F.zip_with(F.regexp_extract_all(raw, pattern, F.lit(1)), F.regexp_extract_all(raw, pattern, F.lit(2)), band), lambda x: _within(x["first"], "IR"))

    return F.transform(F.flatten(F.transform(pieces, bands)), lambda x: F.struct(x["wn"].alias("wn"), x["intensity"].alias("intensity"), x["broad"].alias("broad"), x["raw"].alias("raw")))


def ms_peaks(text: Column) -> Column:
    """array<struct<mz, intensity>>: pairs ``mz (int)`` in the order written, else all distinct m/z at 100; base peak 100."""
    return bind(one_line(text), _ms_peaks)


def _ms_peaks(s: Column) -> Column:
    pair = F.lit(r"(\d{2,5}(?:\.\d+)?)\s*\(\s*(\d{1,3})\s*\)")
    pairs = F.filter(F.zip_with(F.regexp_extract_all(s, pair, F.lit(1)), F.regexp_extract_all(s, pair, F.lit(2)), lambda a, b: F.struct(a.cast("double").alias("mz"), b.cast("double").alias("intensity"))), lambda p: _within(p["mz"], "MS"))
    single = F.filter(F.transform(F.regexp_extract_all(s, F.lit(r"(\d{2,5}(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double")), lambda x: _within(x, "MS"))
    equal = F.transform(F.array_sort(F.array_distinct(single)), lambda x: F.struct(x.alias("mz"), F.lit(100.0).alias("intensity")))
    return bind(bind(pairs, lambda p: F.when(F.size(p) > 0, p).otherwise(equal)), base_peak)


def base_peak(peaks: Column) -> Column:
    """Intensities as percent of the highest, unchanged if that is 0."""

    def scaled(top: Column) -> Column:
        return F.transform(peaks, lambda p: F.struct(p["mz"].alias("mz"), F.when(top > 0, p["intensity"] * 100.0 / top).otherwise(p["intensity"]).alias("intensity")))

    return bind(F.array_max(F.transform(peaks, lambda p: p["intensity"])), scaled)


def positions(text: Column, kind: Column) -> Column:
    """The positions of a test's peaks, whatever its type; null for types that aren't parsed."""
    return (
        F.when(F.contains(kind, F.lit("1H NMR")), F.transform(proton_peaks(text), lambda p: p["shift"]))
        .when(F.contains(kind, F.lit("13C NMR")), carbon_shifts(text))
        .when(kind == "MS", F.transform(ms_peaks(text), lambda p: p["mz"]))
        .when(kind == "IR", F.transform(ir_bands(text), lambda p: p["wn"]))
    )


def splitting(shift: Column, mult: Column, j: Column, mhz: Column) -> Column:
    """Line positions of a first-order multiplet: s, m one line; d two; t three; q four; dd four (a missing second coupling is 0.7 of the
    first); others the centre. A missing coupling is 7 Hz; instruments count as 60 MHz at least."""
    m = F.lower(F.trim(mult))
    per = F.greatest(mhz, F.lit(60.0))
    first, second = F.coalesce(F.try_element_at(j, F.lit(1)), F.lit(7.0)) / per, F.try_element_at(j, F.lit(2)) / per
    d1, d2 = first / 2, F.coalesce(second / 2, first / 2 * 0.7)
    double = F.array_sort(F.array_distinct(F.array(shift - d1 - d2, shift - d1 + d2, shift + d1 - d2, shift + d1 + d2)))
    return (
        F.when(mult.isNull() | m.startswith("s") | m.startswith("m"), F.array(shift))
        .when(m.startswith("dd"), double)
        .when(m.startswith("d"), F.array(shift - first / 2, shift + first / 2))
        .when(m.startswith("t"), F.array(shift - first, shift, shift + first))
        .when(m.startswith("q"), F.array(shift - first * 1.5, shift - first * 0.5, shift + first * 0.5, shift + first * 1.5))
        .otherwise(F.array(shift))
    )


def confusion(true: Column, pred: Column, tol: float = 0.01) -> Column:
    """struct<tp, fp, fn>: every predicted peak goes to its nearest true one, the first of equals; a hit if within tol and not taken yet.

    The hits are the distinct nearest true indexes within tol. No true peaks: all zero.
    """

    def hits(true: Column, pred: Column) -> Column:
        def nearest(p: Column) -> Column:
            apart = F.transform(true, lambda t: F.abs(t - p))
            return bind(apart, lambda a: F.when(F.array_min(a) <= tol, F.array_position(a, F.array_min(a))))

        return F.size(F.array_distinct(F.filter(F.transform(pred, nearest), lambda x: x.isNotNull())))

    def counted(t: Column, p: Column, h: Column) -> Column:
        some = F.size(t) > 0
        parts = {"tp": h, "fp": F.size(p) - h, "fn": F.size(t) - h}
        return F.struct(*(F.when(some, v).otherwise(F.lit(0)).cast("bigint").alias(k) for k, v in parts.items()))

    return bind(true, lambda t: bind(pred, lambda p: bind(hits(t, p), lambda h: counted(t, p, h))))


def precision_recall_f1(tp: Column, fp: Column, fn: Column, digits: int | None = None) -> tuple[Column, Column, Column]:
    """0 where a denominator is 0. With digits, all three are rounded, and f1 is taken from the rounded others."""
    rounded = (lambda c: c) if digits is None else lambda c: F.round(c, digits)
    p = rounded(F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)))
    r = rounded(F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)))
    return p, r, rounded(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
