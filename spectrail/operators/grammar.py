"""A tokenizer by ordered alternation and a recursive-descent parser of NMR texts, as an Arrow table function.

Grammar: nucleus, header (frequency, solvent, temperature, mixture in any order, in brackets), then shifts with multiplicity, couplings, integration
and assignment in any order in brackets; or blocks of shifts headed by an isomer's name. What doesn't fit is skipped up to the next shift.

Defined results: null, empty and headless texts give a row with an error and no shifts; nothing ends the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DASH = r"[-–—−_]"
_N = r"\d+(?:\.\d+)?"

#: Solvents and their mixtures, longer names first. Fixed values.
SOLVENTS = (
    "CHCl3/CDCl3", "CDCl3 over K2CO3", "CHCl3 with 5% CDCl3", "d8-toluene/CD3CN mixture", "CDCl3 d1", "CDCl3", "CDCL3", "cdcl3", "CHCl3", "CD2Cl2", "Chloroform-d", "CHLOROFORM-D", "chloroform-d",
    "DMSO-d6", "d6-DMSO", "d6DMSO", "DMSO d6", "(CD3)2SO", "DMSO", "dmso", "toluene-D8", "toluene-d8", "Toluene-d8", "tol-D8", "d8-toluene",
    "CD3OD", "MeOH-d4", "MeOD", "methanol-d4", "Methanol-d4", "méthanol-d4", "Méthanol-d4", "d4-methanol", "Et2O", "acetone-d6", "Acetone-d6", "acétone-d6", "ACETONE-D6", "aceton-d6", "Aceton-d6",
    "THF-d8", "d8-thf", "DMF-d7", "Acetic acid-d4", "C6D6", "CD3CN", "Methylene Chloride-d2", "D2O", "Pyridin-d5", "pyridine-d5",
)

#: Kinds of token, tried in this order at every place; other characters are skipped.
TOKENS = (
    ("nucleus", r"(?:\d{1,2}\s*[A-Z][a-z]?(?:\d{1,2}F|\{1H\})?|[HCDF]|[{}]1H\})?\s*-*\s*NMR"),
    ("solvent", "(?:" + "|".join(map(re.escape, SOLVENTS)) + r")(?: \([^()]*\))?"),
    ("temperature", rf"T\s*=\s*{_N}\s*°?\s*[KC]?|{_N}\s*(?:°\s*[KC]|K\b)"),
    ("frequency", rf"{_N},*\s*MHz"),
    ("mixture", r"\((?:as a )?mixture of diastereomers\)|\bmixture of (?:rotamers|diastereomers)|rotameric\b(?! mixtures)|rel\. Me2Se"),
    ("isomer", r"\(?[Mm](?:ajor|inor) (?:rotamer|isomer|diastereomer)\)?,?|[Rr]otameric mixtures?|Signals correspond to (?:keto-tautomer|enol-tautomer|[EZ]-isomer):"),
    ("integration", rf"{_N}\s*H(?!z)|\d\s*[FC](?![a-zA-Z])"),
    ("coupling", rf"\d?J\s*(?:\([^()]*\))?\s*=?\s*{_N}(?:\s*(?:Hz)?\s*[,.]\s*{_N}(?=\s*(?:,|\.(?!\d)|Hz|\))))*\s*(?:Hz)?|{_N}\s*Hz"),
    ("range", rf"\d+\.\d+\s*{_DASH}\s*\d+\.\d+"),
    ("shift", rf"(?:{_DASH}\s*)?\d+\.\d+"),
    ("multiplicity", r"t with further splitting|(?:br\s+)?(?:(?:[dtq]{1,3})?(?:quin(?:tet)?|sept(?:et)?)[dtq]?|sext|sxt|hept|octet|[dtq]{2,5}|[sdtqpm])(?=\s*[,)])|\(br\)|br\b"),
    ("assignment", r"[A-Za-z][A-Za-z0-9=-]*(?:\([A-Za-z0-9=/]*\)[A-Za-z0-9=]*)*"),
    ("delimiter", r"δ[HCF]?(?:\s*/ppm)?|\(ppm\)|[:=]"),
    ("comma", ","),
    ("line_ender", ";"),
    ("open", r"\("),
    ("close", r"\)"),
    ("space", r"\s+"),
)
_MARKS = ("delimiter", "comma", "line_ender")
_PATTERN = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in TOKENS))


def tokenize(text: str, pattern: re.Pattern = _PATTERN) -> list[tuple[str, str]]:
    """(kind, text) of every token but blanks; the pattern's named groups are the kinds, in order of preference."""
    return [(m.lastgroup, m.group()) for m in pattern.finditer(text) if m.lastgroup != "space"]


class _Reader:
    def __init__(self, tokens: list[tuple[str, str]]) -> None:
        self.tokens, self.at = tokens, 0

    def kind(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def take(self, *kinds: str) -> str | None:
        if self.kind() in kinds:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def marks(self) -> None:
        while self.take(*_MARKS):
            pass


def parse(text: str | None) -> dict:
    """nucleus, frequency, solvent, temperature, mixture, shifts (isomer, shift, multiplicity, coupling, integration, assignment), error."""
    out: dict = {"nucleus": None, "frequency": None, "solvent": None, "temperature": None, "mixture": None, "shifts": [], "error": None}
    r = _Reader(tokenize(text or ""))
    while r.kind() not in ("nucleus", None):
        r.at += 1
    if r.kind() is None:
        return out | {"error": "no nucleus"}
    out["nucleus"] = r.take("nucleus").strip()
    r.take("open")
    while (kind := r.kind()) in ("frequency", "solvent", "temperature", "mixture", *_MARKS):
        value = r.take(kind)
        if kind not in _MARKS and out[kind] is None:
            out[kind] = value.strip(" ,")
    r.take("close")
    r.marks()
    if (mixture := r.take("mixture")) is not None and out["mixture"] is None:
        out["mixture"] = mixture
    isomer = None
    while r.kind() is not None:
        r.marks()
        if (name := r.take("isomer")) is not None:
            isomer = name.removeprefix("Signals correspond to ").strip(" (),:")
        elif (shift := r.take("range", "shift")) is not None:
            out["shifts"].append({"isomer": isomer, "shift": shift.strip()} | _details(r))
        else:
            r.at += 1  # on to the next shift
    return out


def _details(r: _Reader) -> dict:
    found: dict = {"multiplicity": None, "coupling": None, "integration": None, "assignment": None}
    if r.take("open") is None:
        return found
    while (kind := r.kind()) in (*found, *_MARKS):
        value = r.take(kind)
        if kind not in _MARKS and found[kind] is None:
            found[kind] = value.strip(" ,")
    r.take("close")
    return found


_SHIFT = "struct<isomer:string,shift:string,multiplicity:string,coupling:string,integration:string,assignment:string>"


def parse_column(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, nucleus, frequency, solvent, temperature, mixture, shifts, error) of all rows."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[column]):
                try:
                    rows.append({key: k} | parse(text))
                except (IndexError, ValueError) as e:
                    rows.append({key: k, "shifts": [], "error": str(e)})
            yield pd.DataFrame(rows, columns=[key, "nucleus", "frequency", "solvent", "temperature", "mixture", "shifts", "error"])

    return df.select(key, column).mapInPandas(run, f"`{key}` {kind}, nucleus string, frequency string, solvent string, temperature string, mixture string, shifts array<{_SHIFT}>, error string")


def shift_rows(parsed: DataFrame, key: str) -> DataFrame:
    """Rows (key, pos, and a shift's members)."""
    return parsed.select(key, F.posexplode("shifts").alias("pos", "s")).select(key, F.col("pos").cast("bigint").alias("pos"), "s.*")
