"""Fixed values and patterns of compound names, tests and cleaning."""

from __future__ import annotations

# Name fragments in order of alternation, longer ones first.
FRAGMENTS = (
    "carboxylate", "phosphate", "isopropyl", "azetidin", "methoxy", "benzene", "methane", "propane", "uronium", "ethane", "phenyl",
    "chloro", "fluoro", "methyl", "propan", "benzyl", "hydryl", "thione", "sodium", "butan", "butyl", "hydro", "carbo", "tetra", "allyl",
    "sulfo", "azete", "amido", "pival", "olate", "thio", "tert", "benz", "nate", "piva", "late", "loyl", "azin", "hexa", "ace", "tri",
    "oxy", "oxo", "one", "hyl", "ane", "ate", "tol", "tyl", "bis", "nyl", "ol", "di", "en", "yl",
)
# Locants and stereo descriptors.
LOCANTS = r"-\d+,\d+,\d+-|-\d+,\d+-|-\d+-|\d+-|-\d+"
STEREO = r"\(\d*S\)|\(\d*R\)|\(\d*E\)|\(\d*Z\)"

NAME_TOKENS = "|".join([*FRAGMENTS, *(f.capitalize() for f in FRAGMENTS), LOCANTS, STEREO])



def _fast() -> str:
    """The same matches as NAME_TOKENS in a form that fails fast: alternatives sorted by first letter, letters halved by a look-ahead.

    Alternatives of one first letter keep their order, and others can't match at the same place, so the outcome is the same.
    """
    by_letter: dict[str, list[str]] = {}
    for f in [*FRAGMENTS, *(f.capitalize() for f in FRAGMENTS)]:
        by_letter.setdefault(f[0], []).append(f[1:])

    def tree(letters: list[str]) -> str:
        if len(letters) <= 2:
            return "|".join(f"{c}(?:{'|'.join(by_letter[c])})" for c in letters)
        half = len(letters) // 2
        return "|".join(f"(?=[{''.join(part)}])(?:{tree(part)})" for part in (letters[:half], letters[half:]))

    small, capital = (sorted(c for c in by_letter if test(c)) for test in (str.islower, str.isupper))
    return f"(?=[a-z])(?:{tree(small)})|(?=[A-Z])(?:{tree(capital)})|(?=[-0-9])(?:{LOCANTS})|{STEREO}"


NAME_TOKENS_FAST = _fast()

#: Left out of a line before its statistics: section words and one axis label. Fixed values.
LINE_NOISE = ("Experimental", "experimental", "10.09.08.07.06.05.04.03.02.01.00.0-1.0")
#: A compound's tag, such as (12a).
TAG = r"\(\d+[A-Za-z]?\)"
#: Characters that file systems don't take, and controls.
ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'

#: Test families that are searched for, and what ends a test's text, in the order tried. Fixed values.
TEST_FAMILIES = ("NMR", "IR", "Rf", "HRMS")
ENDERS = ("NMR", "IR", "Rf", "HRMS", "HPLC", "ESI-MS")
TEST_TYPES = ("1H NMR", "13C NMR", "IR", "MS")

#: Deleted from texts: chapter headings with page numbers, stereo marks. Corpus notes can be passed in besides. Fixed values.
CHAPTER = r"\s*(?:CHAPTER|Chapter)\s*\d\s*:?\s*(?:EXPERIMENTAL|Experimental)?\s*\d+|\s*Experimental\s*\d+|Experimental-\d+-"
STEREO_MARKS = r"\(R\)|\(S\)|\(cis\)|\(trans\)"

#: Colours of test types in annotation projects. Fixed values.
COLOURS = ("#FFD700", "#FFB14E", "#FA8775", "#EA5F94", "#CD34B5", "#9D02D7", "#0000FF", "#7695FF")

#: What readers and typesetters make of labels, what stands before them, and notes of one corpus, with what they become, in the order tried.
#: Fixed values.
LABEL_REPAIRS = (
    (r"\[1H\]\s*NMR|\d+%*\)\.*1H NMR|\);1H NMR|\d+\.1H NMR|°\)1H NMR|lH NMR|21H NMR|\(13\):1H NMR", "1H NMR"),
    (r"^.*1H NMR", "1H NMR"),
    (r"19F\(H\) NMR", "19F NMR"),
    (r"^.*19F NMR", "19F NMR"),
    (r"H-\d+\);*13C NMR|\d+H\)[;.]*13C NMR|H\d+\)\.*13C NMR|13C\}1H\} NMR|141 NMR", "13C NMR"),
    (r"^.*13C NMR", "13C NMR"),
    (r"O10298OOOTBS3142Appendix A:| 43NH 51016OO1112678Me92Me\d+| 1211OO1610NH 53417Me182Me\d+|N OCO2allylCO2MeN|NMeO2CONMeO2CO2N\d+|OCO2allylCO2MeO\d+|Ph2SiHOPh2SiOPh2SiOH\d+|61    ", "/)"),
)
