"""Rules by which freely typed names of beta V genes are read: spellings of the locus, alleles, slips, other loci."""

from __future__ import annotations

import re
import unicodedata

from clonelake.llm.canonical import Rules, edits

#: Spellings of the beta V locus that may stand before a number.
BETA_V = ("TRBV", "TCRBV", "TCRVB", "TCR VB", "TCR BV", "HTRBV", "BV", "VB", "V", "VBETA", "V BETA", "BETA V", "BETA CHAIN V", "V BETA CHAIN", "TRB V", "TCRB V", "VB CHAIN")
#: Spellings long enough to bear a slip.
LONG = ("TRBV", "TCRBV", "HTRBV", "VBETA")
#: Names of other loci and segments, which are never a slip for the beta V locus.
OTHER = frozenset(
    [a + s for a in ("TRA", "TRG", "TRD", "IGH", "IGK", "IGL", "TCRA", "TCRG", "TCRD") for s in ("", "V", "J", "D", "C")]
    + [a + s for a in ("TRB", "TCRB") for s in "JDC"]
    + ["AV", "GV", "DV", "AJ", "BJ", "BD", "BC", "HV", "KV", "LV", "VA", "VG", "VD", "VH", "VK", "VL", "JB", "DB", "CB", "ALPHA", "GAMMA", "DELTA", "VALPHA", "VGAMMA", "VDELTA", "D", "J", "C"]
)
#: Letters of other scripts that look like Latin ones, and the Greek letter that stands for the locus.
LOOKS = str.maketrans("АВЕКМНОРСТХУІЅѴΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEKMHOPCTXYISVABEZHIKMNOPTYX")
DASHES = str.maketrans(dict.fromkeys("‐‑‒–—―−﹘﹣－~", "-"))
#: Letters typed for digits.
DIGITS = str.maketrans("OQIL|!", "001111")


def normalised(value: str) -> str:
    """Upper-case Latin letters, plain digits, one kind of dash; alleles gone; numbers as 7-2 right behind their letters."""
    s = unicodedata.normalize("NFKC", value).upper().translate(LOOKS).translate(DASHES)
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c) and (c.isprintable() or c.isspace()))
    s = re.sub(r"\s+", " ", s).strip()
    s = re.sub(r"\*\s*[\dOIL]+[A-Z]?\b", " ", s)  # allele
    s = re.sub(r"(?<![A-Z0-9])((?:[A-Z0-9] ){2,}[A-Z](?![A-Z]))", lambda m: m[1].replace(" ", ""), s)  # T R B V
    s = re.sub(r"(?<=[A-Z])8(?=[A-Z])", "B", s)
    s = s.replace("W", "V") if re.search(r"\b[TCRBH]{1,5}W", s) else s
    s = re.sub(r"(?<=[VB\d\-])[OQIL|!\d]*[OQIL|!](?=[\d\-_. ;,)?]|$)[OQIL|!\d]*", lambda m: m[0].translate(DIGITS), s)
    s = re.sub(r"(?<=V)[OQIL|!](?=\d)", lambda m: m[0].translate(DIGITS), s)
    s = re.sub(r"(?<=\d)[OQIL|!]+(?=[\d\-]|$|\W)", lambda m: m[0].translate(DIGITS), s)
    s = re.sub(r"([A-Z])\s*[:_./#\-]*\s*(?=\d)", lambda m: m[1], s)  # TRBV: 7, TRBV-7
    s = re.sub(r"(?<=\d)\s*[\-./_:S ]\s*(?=\d)", "-", s)
    return re.sub(r"(?<!\d)0+(?=\d)", "", s)


_NAME = re.compile(r"([A-Z]+(?: [A-Z]+)*?) ?(\d+(?:-\d+)?)")
_GROUP = re.compile(r"(?<![A-Z0-9])([A-Z]+(?: [A-Z]+)*?) ?(\d+(?:-\d+)*)(?![A-Z\d])")


def _parts(name: str) -> tuple[str, str] | None:
    """Locus and number of an entry of the beta V locus."""
    m = _NAME.fullmatch(normalised(name))
    return (m[1], m[2]) if m and m[1] in BETA_V else None


def _spellings(name: str) -> list[str]:
    """Every spelling of the locus before the number; an entry of another kind has its own spelling only."""
    parts = _parts(name)
    return [locus + parts[1] for locus in BETA_V] if parts else [normalised(name)]


def _entry(name: str) -> list[str]:
    parts = _parts(name)
    return ["TRBV", parts[1]] if parts else normalised(name).split()


def _alone(s: str, start: int, end: int) -> bool:
    """No letter or digit before or behind, and no number part behind."""
    behind = s[end : end + 2]
    return not (s[start - 1 : start].isalnum() or behind[:1].isalnum() or re.match(r"-\d", behind))


def _refused(s: str, mentioned: list[str]) -> bool:
    """Does the value name another locus, or a number that no mention covers?"""
    words = re.findall(r"[A-Z]+", s)
    if any(w in OTHER and re.search(rf"(?<![A-Z]){w}(?: CHAIN)?(?: ?V| ?J)? ?\d", s) for w in words):
        return True
    if not mentioned:
        return False
    if any(w in ("ALPHA", "GAMMA", "DELTA", "TRA", "TRG", "TRD", "IGH", "IGK", "IGL") for w in words):
        return True
    covered = {n for m in mentioned for n in re.findall(r"\d+(?:-\d+)?$", m)}
    return any("-" in n and n not in covered for n in re.findall(r"\d+(?:-\d+)*", s))


def _groups(s: str) -> list[list[str]]:
    """Letters and the number right behind them, where the letters may be the locus; further numbers make the value unclear."""
    found = [[m[1].split(" ")[-1], m[2]] for m in _GROUP.finditer(s)]
    found = [g for g in found if _alike(g[0], "TRBV")]
    return found if len(re.findall(r"\d+(?:-\d+)*", s)) == 1 or not found else [*found, ["TRBV", ""]]


def _alike(typed: str, token: str) -> float:
    """1 for equal numbers and for spellings of the locus, less for a slip in one of those, 0 for other loci."""
    if token != "TRBV":
        return float(typed == token)
    if typed in OTHER:
        return 0.0
    if typed in BETA_V:
        return 1.0
    return 0.75 if len(typed) > 2 and min(edits(typed, x) for x in LONG) <= 1 else 0.0


def _near(typed: str) -> list[str]:
    return ["TRBV"] if _alike(typed, "TRBV") else [typed]


#: Family and member number decide; letters may have a slip. A number that is not listed is no entry's.
BETA = Rules(normalised, _spellings, _entry, _alone, _refused, _groups, _near, _alike, lambda token, rarity: 1.0, 0.85, closed=True)
