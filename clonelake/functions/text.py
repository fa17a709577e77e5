"""Column expressions on strings that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space, tab and no-break space: what clean() removes at both ends.
BLANKS = " \t "
#: The twenty residues.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def clean(c: Column | str) -> Column:
    """Without blanks at both ends, in upper case; null stays null."""
    return F.upper(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS)))


def is_sequence(c: Column) -> Column:
    r"""Non-empty and only residues; \z, as $ would let a line break pass. Null gives null."""
    return c.rlike(rf"\A[{RESIDUES}]+\z")


def not_blank(c: Column | str) -> Column:
    """False for null, empty and blank values."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.btrim(c, F.lit(BLANKS)) != "", F.lit(False))


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The letters (code points) of all texts one after the other; the texts' lengths; each letter's place in its text, and its text's in the list."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    row = np.repeat(np.arange(len(texts)), size)
    return letters, size, np.arange(len(letters)) - (np.cumsum(size) - size)[row], row


def portions(texts: list[str], letters: int) -> Iterator[slice]:
    """Parts of the list with about as many letters, one text at least."""
    ends = np.cumsum([len(t) for t in texts])
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + letters, "right")))
        yield slice(at, upto)
        at = upto


def scientific(x: Column) -> Column:
    """A number of 0 or more with two significant digits, as 1.2e-03; halves go up. Null stays null; below 1e-300 it is 0."""
    x = F.when(x >= 1e-300, x).when(x < 1e-300, 0.0)
    exponent = F.floor(F.log10(x))
    digits = F.floor(F.round(F.try_divide(x, F.pow(F.lit(10.0), exponent)), 6) * 10 + 0.5)  # 10 to 100
    exponent, digits = F.when(digits == 100, exponent + 1).otherwise(exponent), F.when(digits == 100, 10).otherwise(digits)
    text = F.concat(F.floor(digits / 10), F.lit("."), digits % 10, F.when(exponent < 0, "e-").otherwise("e+"), F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent))
    return F.when(x == 0, "0.0e+00").otherwise(text)
