"""Statistics of enrichment, and random numbers that repeat on any cluster and in SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Pairs of different residues whose BLOSUM62 score is 0 or more (Henikoff & Henikoff 1992); each with itself is, too.
SIMILAR = "AC AG AS AT AV RN RQ RE RH RK ND NQ NE NG NH NK NS NT DQ DE DS QE QH QK QM QS EH EK ES GS HY IL IM IF IV LM LF LV KS MF MV FW FY ST TV WY"


def similar_pairs() -> list[str]:
    """All ordered pairs of residues with a BLOSUM62 score of at least 0."""
    from clonelake.functions.text import RESIDUES

    return sorted({x for p in SIMILAR.split() for x in (p, p[::-1])} | {c + c for c in RESIDUES})


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! by Stirling's series, shifted to where it is exact to double precision."""
    x = n.astype(np.float64) + 1
    shift = np.zeros_like(x)
    for _ in range(12):
        small = x < 12
        shift = np.where(small, shift + np.log(np.where(small, x, 1)), shift)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046728 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x - shift


def hypergeometric_tails(c: np.ndarray, m: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """P(X >= c) for X of k draws from m marked and n others; 0 where c can't be reached, 1 where it can't be missed."""
    c, m, n, k = (np.asarray(x, dtype=np.int64) for x in (c, m, n, k))
    low, high = np.maximum(0, k - n), np.minimum(m, k)
    out = np.where(c <= low, 1.0, 0.0)
    todo = np.flatnonzero((c > low) & (c <= high) & (k <= m + n))
    if not len(todo):
        return out
    c, m, n, k, high, low = (x[todo] for x in (c, m, n, k, high, low))
    f = _log_factorial
    base = f(m) + f(n) + f(k) + f(m + n - k) - f(m + n)
    mode = ((k + 1.0) * (m + 1) / (m + n + 2)).astype(np.int64)
    up = c > mode  # sum away from the mode: up from c, or down from c - 1 and take the rest
    x = np.where(up, c, c - 1).astype(np.float64)
    term = np.exp(base - f(x) - f(m - x) - f(k - x) - f(n - k + x))
    total = term.copy()
    live = np.arange(len(x))
    while len(live):
        y, mm, nn, kk = x[live], m[live], n[live], k[live]
        ratio = np.where(up[live], (mm - y) * (kk - y) / ((y + 1) * (nn - kk + y + 1)), y * (nn - kk + y) / ((mm - y + 1) * (kk - y + 1)))
        term[live] *= ratio
        total[live] += term[live]
        x[live] += np.where(up[live], 1, -1)
        live = live[(term[live] > total[live] * 1e-17) & (x[live] < high[live]) & (x[live] > low[live])]
    out[todo] = np.clip(np.where(up, total, 1 - total), 0.0, 1.0)
    return out


@F.pandas_udf(DoubleType())
def _tail(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for c, m, n, k in parts:
        yield pd.Series(hypergeometric_tails(c.to_numpy(), m.to_numpy(), n.to_numpy(), k.to_numpy()))


def hypergeometric_tail(c: Column, m: Column, n: Column, k: Column) -> Column:
    """P(X >= c); applied to aggregated rows (motifs, tags, alleles) only, so the Arrow batches are small."""
    return _tail(*[x.cast("bigint") for x in (c, m, n, k)])


#: A prime; numbers below it multiply without overflow in 64 bits, in numpy, in the JVM and in SQL alike.
PRIME = 2**31 - 1


def _hex(text: str, part: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[8 * part : 8 * part + 8], 16) % PRIME


def md5_number(text: Column, part: int) -> Column:
    """A number below PRIME: the part-th 32 bits (from 0) of the text's md5."""
    return F.conv(F.substring(F.md5(text), 8 * part + 1, 8), 16, 10).cast("bigint") % PRIME


def lines(sims: range) -> np.ndarray:
    """Two random linear maps of each simulation, (a, b, c, d, e, f) a column."""
    return np.array([[_hex(f"{kind}:{s}", part) or 1 for s in sims] for kind in ("low", "high") for part in range(3)], dtype=np.int64)


def ranks(x: np.ndarray, y: np.ndarray, line: np.ndarray) -> np.ndarray:
    """62-bit numbers by which a simulation orders items with the numbers x and y."""
    a, b, c, d, e, f = (int(v) for v in line)
    return (((a * x + b * y % PRIME + c) % PRIME) << 31) | ((d * x + e * y % PRIME + f) % PRIME)


def draws(sims: range, salt: str, start: int, stop: int) -> np.ndarray:
    """Numbers in [0, 1), the ones from place ``start`` (0 is the first) to ``stop`` of each simulation's row.

    They depend on simulation, place and salt only. Two rounds of raising to the fifth power, which permutes the
    numbers below PRIME, begin at an md5 per row.
    """
    return draws_from(md5_pairs(f"{s}:{salt}" for s in sims), np.arange(start + 1, stop + 1, dtype=np.int64))


def md5_pairs(texts: Iterable[str]) -> np.ndarray:
    """Two numbers below PRIME for each text, from its md5."""
    return np.array([[_hex(t, part) for part in (0, 1)] for t in texts], dtype=np.int64).reshape(-1, 2)


def draws_from(base: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1): a row for each pair of ``base``, a column for each place."""
    return _fifth((_fifth((base[:, :1] + places % PRIME * 1_000_003) % PRIME) + base[:, 1:]) % PRIME) / PRIME


def _fifth(t: np.ndarray) -> np.ndarray:
    square = t * t % PRIME
    return square * square % PRIME * t % PRIME
