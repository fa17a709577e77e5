"""Pairs of sequences that differ by few edits, without comparing every sequence with every other.

Method: deletion-variant signatures. Two strings within d edits (replace, insert, remove, swap of neighbours) have a
common string after at most d deletions each. Sequences are cut into m segments such that one of them differs by few
edits, the segments' variants with wildcards (deleted characters) are indexed, equal signatures are joined, and the
candidates are verified by the exact distance.

- Up to 20 residues (d <= 2) there is one segment, the whole sequence, with up to d wildcards. Two segments with one
  wildcard would do for d = 2, but the ends of receptors are conserved: a half of eight residues then shares its
  variants with thousands of others, and candidates grow with the square of the rows.
- From 21 residues on (d >= 3) there are d segments, of which at least one differs by at most one edit even if each
  swap falls on a cut; its one-wildcard variants are compared with those of the other's windows, shifted by up to d.

The join's partitions follow the signature's least k-mer, which most variants of a sequence share, so a sequence goes
to a few tasks only, and the tasks make the variants anew from the sequence: 5 to 15 copies are shuffled
instead of 137 signatures. K-mers are dealt out to tasks by counted load; one that is too heavy for a task is split
further by the signature itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonelake.functions.text import RESIDUES, is_sequence
from clonelake.llm.components import connected_components
from clonelake.session import cut, parallelism

#: Residues per allowed edit.
PER_EDIT = 7
#: From this length on sequences are cut into segments.
LONG = 3 * PER_EDIT
#: Residues at the start and end that are left out when the least k-mer of a signature is sought, and its k.
HEAD, TAIL, K = 3, 4, 3
KMERS = len(RESIDUES) ** K
#: Sequences that a worker turns into signatures at once, and signatures that a task should get.
CHUNK, SHARE = 40_000, 2_000_000
#: Candidate pairs that a task verifies at once.
CANDIDATES = 2_000_000

_CODE = np.full(256, 255, dtype=np.uint8)
_CODE[np.frombuffer(RESIDUES.encode(), dtype=np.uint8)] = np.arange(len(RESIDUES))
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(4096, _BASE, dtype=np.uint64))
_INVERSE = [_U(pow(pow(_BASE, k, 2**64), -1, 2**64)) for k in range(4)]
_LETTER = (np.arange(1, len(RESIDUES) + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)) ^ _U(0xA5A5A5A5DEADBEEF)
#: A pseudo-random order of the k-mers.
_ORDER = np.argsort((np.arange(KMERS, dtype=np.uint64) * _U(0xBF58476D1CE4E5B9)) >> _U(13), kind="stable").argsort().astype(np.int16)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(29))


def _matrix(seqs: np.ndarray) -> np.ndarray:
    """Codes of sequences of one length, a row each."""
    return _CODE[np.frombuffer("".join(seqs).encode("ascii"), dtype=np.uint8).reshape(len(seqs), -1)]


def _whole(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Signatures of whole sequences, with the rank of the least k-mer of each (none for very short variants)."""
    n, size = x.shape
    columns = [np.ascontiguousarray(x[:, i]) for i in range(size)]
    upto = [np.zeros(n, dtype=np.uint64)]
    for i, c in enumerate(columns):
        upto.append(upto[-1] + _LETTER[c] * _POWERS[i])
    ranks: dict[tuple[int, int, int], np.ndarray] = {}

    def rank(t: tuple[int, int, int]) -> np.ndarray:
        if t not in ranks:
            ranks[t] = _ORDER[(columns[t[0]].astype(np.int16) * 20 + columns[t[1]]) * 20 + columns[t[2]]]
        return ranks[t]

    for d in range(size // PER_EDIT + 1):
        for gone in combinations(range(size), d):
            h, at = np.zeros(n, dtype=np.uint64), 0
            for k, g in enumerate([*gone, size]):
                h = h + (upto[g] - upto[at]) * _INVERSE[k]
                at = g + 1
            kept = [i for i in range(size) if i not in gone]
            inner = kept[HEAD:-TAIL] if len(kept) - HEAD - TAIL >= K else kept
            least = None
            for t in zip(inner, inner[1:], inner[2:]):  # noqa: B905
                least = rank(t) if least is None else np.minimum(least, rank(t))
            yield _mixed(h + _U(len(kept))), least


def _segments(x: np.ndarray, longer: list[int]) -> Iterator[np.ndarray]:
    """Signatures of the segments of sequences against partners of the lengths ``longer``."""
    n, size = x.shape
    weights = _LETTER[x]
    for other in longer:
        d = other // PER_EDIT
        if not other - d <= size <= other:
            continue
        cuts = [k * other // d for k in range(d + 1)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            salt = _U((other * 4099 + k + 1) * 0x632BE59BD9B4E019 % 2**64)
            for shift in range(-d, d + 1):
                for wide in (-1, 0, 1):
                    s, e = a + shift, b + shift + wide
                    if s < 0 or e > size or e <= s:
                        continue
                    part = weights[:, s:e]
                    terms = part * _POWERS[: e - s]
                    whole = terms.sum(axis=1, dtype=np.uint64)
                    yield _mixed(whole * _U(3) + salt)
                    if wide >= 0:
                        upto = np.zeros(n, dtype=np.uint64)
                        for i in range(e - s):
                            rest = whole - upto - terms[:, i]
                            yield _mixed((upto + rest * _INVERSE[1]) * _U(3) + salt)
                            upto = upto + terms[:, i]


class Deal:
    """Which task gets a signature: by its least k-mer, and by itself where that is too heavy or missing."""

    def __init__(self, load: np.ndarray, tasks: list[int], share: float):
        """load: signatures per k-mer; tasks: their numbers; share: what one should get."""
        self.tasks = np.array(tasks, dtype=np.int64)
        self.of = np.zeros(KMERS, dtype=np.int64)
        self.split = np.ones(KMERS, dtype=np.int64)
        heap = [(0.0, i) for i in range(len(tasks))]
        for m in np.argsort(-load, kind="stable").tolist():
            if load[m] > share and len(tasks) > 1:
                self.split[m] = min(len(tasks), int(np.ceil(load[m] / share)))
                self.of[m] = m % len(tasks)
            else:
                least, i = heapq.heappop(heap)
                self.of[m] = i
                heapq.heappush(heap, (least + float(load[m]), i))
        self.hot = bool((self.split > 1).any())

    def task(self, keys: np.ndarray, least: np.ndarray | None) -> np.ndarray:
        if least is None:
            return self.tasks[(keys >> _U(40)).astype(np.int64) % len(self.tasks)]
        at = self.of[least]
        if self.hot:
            at = (at + (keys >> _U(40)).astype(np.int64) % self.split[least]) % len(self.tasks)
        return self.tasks[at]


def _by_length(seqs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, sequences) of one length each; those too short for any edit are left out."""
    own = np.array(seqs, dtype=object)
    sizes = np.fromiter(map(len, seqs), dtype=np.int64, count=len(seqs))
    for size in np.unique(sizes):
        if size >= PER_EDIT - 1:
            at = np.flatnonzero(sizes == size)
            yield at, own[at]


def _signatures(x: np.ndarray, longer: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    if x.shape[1] < LONG:
        yield from _whole(x)
    for keys in _segments(x, longer):
        yield keys, None


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    held: list[str] = []
    for batch in batches:
        held += batch.column(0).to_pylist()
        while len(held) >= CHUNK:
            yield held[:CHUNK]
            held = held[CHUNK:]
    if held:
        yield held


def edits(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edits from row to row of two code matrices (rows are pairs); where it is more than ``most``, some number above it.

    Swapped neighbours are one edit and are not edited again. Only the band of ``most`` around the diagonal is computed.
    """
    n, la = a.shape
    lb = b.shape[1]
    far = np.int16(most + 1)
    before, last = {}, {j: np.full(n, j, dtype=np.int16) for j in range(min(lb, most) + 1)}
    for i in range(1, la + 1):
        row: dict[int, np.ndarray] = {}
        for j in range(max(0, i - most), min(lb, i + most) + 1):
            if j == 0:
                row[0] = np.full(n, i, dtype=np.int16)
                continue
            best = np.full(n, far, dtype=np.int16)
            if j - 1 in last:
                best = np.minimum(best, last[j - 1] + (a[:, i - 1] != b[:, j - 1]))
            if j in last:
                best = np.minimum(best, last[j] + np.int16(1))
            if j - 1 in row:
                best = np.minimum(best, row[j - 1] + np.int16(1))
            if i > 1 and j > 1 and j - 2 in before:
                swapped = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(swapped, np.minimum(best, before[j - 2] + np.int16(1)), best)
            row[j] = best.astype(np.int16)
        before, last = last, row
    return last.get(lb, np.full(n, far))


def _pairs_within(seqs: list[str], keys: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of verified pairs among ``seqs``, given signatures and whose they are; CANDIDATES at a time, so pairs may come again.

    Distinct sequences share a signature with g wildcards only if they differ in what those stand for, so that a run
    has at most C(size, g) * 20**g of them, however many sequences there are.
    """
    if not keys:
        return
    bits = max(1, int(len(seqs) - 1).bit_length())
    low = _U((1 << bits) - 1)
    packed = np.concatenate([(k & ~low) | o.astype(np.uint64) for k, o in zip(keys, owners, strict=True)])
    packed.sort()
    key, who = packed & ~low, (packed & low).astype(np.int64)
    ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) if len(key) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(ends, prepend=-1)
    behind = np.repeat(ends, sizes) - np.arange(len(key))  # rows of the same run behind each row
    upto = np.cumsum(behind)
    lengths = np.fromiter(map(len, seqs), dtype=np.int64, count=len(seqs))
    own = np.array(seqs, dtype=object)
    a = 0
    while a < len(key):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CANDIDATES, side="right")))
        n = behind[a:b]
        left = np.repeat(np.arange(a, b), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        both = np.unique(np.minimum(who[left], who[right]) << 32 | np.maximum(who[left], who[right]))
        if len(both):
            yield _verified(own, lengths, both >> 32, both & (2**32 - 1))
        a = b


def _verified(own: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.where(sizes[i] <= sizes[j], i, j), np.where(sizes[i] <= sizes[j], j, i)
    ok = (i != j) & (sizes[j] - sizes[i] <= sizes[j] // PER_EDIT)
    i, j = i[ok], j[ok]
    good = np.zeros(len(i), dtype=bool)
    shape = sizes[i] << 32 | sizes[j]
    for s in np.unique(shape):
        at = np.flatnonzero(shape == s)
        most = int(s & (2**32 - 1)) // PER_EDIT
        for part in np.array_split(at, len(at) // 200_000 + 1):
            good[part] = edits(_matrix(own[i[part]]), _matrix(own[j[part]]), most) <= most
    return i[good], j[good]


def _task_numbers(spark: SparkSession, n: int) -> list[int]:
    """n integers that hash partitioning sends to n different partitions."""
    of = spark.range(n * 40).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"))
    found = {r.p: r.i for r in of.groupBy("p").agg(F.min("i").alias("i")).collect()}
    return sorted(found.values())


def near_pairs(sequences: DataFrame, column: str) -> DataFrame:
    """a, b (a < b): distinct sequences of ``column`` with 7 * edits <= length of the longer one; direct pairs only.

    Only values of the twenty residues' letters take part, so nulls, empty and foreign values give nothing; repeated
    values count once. Values shorter than six residues have no partner, and those of six only ones of seven.
    """
    spark = sequences.sparkSession
    tasks_in = parallelism(spark)
    value = F.col(f"`{column}`")
    own = cut(sequences.filter(value.rlike(rf"\A[{RESIDUES}]{{{PER_EDIT - 1},}}\z")).select(value.alias("s")).distinct().repartition(tasks_in))
    # one number per length that occurs
    lengths = {r.l: r.n for r in own.groupBy(F.length("s").alias("l")).agg(F.count("*").alias("n")).collect()}
    longer = sorted(x for x in lengths if x >= LONG)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KMERS, dtype=np.int64)
        for seqs in _chunks(batches):
            for _, part in _by_length(seqs):
                if len(part[0]) < LONG:
                    for _, least in _whole(_matrix(part)):
                        if least is not None:
                            total += np.bincount(least, minlength=KMERS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["m", "n"])

    counted = np.zeros(KMERS)
    for r in own.mapInArrow(load, "m int, n bigint").groupBy("m").agg(F.sum("n").alias("n")).collect():  # at most KMERS rows
        counted[r.m] = r.n
    n_tasks = max(tasks_in, int(counted.sum() // SHARE) + 1)
    deal = Deal(counted, _task_numbers(spark, n_tasks), max(1.0, 1.5 * counted.sum() / n_tasks))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each sequence once to every task that gets one of its signatures; a task's sequences packed in one value."""
        for seqs in _chunks(batches):
            packs: dict[int, list[str]] = {}
            for _, part in _by_length(seqs):
                to = np.stack([deal.task(keys, least) for keys, least in _signatures(_matrix(part), longer)]).astype(np.int32)
                to.sort(axis=0)
                new = np.ones(to.shape, dtype=bool)
                new[1:] = to[1:] != to[:-1]
                which = np.nonzero(new)[1]
                tasks = to[new]
                order = np.argsort(tasks, kind="stable")
                tasks, which = tasks[order], which[order]
                edges = np.flatnonzero(np.append(True, tasks[1:] != tasks[:-1]))
                for t, at in zip(tasks[edges].tolist(), np.split(which, edges[1:]), strict=True):
                    packs.setdefault(t, []).append("\n".join(part[at]))
            yield pa.record_batch([pa.array(list(packs), pa.int32()), pa.array(["\n".join(x) for x in packs.values()], pa.string())], names=["task", "pack"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[str]] = {}
        for batch in batches:
            for t, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(t, []).append(pack)
        for t in list(held):
            seqs = "\n".join(held.pop(t)).split("\n")
            keys, owners = [], []
            for at, part in _by_length(seqs):
                for s in range(0, len(part), CHUNK):
                    for k, least in _signatures(_matrix(part[s : s + CHUNK]), longer):
                        mine = np.flatnonzero(deal.task(k, least) == t)
                        keys.append(k[mine])
                        owners.append(at[s : s + CHUNK][mine])
            own_ = np.array(seqs, dtype=object)
            for i, j in _pairs_within(seqs, keys, owners):
                a, b = own_[i], own_[j]
                first = np.array([x < y for x, y in zip(a, b, strict=True)], dtype=bool)
                yield pa.record_batch([pa.array(np.where(first, a, b), pa.string()), pa.array(np.where(first, b, a), pa.string())], names=["a", "b"])

    packs = own.mapInArrow(send, "task int, pack string").repartition(n_tasks, "task")
    return packs.mapInArrow(join, "a string, b string").distinct()


def near_groups(sequences: DataFrame, column: str) -> DataFrame:
    """member, grp, links: every distinct valid sequence with its class, the least sequence that links lead to, and its number of links.

    Links are those of ``near_pairs``; a sequence without one is a class of its own.
    """
    pairs = cut(near_pairs(sequences, column))
    links = pairs.select(F.explode(F.array("a", "b")).alias("member")).groupBy("member").agg(F.count("*").alias("links"))
    classes = connected_components(pairs, "a", "b")
    own = sequences.select(F.col(f"`{column}`").alias("member")).filter(is_sequence(F.col("member"))).distinct()
    out = own.join(classes, "member", "left").join(links, "member", "left")
    return out.select("member", F.coalesce("grp", "member").alias("grp"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
