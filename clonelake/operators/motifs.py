"""K-mer motifs and their enrichment against a reference."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonelake.functions.stats import hypergeometric_tail
from clonelake.functions.text import RESIDUES, flat, portions

#: k-mers of residues up to this length are counted in one array per task; up to the second their codes fit into 64 bits.
DENSE, CODED = 4, 14
#: Letters of which a task holds the codes at once.
HELD = 1_000_000


def kmers(text: Column, k: int) -> Column:
    """All k-mers of a string with overlaps, in order, repeats included."""
    n = F.length(text)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def _spelled(codes: np.ndarray, counts: np.ndarray, k: int) -> pa.RecordBatch:
    """motif, n of k-mers by their codes."""
    digits = np.stack([codes // len(RESIDUES) ** (k - 1 - j) % len(RESIDUES) for j in range(k)], axis=1)
    letters = np.frombuffer(RESIDUES.encode(), dtype=np.uint8)[digits]
    offsets = np.arange(len(codes) + 1, dtype=np.int32) * np.int32(k)
    return pa.record_batch([pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))]), pa.array(counts.astype(np.int64))], names=["motif", "n"])


def _counts(lengths: list[int]):
    """Arrow batches of texts -> motif, n: sums of a task or of portions of it. Texts with other letters than residues are counted one by one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.full(128, -1, dtype=np.int64)
        code[list(RESIDUES.encode())] = np.arange(len(RESIDUES))
        sums = {k: np.zeros(len(RESIDUES) ** k, dtype=np.int64) for k in lengths if k <= DENSE}
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for some in portions(texts, HELD):
                other: Counter[str] = Counter()
                letters, size, place, row = flat(texts[some])
                own = np.where(letters < 128, code[np.minimum(letters, 127)], -1)
                foreign = np.zeros(len(size), dtype=bool)
                foreign[row[own < 0]] = True
                left = np.where(foreign, 0, size)[row] - place  # letters from here to the text's end
                codes = np.zeros(len(own), dtype=np.int64)
                for k in range(1, max(lengths) + 1):
                    if k <= CODED:
                        codes = codes[: len(own) - k + 1] * len(RESIDUES) + own[k - 1 :]
                    if k not in lengths:
                        continue
                    one_by_one = np.flatnonzero(foreign) if k <= CODED else range(len(size))
                    for i in one_by_one:
                        t = texts[some.start + i]
                        other.update(t[j : j + k] for j in range(len(t) - k + 1))
                    if k > CODED:
                        continue
                    found = codes[left[: len(codes)] >= k]
                    if k in sums:
                        sums[k] += np.bincount(found, minlength=len(sums[k]))
                    else:
                        yield _spelled(*np.unique(found, return_counts=True), k)
                if other:
                    yield pa.record_batch([pa.array(list(other), pa.string()), pa.array(list(other.values()), pa.int64())], names=["motif", "n"])
        for k, n in sums.items():
            at = np.flatnonzero(n)
            yield _spelled(at, n[at], k)

    return count


def _counted(seqs: DataFrame, column: str, lengths: list[int]) -> DataFrame:
    return seqs.select(F.col(column).cast("string")).mapInArrow(_counts(lengths), "motif string, n bigint").groupBy("motif").agg(F.sum("n").alias("n"))


def find_motifs(seqs: DataFrame, column: str = "CDR3b", lengths: tuple[int, ...] = (2, 3, 4), min_depth: int | None = None, dotted: bool = False) -> DataFrame:
    """motif, n: occurrences of every k-mer; with ``dotted`` also k fixed residues around one open place.

    ``min_depth`` drops rarer motifs; for dotted ones it binds the (k+1)-mers they come from as well. Tasks count k-mers
    as numbers in numpy: what is shuffled is the number of distinct motifs per task.
    """
    cont = _counted(seqs, column, sorted(set(lengths)))
    if min_depth is not None:
        cont = cont.filter(F.col("n") >= min_depth)
    if not dotted:
        return cont
    wide = _counted(seqs, column, sorted({k + 1 for k in lengths}))
    if min_depth is not None:
        wide = wide.filter(F.col("n") >= min_depth)
    places = F.sequence(F.lit(2), F.length("motif") - 1)
    open_ = wide.filter(F.length("motif") > 2).select(F.explode(F.transform(places, lambda j: F.overlay(F.col("motif"), F.lit("."), j, F.lit(1)))).alias("motif"), "n")
    open_ = open_.groupBy("motif").agg(F.sum("n").alias("n"))
    if min_depth is not None:
        open_ = open_.filter(F.col("n") >= min_depth)
    return cont.unionByName(open_)


def local_fisher(sample: DataFrame, reference: DataFrame, lengths: tuple[int, ...] = (2, 3, 4), dotted: bool = False) -> DataFrame:
    """motif, counts, num_in_ref, avg_ref, ove, p of every motif of the sample.

    sample, reference: distinct sequences with their motif regions ``mr``. Counts are occurrences, compared by the
    hypergeometric tail over the numbers of sequences; where they exceed the sequences the tail's limit is taken.
    """
    found = find_motifs(sample, "mr", lengths, dotted=dotted).withColumnRenamed("n", "counts")
    known = find_motifs(reference, "mr", lengths, dotted=dotted).withColumnRenamed("n", "num_in_ref")
    sizes = sample.agg(F.count("*").alias("ns")).crossJoin(F.broadcast(reference.agg(F.count("*").alias("nr"))))  # one row each
    both = found.join(known, "motif", "left").withColumn("num_in_ref", F.coalesce("num_in_ref", F.lit(0))).crossJoin(F.broadcast(sizes))
    marked = F.col("num_in_ref") + F.col("counts")
    both = both.withColumn("p", hypergeometric_tail(F.col("counts"), marked, F.greatest(F.col("nr") + F.col("ns") - marked, F.lit(0)), F.col("ns")))
    ove = F.col("counts") / (F.col("num_in_ref") + F.lit(0.01)) / F.col("ns") * F.col("nr")
    avg = F.try_divide(F.col("num_in_ref"), F.col("nr")) * F.col("ns")
    return both.select("motif", "counts", "num_in_ref", avg.alias("avg_ref"), ove.alias("ove"), "p")


def least_fold(folds: dict[int, float], motif: Column) -> Column:
    """The least fold change for a motif by its fixed residues; 0 for lengths without one."""
    size = F.length(motif) - F.when(F.contains(motif, F.lit(".")), 1).otherwise(0)
    table = F.create_map(*[F.lit(x) for k, v in folds.items() for x in (int(k), float(v))])
    return F.coalesce(F.try_element_at(table, size), F.lit(0.0))


def select_motifs(motifs: DataFrame, folds: dict[int, float], max_p: float = 0.01, min_depth: int = 3, strict: bool = False) -> DataFrame:
    """Enriched motifs; ``strict``: p must be below the limit, not at it, as in the resampling method."""
    p = F.col("p") < max_p if strict else F.col("p") <= max_p
    return motifs.filter((F.col("ove") >= least_fold(folds, F.col("motif"))) & p & (F.col("counts") >= min_depth))


def motif_members(sequences: DataFrame, motifs: DataFrame, lengths: tuple[int, ...] = (2, 3, 4), dotted: bool = False) -> DataFrame:
    """motif, CDR3b, mr, pos (first place in the region), full_pos (first place in the whole sequence).

    Containment is an equi join on exploded motifs, one row per (sequence, motif); motifs are a short list that AQE
    may broadcast by its measured size.
    """
    every = [kmers(F.col("mr"), k) for k in lengths]
    if dotted:
        for k in lengths:
            if k > 1:
                every += [F.transform(kmers(F.col("mr"), k + 1), lambda m, j=j: F.overlay(m, F.lit("."), j)) for j in range(2, k + 1)]
    rows = sequences.select("CDR3b", "mr", F.explode(F.array_distinct(F.flatten(F.array(*every)))).alias("motif")).join(motifs.select("motif").distinct(), "motif")
    pattern = F.col("motif")
    dot = F.contains(pattern, F.lit("."))
    pos = F.when(dot, F.regexp_instr("mr", pattern)).otherwise(F.expr("locate(motif, mr)"))
    full = F.when(dot, F.regexp_instr("CDR3b", pattern)).otherwise(F.expr("locate(motif, CDR3b)"))
    return rows.select("motif", "CDR3b", "mr", pos.cast("int").alias("pos"), full.cast("int").alias("full_pos"))


def local_pairs(members: DataFrame, position: str = "pos", within: float = 3) -> DataFrame:
    """v1, v2 (v1 < v2), motif: sequences that share a motif at places less than ``within`` apart.

    The places are cut into bands of that width, so the join's key is (motif, band), and a motif that a third of the
    sequences hold is spread over its bands; AQE splits what is left of it.
    """
    width = max(1, int(within))
    left = members.select("motif", F.col("CDR3b").alias("v1"), F.col(position).alias("p1")).withColumn("band", F.floor(F.col("p1") / width))
    right = members.select("motif", F.col("CDR3b").alias("v2"), F.col(position).alias("p2")).withColumn("band", F.explode(F.expr(f"array(floor(p2 / {width}) - 1, floor(p2 / {width}), floor(p2 / {width}) + 1)")))
    pairs = left.join(right, ["motif", "band"]).filter("v1 < v2").filter(F.abs(F.col("p1") - F.col("p2")) < within)
    return pairs.select("v1", "v2", "motif")


def local_links(members: DataFrame, position: str = "pos", within: float = 3) -> DataFrame:
    """v1, v2, motif: as few links as have the same components as local_pairs: neighbours in order of place.

    Each place's sequences hang on their least one, and the least ones of neighbouring places that are near enough are linked.
    """
    from pyspark.sql.window import Window

    heads = members.groupBy("motif", position).agg(F.min("CDR3b").alias("head"))
    stars = members.join(heads, ["motif", position]).select(F.col("head").alias("v1"), F.col("CDR3b").alias("v2"), "motif").filter("v1 <> v2")
    order = Window.partitionBy("motif").orderBy(position)  # a row per place
    steps = heads.withColumn("before", F.lag("head").over(order)).withColumn("gap", F.col(position) - F.lag(position).over(order)).filter(F.col("gap") < within)
    return stars.unionByName(steps.select(F.col("before").alias("v1"), F.col("head").alias("v2"), "motif"))
