"""Position weight matrices of groups, and new sequences drawn from and ranked by them."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from numbers import Real

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clonelake.functions.stats import draws_from, md5_pairs
from clonelake.functions.text import RESIDUES
from clonelake.operators.dense import numbered
from clonelake.schema import load_reference
from clonelake.session import cut, parallelism

#: Share that a residue gets that a place never shows.
PSEUDO = 0.005
#: Sequences that a task draws at once.
BLOCK = 10_000
#: Rows that a task counts at once, and rows of a group that go to one task.
HELD, PART = 20_000, 1_000_000
_CODES = np.zeros(256, dtype=np.int64)
_CODES[np.frombuffer(RESIDUES.encode(), dtype=np.uint8)] = np.arange(len(RESIDUES))


def _shares(counts: np.ndarray) -> np.ndarray:
    """Shares of the residues (last axis) at each place: unseen ones get PSEUDO, the others share the rest."""
    seen = counts > 0
    missing = len(RESIDUES) - seen.sum(axis=-1, keepdims=True)
    return np.where(seen, counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1) * (1 - missing * PSEUDO), PSEUDO)


def _counted(t: pa.Table, first: int | None) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Group indices (of the table's encoded tags), length (0 without ``first`` being None) and counts: groups, places, residues."""
    tags = t.column("tag").to_numpy()
    seqs = t.column("CDR3b").to_numpy(zero_copy_only=False)
    lengths = np.fromiter(map(len, seqs), dtype=np.int64, count=len(seqs)) if first is None else np.zeros(len(seqs), dtype=np.int64)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        places = int(size) if first is None else first
        letters = np.frombuffer("".join(x[:places] for x in seqs[at]).encode(), dtype=np.uint8).reshape(len(at), places)
        groups, g = np.unique(tags[at], return_inverse=True)
        cells = (g[:, None] * places + np.arange(places)) * len(RESIDUES) + _CODES[letters]
        yield groups, int(size), np.bincount(cells.ravel(), minlength=len(groups) * places * len(RESIDUES)).reshape(len(groups), places, len(RESIDUES))


def _matrices(members: DataFrame, first: int, by_length: bool) -> DataFrame:
    """tag, len, pos, aa, freq: counts by place in tasks that hold whole groups; groups of more than PART rows are split and their counts added up."""
    rows = members.filter(F.length("CDR3b") >= first).select("tag", "CDR3b")
    large = cut(rows.groupBy("tag").agg(F.count("*").alias("n")).filter(F.col("n") > PART).select("tag", F.ceil(F.col("n") / PART).alias("parts")))  # at most rows / PART
    split = large.count() > 0
    if split:
        rows = rows.join(F.broadcast(large), "tag", "left").select("tag", "CDR3b", F.coalesce(F.pmod(F.xxhash64("CDR3b"), "parts"), F.lit(-1)).alias("part"))
    else:
        rows = rows.withColumn("part", F.lit(-1).cast("bigint"))

    def flush(held: list[pa.Table], last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
        t = pa.concat_tables(held).combine_chunks()
        tags = t.column("tag").combine_chunks().dictionary_encode()
        codes = tags.indices.to_numpy()
        part = t.column("part").to_numpy()
        ends = np.flatnonzero(np.append((codes[1:] != codes[:-1]) | (part[1:] != part[:-1]), True))
        n = t.num_rows if last else (int(ends[-2]) + 1 if len(ends) > 1 else 0)  # the last group may go on
        whole = pa.table({"tag": codes[:n], "CDR3b": t.column("CDR3b").slice(0, n)})
        salted = np.zeros(len(tags.dictionary), dtype=bool)
        salted[codes[:n]] = part[:n] >= 0
        for groups, size, counts in _counted(whole, None if by_length else first):
            g, places, k = counts.shape
            names = tags.dictionary.take(pa.array(np.repeat(groups, places)))
            offsets = pa.array(np.arange(0, counts.size + 1, k, dtype=np.int32))
            yield pa.record_batch(
                [
                    names.cast(pa.string()), pa.array(np.full(g * places, size, dtype=np.int32)), pa.array(np.tile(np.arange(1, places + 1, dtype=np.int32), g)), pa.array(np.repeat(salted[groups], places)),
                    pa.ListArray.from_arrays(offsets, pa.array(counts.ravel().astype(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(_shares(counts).ravel())),
                ],
                names=["tag", "len", "pos", "salted", "n", "f"],
            )
        yield t.slice(n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            fresh += batch.num_rows
            if fresh >= HELD:
                *out, rest = flush(held, False)
                yield from out
                held, fresh = [rest], 0
        if held and sum(x.num_rows for x in held):
            yield from list(flush(held, True))[:-1]

    counted = rows.repartition("tag", "part").sortWithinPartitions("tag", "part").mapInArrow(count, "tag string, len int, pos int, salted boolean, n array<bigint>, f array<double>")
    shares = counted.filter("not salted").select("tag", "len", "pos", "f") if split else counted.select("tag", "len", "pos", "f")
    if split:
        sums = counted.filter("salted").groupBy("tag", "len", "pos").agg(F.array(*[F.sum(F.col("n")[i]) for i in range(len(RESIDUES))]).alias("n"))
        total, seen = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, v: a + v), F.size(F.filter("n", lambda v: v > 0))
        f = F.transform("n", lambda v: F.when(v > 0, v / total * (1 - (len(RESIDUES) - seen) * PSEUDO)).otherwise(PSEUDO))
        shares = shares.unionByName(sums.select("tag", "len", "pos", f.alias("f")))
    letters = F.array(*[F.lit(a) for a in RESIDUES])
    return shares.select("tag", "len", "pos", F.posexplode("f").alias("at", "freq")).select("tag", "len", "pos", letters[F.col("at")].alias("aa"), "freq")


def scoring_matrix(members: DataFrame, first: int = 10) -> DataFrame:
    """tag, pos, aa, freq: of the first places of each group's sequences, which must be that long."""
    return _matrices(members, first, False).drop("len")


def prediction_matrix(members: DataFrame, first: int = 10) -> DataFrame:
    """tag, len, pos, aa, freq: all places, for each length in a group."""
    return _matrices(members, first, True)


def length_distribution(members: DataFrame, first: int = 10) -> DataFrame:
    """tag, len, prob."""
    counts = members.filter(F.length("CDR3b") >= first).groupBy("tag", F.length("CDR3b").alias("len")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("tag").agg(F.sum("n").alias("total"))
    return counts.join(totals, "tag").select("tag", "len", (F.col("n") / F.col("total")).alias("prob"))


def generate(members: DataFrame, sims: int, first: int = 10, accept_cf: bool = True) -> DataFrame:
    """tag, seq: distinct sequences drawn from each group's lengths and prediction matrices; with ``accept_cf`` they start with C and end with F.

    A group's lengths and matrices are one small row, which goes to every task that draws a block of its simulations.
    """
    lengths = length_distribution(members, first).groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("len", "prob"))).alias("ls"))
    rows = prediction_matrix(members, first).groupBy("tag", "len").agg(F.array_sort(F.collect_list(F.struct("pos", "aa", "freq"))).alias("fs"))
    matrices = rows.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("len", F.transform("fs", lambda x: x["freq"]).alias("w")))).alias("ms"))
    letters = np.frombuffer(RESIDUES.encode(), dtype=np.uint8)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tag, ls, ms, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                some = range(block * BLOCK, min((block + 1) * BLOCK, sims))
                base = md5_pairs(f"{tag}:{s}" for s in some)
                bounds = np.cumsum([x["prob"] for x in ls])
                which = np.minimum(np.searchsorted(bounds, draws_from(base, np.zeros(1, dtype=np.int64)).ravel(), side="right"), len(ls) - 1)
                seqs = []
                for i, x in enumerate(ms):
                    n, own = x["len"], base[which == i]
                    cum = np.cumsum(np.array(x["w"]).reshape(n, len(letters)), axis=1)
                    u = draws_from(own, np.arange(1, n + 1))
                    text = np.empty((len(own), n), dtype=np.uint8)
                    for k in range(n):
                        text[:, k] = letters[np.minimum(np.searchsorted(cum[k], u[:, k], side="right"), len(letters) - 1)]
                    if accept_cf:
                        text[:, 0], text[:, -1] = ord("C"), ord("F")
                    seqs += [bytes(row).decode() for row in text]
                yield pa.record_batch([pa.array([tag] * len(seqs)), pa.array(seqs, pa.string())], names=["tag", "seq"])

    blocks = lengths.join(matrices, "tag").select("tag", "ls", "ms", F.explode(F.sequence(F.lit(0), F.lit((sims - 1) // BLOCK))).alias("block"))
    return blocks.repartition(parallelism(members.sparkSession), "tag", "block").mapInArrow(draw, "tag string, seq string").distinct()


def score(seqs: DataFrame, column: str, matrix: DataFrame, first: int = 10, by_tag: bool = True) -> DataFrame:
    """``seqs`` with score: the product of the matrix's shares at the first places; of ``tag``, or of the one tag there is."""
    table = matrix.groupBy("tag").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.col("pos").cast("string"), "aa"), "freq"))).alias("w"))  # 20 * first entries
    joined = seqs.join(table, "tag") if by_tag else seqs.crossJoin(F.broadcast(table.drop("tag")))  # one row
    each = F.aggregate(F.sequence(F.lit(1), F.lit(first)), F.lit(1.0), lambda a, i: a * F.coalesce(F.try_element_at("w", F.concat(i.cast("string"), F.substring(F.col(column), i, F.lit(1)))), F.lit(0.0)))
    return joined.withColumn("score", each).drop("w")


def _at_or_above(levels: DataFrame, wanted: DataFrame) -> DataFrame:
    """v, score, above of the wanted (v, score): the sum of n over levels (v, score, n) of the same v with at least that score.

    Levels are sorted by range; ranges are summed up first, so that none is sorted or added up in one task.
    """
    both = levels.unionByName(wanted.select("v", "score", F.lit(0).cast("bigint").alias("n"))).groupBy("v", "score").agg(F.sum("n").alias("n"))
    ranged = cut(both.withColumn("low", -F.col("score")).repartitionByRange("v", "low").withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("range").agg(F.sum("n").alias("n"))
    starts = sums.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row per range
    of_gene = ranged.groupBy("v").agg(F.sum("n").alias("n"))
    bases = of_gene.select("v", F.coalesce(F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row per gene
    upto = F.sum("n").over(Window.partitionBy("range").orderBy("v", "low").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn("upto", upto).join(F.broadcast(starts), "range").join(bases, "v").select("v", "score", (F.col("start") + F.col("upto") - F.col("base")).alias("above"))


def normalised(rows: DataFrame, reference: DataFrame, gene: str | None = None) -> DataFrame:
    """``rows`` (with score) and norm: the share of the reference (score, TRBV) with at least the row's score.

    With ``gene`` only reference rows of the row's gene are counted, out of all; a row without a gene has norm 0.
    """
    v = F.coalesce(F.col(gene), F.lit("")) if gene else F.lit("")
    keyed = rows.withColumn("v", v)
    levels = reference.filter("TRBV is not null AND TRBV <> ''").withColumn("v", F.col("TRBV")) if gene else reference.withColumn("v", F.lit(""))
    above = _at_or_above(levels.groupBy("v", "score").agg(F.count("*").alias("n")), keyed.select("v", "score").distinct())
    total = reference.agg(F.count("*").alias("total"))
    out = keyed.join(above, ["v", "score"]).crossJoin(F.broadcast(total))  # one row
    return out.select(*[F.col(c) for c in rows.columns], (F.col("above") / F.col("total")).alias("norm"))


@dataclass(frozen=True)
class NewSequences:
    """sequences: rank, length, seq, score, [norm,] known (a member has it). members: the members' rows with rank, score and [norm]."""

    sequences: DataFrame
    members: DataFrame
    lengths: DataFrame
    scoring: DataFrame
    prediction: DataFrame


def _ranked(rows: DataFrame, order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def new_sequences(
    members: DataFrame,
    tag: str,
    reference: DataFrame | None = None,
    normalization: bool = False,
    accept_cf: bool = True,
    sims: int = 100_000,
    num_tops: int = 1000,
    min_length: int = 10,
) -> NewSequences:
    """New sequences of one group of a run (members: tag and rows), the best ``num_tops`` of ``sims`` draws, with all that they come from.

    Score: product of the scoring matrix over the first ``min_length`` places. With ``normalization`` sequences are
    ordered by norm, the share of the reference (CDR3b, TRBV) with at least their score; members are compared with
    reference rows of their own V gene, where both have genes. Members shorter than ``min_length`` are left out with a
    warning; if none is left, or the group isn't there, it is an error.
    """
    for name, x in (("sims", sims), ("num_tops", num_tops), ("min_length", min_length)):
        if isinstance(x, bool) or not isinstance(x, Real) or round(x) < 1:
            raise ValueError(f"{name} must be a number of at least 1")
    sims, num_tops, min_length = round(sims), round(num_tops), round(min_length)
    for name, x in (("normalization", normalization), ("accept_cf", accept_cf)):
        if not isinstance(x, bool):
            raise ValueError(f"{name} must be a logical value")
    if not isinstance(tag, str):
        raise ValueError("the tag must be a text")
    group = members.filter(F.col("tag") == tag)
    sizes = group.agg(F.count("*").alias("n"), F.count_if(F.length("CDR3b") >= min_length).alias("long")).first()
    if not sizes.n:
        raise ValueError(f"no group {tag}")
    if not sizes.long:
        raise ValueError(f"no sequence of {tag} has {min_length} residues")
    if sizes.long < sizes.n:
        warnings.warn(f"{sizes.n - sizes.long} sequences of {tag} have less than {min_length} residues", stacklevel=2)
    own = cut(group.filter(F.length("CDR3b") >= min_length))
    matrix = cut(scoring_matrix(own, min_length))
    drawn = score(generate(own, sims, min_length, accept_cf), "seq", matrix, min_length)
    scored = score(own, "CDR3b", matrix, min_length)
    best, firsts = [F.desc("score"), "seq"], [F.desc("score"), "CDR3b"]
    if normalization:
        if reference is None:
            raise ValueError("normalization needs a reference")
        refs = load_reference(reference, accept_cf, min_length, 0).filter(F.length("CDR3b") >= min_length)
        refs = cut(score(refs, "CDR3b", matrix, min_length, by_tag=False).select("TRBV", "score"))
        if refs.isEmpty():
            warnings.warn(f"no reference sequence has {min_length} residues, so nothing is normalised", stacklevel=2)
        else:
            by_gene = "TRBV" in own.columns and not refs.filter("TRBV <> ''").isEmpty()
            if not by_gene:
                warnings.warn("without V genes on both sides norms may be inaccurate", stacklevel=2)
            drawn = normalised(drawn, refs)
            scored = normalised(scored, refs, "TRBV" if by_gene else None)
            best, firsts = ["norm", *best], ["norm", *firsts]
    top = _ranked(drawn.orderBy(*best).limit(num_tops), best)  # num_tops rows
    known = own.select(F.col("CDR3b").alias("seq")).distinct().withColumn("known", F.lit(True))
    norm = ["norm"] if "norm" in drawn.columns else []
    sequences = top.join(known, "seq", "left").select("rank", F.length("seq").alias("length"), "seq", "score", *norm, F.coalesce("known", F.lit(False)).alias("known"))
    # members in order: a group's rows are numbered range by range
    keyed = scored.withColumn("__low", -F.col("score"))
    listed = numbered(keyed, [*norm, "__low", "CDR3b"], "rank").drop("__low")
    return NewSequences(sequences, listed, length_distribution(own, min_length), matrix, prediction_matrix(own, min_length))
