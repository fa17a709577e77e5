"""Global similarity: Hamming pairs and one-place structures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonelake.functions.stats import similar_pairs
from clonelake.functions.text import flat, portions
from clonelake.session import cut, parallelism

#: Structures whose hashes a task holds before it sends them.
HELD = 1_000_000


def wildcards(text: Column, most: int) -> Column:
    """The string with up to two places replaced by %, one variant per choice of ``most`` places."""
    n = F.length(text)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.overlay(text, F.lit("%"), i, F.lit(1)))
    if most == 1:
        return F.when(n >= 1, one).otherwise(F.array().cast("array<string>"))
    two = F.flatten(
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.overlay(F.overlay(text, F.lit("%"), i, F.lit(1)), F.lit("%"), j, F.lit(1))))
    )
    return F.when(n >= 2, two).otherwise(one)


def hamming_pairs(seqs: DataFrame, most: int = 1, vgenes: DataFrame | None = None) -> DataFrame:
    """v1 < v2 of distinct sequences (CDR3b, mr) whose regions have one length and differ in at most ``most`` places.

    0: equal regions. 1 and 2: equal variants with as many wildcards, so that the work grows with the rows and not
    their square. More: equal blocks by the pigeonhole principle, then verified. ``vgenes`` (CDR3b, TRBV): only pairs that share one.
    """
    base = seqs.filter("mr <> ''")
    if most == 0:
        keyed = base.select("CDR3b", "mr", F.array("mr").alias("keys"))
    elif most <= 2:
        keyed = base.select("CDR3b", "mr", wildcards(F.col("mr"), most).alias("keys"))
    else:
        n, parts = F.length("mr"), most + 1
        blocks = [
            F.concat_ws(":", n, F.lit(b), F.substring("mr", F.floor(n * b / parts).cast("int") + 1, F.floor(n * (b + 1) / parts).cast("int") - F.floor(n * b / parts).cast("int")))
            for b in range(parts)
        ]
        keyed = base.select("CDR3b", "mr", F.array(*blocks).alias("keys"))
    # keys are hashed, which makes rows and sorts small; pairs are verified below, so a collision does no harm
    rows = keyed.select("CDR3b", "mr", F.explode(F.transform("keys", lambda k: F.xxhash64(k))).alias("key"))
    left, right = rows.withColumnsRenamed({"CDR3b": "v1", "mr": "m1"}), rows.withColumnsRenamed({"CDR3b": "v2", "mr": "m2"})
    pairs = left.join(right, "key").filter("v1 < v2")
    differ = F.aggregate(F.sequence(F.lit(1), F.length("m1")), F.lit(0), lambda a, i: a + F.when(F.substring(F.col("m1"), i, F.lit(1)) != F.substring(F.col("m2"), i, F.lit(1)), 1).otherwise(0))
    pairs = pairs.filter((F.length("m1") == F.length("m2")) & (differ <= most))
    pairs = pairs.select("v1", "v2").distinct()
    if vgenes is not None:
        sets = vgenes.filter("TRBV is not null").groupBy("CDR3b").agg(F.collect_set("TRBV").alias("g"))
        pairs = pairs.join(sets.withColumnsRenamed({"CDR3b": "v1", "g": "g1"}), "v1").join(sets.withColumnsRenamed({"CDR3b": "v2", "g": "g2"}), "v2")
        pairs = pairs.filter(F.arrays_overlap("g1", "g2")).select("v1", "v2")
    return pairs


def isolated(seqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sequences that are in no pair."""
    ends = pairs.select(F.explode(F.array("v1", "v2")).alias("CDR3b")).distinct()
    return seqs.select("CDR3b").distinct().join(ends, "CDR3b", "left_anti")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers by those of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def struct_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each structure of each text, equal for equal structures, and the text's place in the list.

    A text's hash is the sum of those of its letters at their places; one letter's is taken out and the open place's put in.
    """
    letters, size, place, row = flat(texts)
    own = _mixed((place << 32 | letters).astype(np.uint64))
    sums = np.append(np.uint64(0), np.cumsum(own))  # modulo 2**64
    ends = np.cumsum(size)
    total = sums[ends] - sums[ends - size]
    return total[row] - own + _mixed((1 << 62 | size[row] << 31 | place).astype(np.uint64)), row


def _sharing(seqs: DataFrame) -> DataFrame:
    """The rows of ``seqs`` (CDR3b, mr) that share a structure with others, and few besides.

    Only 32 bits of a structure's hash and 32 of its sequence's are shuffled, as arrays by ranges of hashes; each range is
    sorted by itself. What has equal hashes by chance is for the caller to tell.
    """
    parts = 4 * parallelism(seqs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.uint32)
            for some in portions(texts, HELD):
                hashes, row = struct_hashes(texts[some])
                part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                packed = (hashes << np.uint64(32)) | ids[some][row]
                order = np.argsort(part, kind="stable")
                names, starts = np.unique(part[order], return_index=True)
                offsets = (np.append(starts, len(order)) * 8).astype(np.int32)
                yield pa.record_batch([pa.array(names.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(offsets), pa.py_buffer(packed[order])])], names=["part", "packed"])

    def shared(held: list[bytes]) -> pa.RecordBatch:
        packed = np.sort(np.concatenate([np.frombuffer(b, dtype=np.uint64) for b in held]))
        same = (packed[1:] >> np.uint64(32)) == (packed[:-1] >> np.uint64(32))
        some = np.append(same, False) | np.append(False, same)
        return pa.record_batch([pa.array(np.unique(packed[some].astype(np.uint32)).view(np.int32))], names=["__id"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now and held:
                    yield shared(held)
                    held = []
                now = part
                held.append(packed)
        if held:
            yield shared(held)

    named = seqs.withColumn("__id", F.hash("CDR3b"))
    found = named.select("mr", "__id").mapInArrow(send, "part int, packed binary").repartition("part").sortWithinPartitions("part").mapInArrow(find, "__id int")
    return named.join(found.distinct(), "__id", "left_semi").drop("__id")


def struct_members(seqs: DataFrame) -> DataFrame:
    """tag (region with one place as %), CDR3b, aa (the residue there), place; of tags that two or more sequences share.

    Sequences (distinct, with their regions mr) that share none are left out by hashes, before any structure is written out.
    """
    places = F.transform(
        F.sequence(F.lit(1), F.length("mr")),
        lambda i: F.struct(F.overlay(F.col("mr"), F.lit("%"), i, F.lit(1)).alias("tag"), F.substring(F.col("mr"), i, F.lit(1)).alias("aa"), i.alias("place")),
    )
    rows = cut(_sharing(seqs.filter("mr <> ''").select("CDR3b", "mr"))).select("CDR3b", F.inline(places))
    shared = rows.groupBy("tag").agg(F.count("*").alias("n")).filter("n >= 2")
    return rows.join(shared.select("tag"), "tag", "left_semi")


def struct_counts(seqs: DataFrame) -> DataFrame:
    """tag, n: sequences per structure, without the one-sequence ones."""
    return seqs.filter("mr <> ''").select(F.explode(wildcards(F.col("mr"), 1)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def struct_edges(members: DataFrame, blosum: bool = False, vgenes: DataFrame | None = None) -> DataFrame:
    """v1 < v2, tag: sequences that share a structure; with ``blosum`` only if the residues there score 0 or more.

    ``vgenes`` (CDR3b, TRBV): vertices are sequences with their V genes, and only those of one V gene are linked.
    """
    rows = members.select("tag", "CDR3b", "aa")
    on = ["tag"]
    if vgenes is not None:
        rows = rows.join(vgenes.select("CDR3b", "TRBV").filter("TRBV is not null").distinct(), "CDR3b")
        on.append("TRBV")
    left, right = rows.withColumnsRenamed({"CDR3b": "v1", "aa": "a1"}), rows.withColumnsRenamed({"CDR3b": "v2", "aa": "a2"})
    pairs = left.join(right, on).filter("v1 < v2")
    if blosum:
        pairs = pairs.filter(F.concat("a1", "a2").isin(similar_pairs()))
    return pairs.select("v1", "v2", "tag", *on[1:])


def residue_groups(present: Column) -> Column:
    """For an array of residues: the residues' connected groups under BLOSUM62 scores of 0 or more, as sorted strings.

    At most twenty residues, so the closure is an array fold per row; no graph job is needed for structures.
    """
    pairs = F.array(*[F.lit(p) for p in similar_pairs()])

    def reach(a: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size(present) - 1, F.lit(1))),
            F.array(a),
            lambda got, _: F.array_union(got, F.filter(present, lambda x: F.exists(got, lambda y: F.array_contains(pairs, F.concat(x, y))))),
        )

    return F.array_distinct(F.transform(present, lambda a: F.array_join(F.array_sort(reach(a)), "")))
