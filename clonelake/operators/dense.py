"""A global dictionary of integers for keys, and sums by block arrays over its numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clonelake.session import cut, parallelism

#: Numbers that one dense array covers.
WIDTH = 65_536
#: Rows that a task holds before it sums them up.
HELD = 1_000_000


def dictionary(terms: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """``keys`` and a dense bigint ``id`` from 0 for each distinct row of ``keys``.

    Built without a global sort: keys are numbered within hash buckets, and a bucket's numbers start where the one
    before ends. A row per bucket is broadcast.
    """
    n = buckets or max(256, parallelism(terms.sparkSession))
    named = terms.select(*keys).distinct().withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))
    ranked = named.withColumn("__at", F.row_number().over(Window.partitionBy("__bucket").orderBy(*keys)))
    ends = ranked.groupBy("__bucket").agg(F.count("*").alias("__n"))
    starts = ends.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("__start"))
    return ranked.join(F.broadcast(starts), "__bucket").select(*keys, (F.coalesce("__start", F.lit(0)) + F.col("__at") - 1).alias("id"))


def numbered(rows: DataFrame, order: list[str], into: str, start: int = 1) -> DataFrame:
    """``rows`` with ``into``: dense bigint numbers in the order of ``order``; rows that tie there are numbered in any order.

    Rows are sorted by range and written once, with their places in their ranges; numbers begin where the ranges before end.
    """
    by = [F.col(f"`{c}`") for c in order]
    ranged = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))  # range << 33 | place
    ranged = ranged.withColumn("__range", F.shiftright("__at", 33))
    ends = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = ends.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # a row per range
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    out = ranged.join(F.broadcast(starts), "__range")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != into], (F.col("__start") + place + start).cast("bigint").alias(into))


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, counts) rows of a block -> per range of ids the places that occur and their sums; memory is bounded by HELD."""
    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        held.append(_columns(batch))
        rows += batch.num_rows
        if rows >= HELD:
            yield _as_arrays(np.concatenate(held, axis=1))
            held, rows = [], 0
    if rows:
        yield _as_arrays(np.concatenate(held, axis=1))


def _as_arrays(columns: np.ndarray) -> pa.RecordBatch:
    ids, code = np.unique(columns[0], return_inverse=True)
    sums = [np.bincount(code, weights=w, minlength=len(ids)).astype(np.int64) for w in columns[1:]]
    ranges, starts = np.unique(ids // WIDTH, return_index=True)
    offsets = pa.array(np.append(starts, len(ids)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids % WIDTH, *sums)]
    return pa.record_batch([pa.array(ranges), *lists], names=["range", "at", *[f"n{i}" for i in range(len(sums))]])


def block_sums(rows: DataFrame, counts: list[str]) -> DataFrame:
    """id and the sums of ``counts`` (bigint, below 2**53): count arrays of each block of rows, summed by range of ids.

    rows: ``id`` (bigint from 0, from ``dictionary``) and ``counts``. Blocks send only the places that occur, so neither
    their memory nor what they send grows with the dictionary; a range is summed in one dense array, one at a time.
    """
    names = [f"n{i}" for i in range(len(counts))]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = -1, np.zeros((len(names), WIDTH), dtype=np.int64)

        def full() -> pa.RecordBatch:
            at = np.flatnonzero((sums != 0).any(axis=0) | seen)
            return pa.record_batch([pa.array(at + now * WIDTH), *[pa.array(s[at]) for s in sums]], names=["id", *names])

        seen = np.zeros(WIDTH, dtype=bool)
        for batch in batches:
            for i, r in enumerate(batch.column(0).to_pylist()):
                if r != now:
                    if now >= 0:
                        yield full()
                    now = r
                    sums[:] = 0
                    seen[:] = False
                at = batch.column(1)[i].values.to_numpy()
                seen[at] = True
                for k in range(len(names)):
                    sums[k, at] += batch.column(k + 2)[i].values.to_numpy()
        if now >= 0:
            yield full()

    blocks = rows.select("id", *counts).mapInArrow(_blocks, "range bigint, at array<bigint>, " + ", ".join(f"{n} array<bigint>" for n in names))
    out = blocks.repartition("range").sortWithinPartitions("range").mapInArrow(total, "id bigint, " + ", ".join(f"{n} bigint" for n in names))
    return out.withColumnsRenamed(dict(zip(names, counts, strict=True)))
