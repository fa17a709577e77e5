"""Sample that matches target category proportions.

Method: a mergeable reservoir per category. Each row has a priority, the hash of its content and a seed; a reservoir of
size k is the k rows of least priority, so reservoirs of parts merge by taking the least again. In one pass each task
keeps reservoirs only as large as its own counts say that the quotas can need, and some more, and counts what it saw.
The final counts fix the feasible quotas, and the reservoirs, a fraction of the pool, are trimmed to them. A reservoir
that dropped a row of a lower priority than one that is needed would show in its limit; then the pass is made again
with larger ones, so the sample is exact.

Trimming cuts reservoirs into slices by leading bits of the priority: counts of slices tell in which one a quota ends,
and only that one is ranked, so no task sorts a whole category.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clonelake.session import cut, drop, parallelism

#: Most categories of a table of targets; rows that a task takes up before it trims its reservoirs; rows of a slice.
MOST, HELD, SLICE = 100_000, 500_000, 50_000


@dataclass(frozen=True)
class Sample:
    """rows: category, item. report: category, available, target, quota, min_rows, taken, share, short_target, short_minimum."""

    rows: DataFrame
    report: DataFrame


def feasible(available: np.ndarray, share: np.ndarray, minimum: np.ndarray, size: float, refill: bool = True) -> np.ndarray:
    """Real quotas: share * level * size, at least the minimum and at most what there is.

    The level is 1, or with ``refill`` such that the quotas sum up to the size, as far as there are rows: what exhausted
    categories lack comes from the others in proportion to their shares, and what minima take beyond their shares goes off the others.
    """
    low, high = np.minimum(minimum, available).astype(float), available.astype(float)
    goal = share * size
    if not refill:
        return np.clip(goal, low, high)
    if high.sum() <= size:
        return high
    if low.sum() >= size:
        return low
    on = share > 0
    starts, ends = low[on] / share[on], high[on] / share[on]  # the total at which a category begins and stops to grow
    at = np.unique(np.concatenate([[0.0], starts, ends]))
    s, e = np.argsort(starts), np.argsort(ends)
    slope_up, slope_down = np.concatenate([[0.0], np.cumsum(share[on][s])]), np.concatenate([[0.0], np.cumsum(share[on][e])])
    began, ended = np.searchsorted(starts[s], at, side="right"), np.searchsorted(ends[e], at, side="right")
    slope = slope_up[began] - slope_down[ended]
    first = low.sum()
    total = first + np.concatenate([[0.0], np.cumsum(slope[:-1] * np.diff(at))])
    k = int(np.searchsorted(total, size, side="right")) - 1
    height = at[k] + (size - total[k]) / slope[k] if slope[k] > 1e-15 else at[k]
    return np.clip(share * height, low, high)


def whole_quotas(real: np.ndarray, available: np.ndarray, size: int, refill: bool = True) -> np.ndarray:
    """Whole numbers: rounded, or with ``refill`` down, and then up where most is missing, until the size is reached; the first of equals."""
    if not refill:
        return np.minimum(np.floor(real + 0.5 + 1e-9), available).astype(np.int64)
    base = np.floor(real + 1e-9).astype(np.int64)
    left = int(min(round(real.sum()), max(size, base.sum())) - base.sum())
    order = sorted(np.flatnonzero(base < available), key=lambda i: (-round(real[i] - base[i], 9), i))
    base[np.array(order[:left], dtype=np.int64)] += 1
    return base


def _reservoirs(pool: DataFrame, names: list[str], share: np.ndarray, minimum: np.ndarray, part: float, seed: int, slack: float, refill: bool) -> DataFrame:
    """cat (place in ``names``), item, priority; and for each task and category a row without an item: n, limit (null: nothing was dropped)."""
    tasks = parallelism(pool.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(names), dtype=np.int64)
        limits = np.full(len(names), np.iinfo(np.int64).max)
        kept: list[pa.Table] = []
        fresh = 0

        def trimmed(tables: list[pa.Table]) -> pa.Table:
            t = pa.concat_tables(tables)
            want = feasible(counts, share, minimum / tasks, counts.sum() * part, refill)
            room = np.ceil(np.maximum(want + slack * np.sqrt(want + minimum) + 20, 0)).astype(np.int64)
            cat, low = t.column("cat").to_numpy(), t.column("priority").to_numpy()
            order = np.lexsort((low, cat))
            cat = cat[order]
            starts = np.searchsorted(cat, np.arange(len(names)))
            keep = np.arange(len(cat)) - starts[cat] < room[cat]
            lost, at = np.unique(cat[~keep], return_index=True)
            limits[lost] = np.minimum(limits[lost], low[order][~keep][at] - 1)
            return t.take(pa.array(order[keep]))

        for batch in batches:
            counts += np.bincount(batch.column(0).to_numpy(), minlength=len(names))
            kept.append(pa.Table.from_batches([batch]))
            fresh += batch.num_rows
            if fresh >= HELD:
                kept, fresh = [trimmed(kept)], 0
        seen = np.flatnonzero(counts)
        if kept:
            for b in trimmed(kept).combine_chunks().to_batches(max_chunksize=50_000):
                none = pa.nulls(b.num_rows, pa.int64())
                yield pa.record_batch([*b.columns, none, none], names=["cat", "item", "priority", "n", "bound"])
            bound = pa.array(limits[seen], mask=limits[seen] == np.iinfo(np.int64).max)
            yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.nulls(len(seen), pa.string()), pa.nulls(len(seen), pa.int64()), pa.array(counts[seen]), bound], names=["cat", "item", "priority", "n", "bound"])

    rows = pool.select("cat", "item", F.xxhash64("name", "item", F.lit(seed)).alias("priority"))
    return rows.mapInArrow(run, "cat int, item string, priority bigint, n bigint, bound bigint")


def proportional_sample(items: DataFrame, category: str, item: str, targets: DataFrame, share: str, minimum: str, part: tuple[int, int] = (1, 5), seed: int = 7, refill: bool = True, slack: float = 6.0) -> Sample:
    """A sample of ``part`` of the pool in which categories have their target shares, with a minimum each.

    The pool is the set of distinct (category, item) pairs whose category is in ``targets``; null categories and items
    are not in it. Items are strings. ``targets`` has one row per category, with a share (null: 0) and a least number
    of rows (null: 0). S = pool size * part, rounded down. Quotas: ``feasible`` and ``whole_quotas``; with ``refill``
    they sum up to S if there are as many rows (more if the minima alone are more), without it the categories are
    rounded to share * S one by one. report has a row for each category of ``targets``: short_target if fewer pairs
    than share * S exist, short_minimum if fewer than the minimum; taken and share are what the sample has, counted.
    Ties of priority are broken by the item, so the sample depends on content and seed only. Empty pool: S is 0, no
    target is short. Other columns of either table don't matter.
    """
    spark = items.sparkSession
    listed = targets.select(F.col(f"`{category}`").alias("name"), F.coalesce(F.col(f"`{share}`"), F.lit(0.0)).cast("double").alias("share"), F.coalesce(F.col(f"`{minimum}`"), F.lit(0)).cast("bigint").alias("least"))
    listed = listed.filter("name is not null").orderBy("name").limit(MOST + 1).collect()
    if len(listed) > MOST:
        raise ValueError(f"a table of targets of more than {MOST} categories")
    names, shares, least = [r.name for r in listed], np.array([r.share for r in listed]), np.array([r.least for r in listed], dtype=np.int64)
    numbers = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, cat int")  # MOST rows
    pool = items.select(F.col(f"`{category}`").alias("name"), F.col(f"`{item}`").alias("item")).filter("item is not null").join(F.broadcast(numbers), "name").distinct()
    while True:
        held = cut(_reservoirs(pool, names, shares, least, part[0] / part[1], seed, slack, refill))
        seen = {r.cat: r for r in held.filter("item is null").groupBy("cat").agg(F.sum("n").alias("n"), F.min("bound").alias("bound")).collect()}  # a row per category
        available = np.array([seen[i].n if i in seen else 0 for i in range(len(names))], dtype=np.int64)
        size = int(available.sum()) * part[0] // part[1]
        quotas = whole_quotas(feasible(available, shares, least, size, refill), available, size, refill) if names else available
        last = np.iinfo(np.int64).max
        plan = spark.createDataFrame([(i, int(quotas[i]), last if i not in seen or seen[i].bound is None else seen[i].bound) for i in range(len(names))], "cat int, quota bigint, bound bigint")
        sure = held.filter("item is not null").select("cat", "item", "priority").join(F.broadcast(plan), "cat").filter("priority <= bound").drop("bound")
        there = {r.cat: r.n for r in sure.groupBy("cat").agg(F.count("*").alias("n")).collect()}
        if all(there.get(i, 0) >= quotas[i] for i in range(len(names))):
            break
        drop(held)
        slack = max(6.0, slack * 8)  # a reservoir was too small
    bits = max(4, max(there.values(), default=0) // SLICE).bit_length()
    sliced = sure.withColumn("slice", F.shiftright("priority", 64 - bits).cast("int"))
    counts = sliced.groupBy("cat", "quota", "slice").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("cat").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per slice
    ends = counts.withColumn("left", F.col("quota") - F.sum("n").over(upto) + F.col("n")).filter("left > 0").select("cat", "slice", "left", F.col("n").alias("inside"))
    kept = sliced.join(ends, ["cat", "slice"])
    in_slice = Window.partitionBy("cat", "slice").orderBy("priority", "item")
    trimmed = kept.filter("left < inside").withColumn("at", F.row_number().over(in_slice)).filter("at <= left")
    rows = kept.filter("left >= inside").select("cat", "item").unionByName(trimmed.select("cat", "item")).join(F.broadcast(numbers), "cat").select(F.col("name").alias(category), F.col("item").alias(item))
    goal = shares * size
    report = spark.createDataFrame(
        [(names[i], int(available[i]), float(goal[i]), int(quotas[i]), int(least[i]), bool(available[i] < goal[i] * (1 - 1e-12)), bool(available[i] < least[i])) for i in range(len(names))],
        "name string, available bigint, target double, quota bigint, min_rows bigint, short_target boolean, short_minimum boolean",
    )
    taken = rows.groupBy(F.col(f"`{category}`").alias("name")).agg(F.count("*").alias("taken"))
    whole = taken.agg(F.sum("taken").alias("all"))
    full = report.join(taken, "name", "left").withColumn("taken", F.coalesce("taken", F.lit(0))).crossJoin(F.broadcast(whole))  # one row
    full = full.withColumn("share", F.coalesce(F.try_divide("taken", "all"), F.lit(0.0))).drop("all")
    return Sample(rows, full.withColumnRenamed("name", category))
