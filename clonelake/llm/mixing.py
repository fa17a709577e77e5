"""Mix of sources by target weights.

Method: weighted fair queueing. The documents of a source stand in a shuffled queue, once per allowed repeat, and each
gets a virtual finish time: the tokens of its source up to and with it, divided by the source's weight. The copies of
all sources are sorted by range of finish time, and the sorted list is truncated at the total budget: at any time each
source that is not exhausted has given tokens in proportion to its weight.

Nothing sorts a whole source in one task: queue positions come from the sums of hash slices of each (source, repeat).
The sorted ranges are written once; their sums tell in which range the budget ends, and only that one is ranked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clonelake.session import cut, parallelism

#: Most sources in a table of weights; their totals are summed up on the driver.
MOST = 10_000


@dataclass(frozen=True)
class Mix:
    """rows: key, source, repeat (from 1), size, finish. report: source, weight, max_repeats, own, target, capacity, exhausted, taken, share."""

    rows: DataFrame
    report: DataFrame


#: Documents that one slice of a source's queue should hold.
SLICE = 50_000


def mix_sources(sizes: DataFrame, key: str, source: str, size: str, weights: DataFrame, budget: int | None = None, seed: int = 11) -> Mix:
    """The mix of ``sizes`` (one row per document, a cut table, as it is read several times) by ``weights``.

    weights: a row per source with ``weight`` (null: 0) and ``max_repeats`` (null: 1). Documents of null or unlisted
    sources take no part; null sizes are 0. The budget is the total size of the listed sources, each document
    once, unless given. The mix is the longest beginning of the queue whose total size is within the budget. report has
    every listed source: target = weight * budget, capacity = max_repeats * own, exhausted if its whole queue holds
    less than the target (a source without documents has 0), taken and share as the mix has them. A source with weight
    0 gives nothing. Ties of finish time are broken by source, repeat and key.
    """
    wanted = weights.select(
        F.col("source").alias("__s"), F.coalesce(F.col("weight"), F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(1)).cast("bigint").alias("max_repeats")
    ).filter("__s is not null")
    docs = sizes.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{source}`").alias("__s"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("bigint").alias("__n"))
    own = docs.filter("__s is not null").groupBy("__s").agg(F.sum("__n").alias("own"), F.count("*").alias("docs"))
    known = wanted.join(own, "__s", "left").fillna(0, ["own", "docs"]).limit(MOST + 1).collect()
    if len(known) > MOST:
        raise ValueError(f"a table of weights of more than {MOST} sources")
    whole = sum(r.own for r in known) if budget is None else budget
    # a repeat that begins behind the budget, or behind its source's target, can neither be in the mix nor change whether the target is met
    plan = [(r["__s"], float(r.weight), r.max_repeats, r.own, min(r.max_repeats, int(max(1.0, r.weight) * whole // r.own) + 1) if r.own else r.max_repeats) for r in known]
    spark = sizes.sparkSession
    listed = spark.createDataFrame(plan, "__s string, weight double, max_repeats bigint, own bigint, __most bigint")
    bits = max(4, max((r.docs for r in known), default=0) // SLICE).bit_length()

    copies = docs.join(F.broadcast(listed.filter("weight > 0 AND __most > 0").select("__s", "weight", "__most")), "__s")  # MOST rows
    copies = copies.withColumn("__e", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__most")))).withColumn("__h", F.xxhash64("__k", "__e", F.lit(seed))).withColumn("__z", F.shiftrightunsigned("__h", 64 - bits).cast("int"))
    sums = copies.groupBy("__s", "__e", "__z").agg(F.sum("__n").alias("__sum"))
    before = Window.partitionBy("__s").orderBy("__e", "__z").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    starts = sums.select("__s", "__e", "__z", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__s", "__e", "__z").orderBy("__h", "__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = copies.withColumn("__upto", F.sum("__n").over(within)).join(starts, ["__s", "__e", "__z"])
    queue = queue.select("__k", "__s", "__e", "__n", (F.col("__start") + F.col("__upto")).alias("__upto"), ((F.col("__start") + F.col("__upto")) / F.col("weight")).alias("__f"))
    order = ["__f", "__s", "__e", "__k"]
    ranged = cut(queue.repartitionByRange(parallelism(spark), *order).withColumn("__p", F.spark_partition_id()))
    stats = ranged.groupBy("__p", "__s").agg(F.sum("__n").alias("n"), F.max("__upto").alias("upto")).collect()  # a row per range and source
    of_range: dict[int, int] = {}
    given: dict[str, int] = {}
    for r in stats:
        of_range[r["__p"]] = of_range.get(r["__p"], 0) + r.n
        given[r["__s"]] = max(given.get(r["__s"], 0), r.upto)
    end, room = None, whole
    for p in sorted(of_range):
        if of_range[p] > room:
            end = p
            break
        room -= of_range[p]
    mix = ranged
    if end is not None:
        upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the one range in which the budget ends
        last = ranged.filter(F.col("__p") == end).withColumn("__cum", F.sum("__n").over(upto)).filter(F.col("__cum") <= room).drop("__cum")
        mix = ranged.filter(F.col("__p") < end).unionByName(last)
    report = spark.createDataFrame(
        [(s, w, m, o, w * whole, m * o, given.get(s, 0) < w * whole) for s, w, m, o, _ in plan],
        "source string, weight double, max_repeats bigint, own bigint, target double, capacity bigint, exhausted boolean",
    )
    taken = mix.groupBy(F.col("__s").alias("source")).agg(F.sum("__n").alias("taken"))
    mixed = taken.agg(F.sum("taken").alias("__mixed"))
    full = report.join(taken, "source", "left").withColumn("taken", F.coalesce("taken", F.lit(0))).crossJoin(F.broadcast(mixed))  # one row
    full = full.withColumn("share", F.coalesce(F.try_divide("taken", "__mixed"), F.lit(0.0))).drop("__mixed")
    rows = mix.select(F.col("__k").alias(key), F.col("__s").alias(source), F.col("__e").cast("int").alias("repeat"), F.col("__n").alias(size), F.col("__f").alias("finish"))
    return Mix(rows, full)
