"""One group identifier for all records that pairwise matches link, directly or over others.

Method: seed-tree pruning. In each round every vertex proposes the least vertex of its neighbourhood to all of the
neighbourhood; a vertex that nobody gets proposed itself is not minimal anywhere: it drops out and hangs below its
least proposal in a propagation forest. The others stay, linked to their least proposal. A vertex whose only proposal is itself is the
seed of a whole group. When no edge is left, the seeds' identifiers flow down the forest, the last round first.

Vertices are numbers that keep the order of the names: the distinct names are sorted by range and numbered where they
lie, so the least number is the least name, and names are shuffled only to be numbered and to be put back.

A star's centre or a chain's minimum may hold a third of all edges. Such vertices are found by counting (at most
HOT of them, as each holds more than 1/HOT of the rows) and looked up by broadcast; only the rest is shuffled for
the join. Every round is written to the shared folder, and the tables of the round before are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonelake.session import cut, drop

#: Most vertices that a broadcast may hold.
HOT = 2000
#: Rows of one key that a task takes without trouble.
EASY = 5_000_000


def _lookup(rows: DataFrame, n: int, key: str, values: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``key``, which is unique in ``values``; of n rows, keys with more than n / HOT and EASY go by broadcast."""
    limit = max(n // HOT, EASY)
    if n <= limit:  # no key can fill a task
        return rows.join(values, key, how)
    hot = F.broadcast(cut(rows.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > limit).select(key)))  # fewer than HOT rows
    by_broadcast = rows.join(hot, key, "left_semi").join(F.broadcast(values.join(hot, key, "left_semi")), key, how)
    return by_broadcast.unionByName(rows.join(hot, key, "left_anti").join(values, key, how))


def _both_ways(a: str, b: str) -> Column:
    return F.inline(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v"))))


def connected_components(edges: DataFrame, a: str | Column, b: str | Column, rounds: int = 60) -> DataFrame:
    """member, grp for every distinct non-null end; grp is the least member (by bytes) of the group.

    A row with two different ends links them, whichever way round and however often it is there; a row with one
    non-null end, or two equal ones, only names it. No edges give no rows.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    ends = edges.select(a.alias("a"), b.alias("b"))
    names = cut(
        ends.select(F.explode(F.array("a", "b")).alias("member")).filter("member is not null").distinct().repartitionByRange("member").sortWithinPartitions("member").select("member", F.monotonically_increasing_id().alias("id"))
    )
    pairs = cut(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n = pairs.count()
    left = _lookup(pairs, n, "a", names.select(F.col("member").alias("a"), F.col("id").alias("x")))
    graph = cut(_lookup(left, n, "b", names.select(F.col("member").alias("b"), F.col("id").alias("y"))).select(_both_ways("x", "y")))
    drop(pairs)
    n *= 2
    forest: list[tuple[DataFrame, int]] = []
    while n:
        if len(forest) == rounds:
            raise RuntimeError(f"{n} links are left after {rounds} rounds")
        least = graph.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        proposals = _lookup(graph, n, "u", least).select(F.col("v").alias("u"), F.col("m").alias("c")).unionByName(least.select("u", F.col("m").alias("c"))).distinct()
        proposals = cut(proposals)
        best = cut(proposals.groupBy("u").agg(F.min("c").alias("m"), F.count("*").alias("k"), F.max(F.col("c") == F.col("u")).alias("stays")))
        pruned = best.filter("not stays").select("u", F.col("m").alias("p"))
        forest.append((pruned, pruned.count()))
        links = _lookup(proposals, n, "u", best.filter("k > 1").select("u", "m")).filter("c <> m").select(F.least("c", "m").alias("x"), F.greatest("c", "m").alias("y")).distinct()
        before, graph = graph, cut(links.select(_both_ways("x", "y")))
        drop(before)
        drop(proposals)
        n = graph.count()
    drop(graph)
    # down the forest, the last round first: a vertex that dropped out in round t hangs below one that outlived t
    labels = None
    for pruned, count in reversed(forest):
        if labels is None:
            labels = pruned.select("u", F.col("p").alias("g"))  # what is left after the last round is seeds
            continue
        known = labels.select(F.col("u").alias("p"), "g")
        labels = labels.unionByName(cut(_lookup(pruned, count, "p", known, "left").select("u", F.coalesce("g", "p").alias("g"))))
    if labels is None:
        return names.select("member", F.col("member").alias("grp"))
    found = names.join(labels.withColumnRenamed("u", "id"), "id", "left").select("member", F.coalesce("g", "id").alias("g"))
    return _lookup(found, names.count(), "g", names.select(F.col("id").alias("g"), F.col("member").alias("grp"))).select("member", "grp")
