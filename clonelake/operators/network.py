"""Node, edge and legend tables of a group network; drawing is left to the caller."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from clonelake.operators.dense import numbered
from clonelake.operators.motifs import local_pairs


def network_nodes(clusters: DataFrame, rows: DataFrame, scores: DataFrame | None = None, min_size: int = 3, color: str = "score", absolute_size: bool = False) -> DataFrame:
    """id, label, tag, size, weight: one node per member row (seq_ID) of each group with at least ``min_size`` sequences.

    size runs from 12 to 20 with the clone counts (all 12 if they are equal; the counts themselves if absolute_size); weight is the group's ``color`` value.
    """
    big = clusters.groupBy("tag").agg(F.count_distinct("CDR3b").alias("n")).filter(F.col("n") >= min_size).select("tag")
    own = clusters.select("tag", "CDR3b").distinct().join(big, "tag").join(rows.select("seq_ID", "CDR3b", "counts"), "CDR3b")
    span = own.agg(F.min("counts").alias("lo"), F.max("counts").alias("hi"))
    scaled = F.col("counts") if absolute_size else F.coalesce(F.lit(12.0) + F.try_divide(F.col("counts") - F.col("lo"), F.col("hi") - F.col("lo")) * 8, F.lit(12.0))
    out = own.crossJoin(F.broadcast(span))  # one row
    if scores is not None:
        out = out.join(scores.select("tag", F.col("score").alias("weight")), "tag", "left")
    else:
        out = out.withColumn("weight", F.lit(None).cast("double"))
    return out.select(F.col("seq_ID").alias("id"), F.col("CDR3b").alias("label"), "tag", scaled.alias("size"), "weight")


def network_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """from, to, label: edges between the nodes of one group; both ends by equi joins, local before global where both exist."""
    left = nodes.select(F.col("id").alias("from"), F.col("label").alias("v1"), "tag")
    right = nodes.select(F.col("id").alias("to"), F.col("label").alias("v2"), F.col("tag").alias("tag2"))
    pairs = edges.filter("type <> 'singleton' AND v1 <> v2").join(left, "v1").join(right, "v2").filter("tag = tag2")
    ordered = pairs.select(F.least("from", "to").alias("from"), F.greatest("from", "to").alias("to"), F.col("type").alias("label")).distinct()
    return ordered.groupBy("from", "to").agg(F.max("label").alias("label"))


def all_positions(members: DataFrame, position: str = "pos") -> DataFrame:
    """motif, CDR3b and every place of the motif in the region (members: motif, CDR3b, mr); a dot stands for any residue."""
    n, k = F.length("mr"), F.length("motif")
    places = F.filter(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.rlike(F.substring(F.col("mr"), i, k), F.concat(F.lit("^"), F.col("motif"), F.lit("$"))))
    return members.select("motif", "CDR3b", "mr", F.explode(places).alias(position))


def motif_edges(members: DataFrame, within: float = 3) -> DataFrame:
    """v1, v2, motif: members of one motif with any two places of it less than ``within`` apart, not only the first ones."""
    return local_pairs(all_positions(members), "pos", within).distinct()


def bound_edges(edges: DataFrame, nodes: DataFrame, public: str = "all", vgene_match: str = "none") -> DataFrame:
    """from, to, label between the nodes (id, label, tag, patient, TRBV) of one group, for the first kind of clustering.

    ``public``: the types of edges that may link donors; ``vgene_match``: those that need one V gene.
    """
    columns = [c for c in ("patient", "TRBV") if c in nodes.columns]
    left = nodes.select(F.col("id").alias("from"), F.col("label").alias("v1"), "tag", *[F.col(c).alias(f"{c}_1") for c in columns])
    right = nodes.select(F.col("id").alias("to"), F.col("label").alias("v2"), "tag", *[F.col(c).alias(f"{c}_2") for c in columns])
    pairs = edges.filter("type <> 'singleton' AND v1 <> v2").join(left, "v1").join(right, ["v2", "tag"])
    donor = {"all": [], "local": ["global"], "global": ["local"], "none": ["local", "global"]}[public]
    gene = {"all": ["local", "global"], "local": ["local"], "global": ["global"], "none": []}[vgene_match]
    if donor and "patient" in columns:
        pairs = pairs.filter(~F.col("type").isin(donor) | (F.col("patient_1") == F.col("patient_2")))
    if gene and "TRBV" in columns:
        pairs = pairs.filter(~F.col("type").isin(gene) | (F.col("TRBV_1") == F.col("TRBV_2")))
    return pairs.select(F.least("from", "to").alias("from"), F.greatest("from", "to").alias("to"), F.col("type").alias("label")).distinct()


#: Steps of a colour ramp.
STEPS = 50
#: Colours at even distances on a ramp from dark blue over green to yellow.
RAMP = ("#440154", "#3b528b", "#21918c", "#5ec962", "#fde725")


def ramp(n: int, stops: tuple[str, ...] = RAMP) -> list[str]:
    """n colours, evenly mixed between the stops."""
    rgb = np.array([[int(c[i : i + 2], 16) for i in (1, 3, 5)] for c in stops], dtype=float)
    at = np.linspace(0, len(stops) - 1, n) if n > 1 else np.zeros(n)
    mixed = [[np.interp(x, np.arange(len(stops)), rgb[:, k]) for k in range(3)] for x in at]
    return ["#" + "".join(f"{round(v):02x}" for v in c) for c in mixed]


def colour_scale(values: DataFrame, column: str) -> str:
    """'linear' or 'log': which of the sorted distinct values and their logarithms lies closer to a line over their places.

    Both fits are sums over the values, so nothing is collected but their sums; values of 0 or less leave only 'linear'.
    """
    own = numbered(values.select(F.col(f"`{column}`").cast("double").alias("y")).filter("y is not null").distinct(), ["y"], "x").withColumn("z", F.when(F.col("y") > 0, F.log("y")))

    def rest(y: str):
        return F.regr_syy(y, F.col("x").cast("double")) - F.regr_sxy(y, F.col("x").cast("double")) ** 2 / F.regr_sxx(y, F.col("x").cast("double"))

    fit = own.agg(F.count("*").alias("n"), F.count("z").alias("positive"), rest("y").alias("linear"), rest("z").alias("log")).first()
    if fit.positive < fit.n or fit.n < 3:
        return "linear"
    return "linear" if fit.linear < fit["log"] else "log"


def coloured(nodes: DataFrame, column: str, scale: str | None = None, stops: tuple[str, ...] = RAMP) -> DataFrame:
    """``nodes`` with color: by number the nearest of STEPS colours on a linear or logarithmic ramp, by text one colour for each value.

    Without ``scale`` it is the better of the two. Nulls are gray. Texts of more than 10,000 values are an error.
    """
    gray = F.lit("gray")
    if isinstance(nodes.schema[column].dataType, NumericType):
        scale = scale or colour_scale(nodes, column)
        value = F.col(f"`{column}`").cast("double")
        span = nodes.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        log = scale == "log"
        lo, hi = (F.floor(F.log10("lo")), F.ceil(F.log10("hi"))) if log else (F.floor("lo"), F.ceil("hi"))
        span = span.select(lo.cast("double").alias("__lo"), hi.cast("double").alias("__hi"))
        step = lambda i: F.col("__lo") + (F.col("__hi") - F.col("__lo")) * i / (STEPS - 1)
        at = lambda i: F.pow(F.lit(10.0), step(i)) if log else step(i)
        near = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda i: F.struct(F.abs(at(i) - value).alias("d"), i.alias("i"))))["i"]
        colours = F.array(*[F.lit(c) for c in ramp(STEPS, stops)])
        out = nodes.crossJoin(F.broadcast(span))  # one row
        return out.withColumn("color", F.coalesce(F.when(value.isNotNull(), colours[near]), gray)).drop("__lo", "__hi")
    names = [r.v for r in nodes.select(F.col(f"`{column}`").alias("v")).filter("v is not null").distinct().orderBy("v").limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError(f"{column} has more than 10,000 values")
    table = nodes.sparkSession.createDataFrame(list(zip(names, ramp(len(names), stops), strict=True)), "__v string, color string")
    return nodes.join(F.broadcast(table), F.col(f"`{column}`") == F.col("__v"), "left").drop("__v").withColumn("color", F.coalesce("color", gray))


def legend(nodes: DataFrame, steps: int = 50, every: int = 10) -> DataFrame:
    """step, weight: every tenth step of an even ramp over the nodes' weights."""
    span = nodes.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    return span.select(F.explode(F.sequence(F.lit(0), F.lit(steps), F.lit(every))).alias("step"), "lo", "hi").select("step", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / steps).alias("weight"))
