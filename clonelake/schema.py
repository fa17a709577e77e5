"""Column names, types and the loading of repertoires and reference repertoires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonelake.functions.text import RESIDUES
from clonelake.operators.dense import numbered

#: Canonical column names and the other names that they may have, in order of preference.
ALIASES = {
    "CDR3b": ("cdr3", "cdr3_aa", "CDR3.beta", "cdr3b", "CDR3_beta", "junction_aa"),
    "TRBV": ("v_gene", "v.gene", "Vgene", "v_call"),
    "patient": ("sample", "donor", "sample_id", "sample.id"),
    "HLA": ("hla", "HLA_alleles"),
    "counts": ("frequency", "clone_count", "Frequency", "cloneCount"),
}
#: Names of the published reference repertoires.
REFERENCE_NAMES = (
    "human_v1.0_CD4", "human_v1.0_CD8", "human_v1.0_CD48",
    "human_v2.0_CD4", "human_v2.0_CD8", "human_v2.0_CD48",
    "mouse_v1.0_CD4", "mouse_v1.0_CD8", "mouse_v1.0_CD48",
    "gliph_reference",
)
REPERTOIRE = T.StructType(
    [T.StructField("seq_ID", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("CDR3b", "TRBV", "patient", "HLA")] + [T.StructField("counts", T.DoubleType())]
)


def standard_names(columns: list[str]) -> dict[str, str]:
    """Present name -> canonical name: a canonical name that is there wins, else the first alias that is; one lone column is CDR3b."""
    renamed = {}
    for name, others in ALIASES.items():
        if name not in columns:
            found = next((o for o in others if o in columns and o not in renamed), None)
            if found:
                renamed[found] = name
    if len(columns) == 1 and "CDR3b" not in {renamed.get(c, c) for c in columns}:
        renamed = {columns[0]: "CDR3b"}
    return renamed


def read_repertoire(source: DataFrame | list | str, spark: SparkSession | None = None) -> DataFrame:
    """A repertoire from a DataFrame, a list of DataFrames, a list of sequences or a path (Parquet folder, .csv or .tsv)."""
    if isinstance(source, DataFrame):
        return source.withColumnsRenamed(standard_names(source.columns))
    if isinstance(source, list) and source and all(isinstance(x, DataFrame) for x in source):
        first, *rest = [read_repertoire(x) for x in source]
        for x in rest:
            first = first.unionByName(x, allowMissingColumns=True)
        return first
    if spark is None:
        raise ValueError("a session is needed to read a list or a path")
    if isinstance(source, list):
        return spark.createDataFrame([(x,) for x in source], "CDR3b string")
    if isinstance(source, str):
        if source.endswith((".csv", ".tsv", ".txt")):
            return read_repertoire(spark.read.csv(source, sep="," if source.endswith(".csv") else "\t", header=True))
        return read_repertoire(spark.read.parquet(source))
    raise TypeError(f"cannot read a repertoire from {type(source).__name__}")


def parse_sequences(df: DataFrame, order_by: str | None = None, filter_sample: bool = False, accept_cf: bool = True, min_length: int = 8) -> DataFrame:
    """Canonical names and types, only residues in CDR3b, missing counts as 1, and seq_ID.

    Rows whose CDR3b is null or has a foreign character go; an empty one passes. seq_ID is kept if there is one (rows
    delivered twice then count once), else rows are numbered in the order of ``order_by`` and of all columns. The
    start, end and length filters bind the reference only, unless ``filter_sample`` is set. Other columns stay.
    """
    df = read_repertoire(df)
    if "CDR3b" not in df.columns:
        raise ValueError("no column CDR3b and none of its other names")
    out = df.withColumn("CDR3b", F.col("CDR3b").cast("string")).filter(F.col("CDR3b").rlike(rf"\A[{RESIDUES}]*\z"))
    for c in ("TRBV", "patient", "HLA"):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast("string"))
    if "counts" in out.columns:
        out = out.withColumn("counts", F.coalesce(F.expr("try_cast(counts AS double)"), F.lit(1.0)))
    if filter_sample:
        out = out.filter((F.length("CDR3b") >= min_length) & (F.lit(not accept_cf) | F.col("CDR3b").rlike("^C.*F$")))
    if "seq_ID" in out.columns:
        known = [c for c in REPERTOIRE.names if c in out.columns]
        others = [c for c in out.columns if c not in known and c not in ("loaded_at", "sampled_at")]
        return out.select(*known, *[f"`{c}`" for c in others]).distinct()
    return numbered(out, [*([order_by] if order_by else []), *out.columns], "seq_ID")


def load_reference(df: DataFrame, accept_cf: bool = True, min_length: int = 8, boundary_size: int = 3) -> DataFrame:
    """Distinct CDR3b, TRBV of a reference repertoire: C..F (if accept_cf), long enough for a motif region, residues only."""
    df = read_repertoire(df)
    if "CDR3b" not in df.columns:  # positional: sequences, then V genes
        df = df.withColumnsRenamed({df.columns[0]: "CDR3b"} | ({df.columns[1]: "TRBV"} if len(df.columns) > 1 else {}))
    if "TRBV" not in df.columns:
        df = df.withColumn("TRBV", F.lit(None).cast("string"))
    least = max(min_length, 2 * boundary_size + 1)
    keep = F.col("CDR3b").rlike(rf"\A[{RESIDUES}]+\z") & (F.length("CDR3b") >= least)
    if accept_cf:
        keep = keep & F.col("CDR3b").rlike("^C.*F$")
    return df.select("CDR3b", "TRBV").filter(keep).distinct()


def motif_region(column: str = "CDR3b", boundary_size: int = 3, trim: bool = True):
    """The sequence without ``boundary_size`` residues at each end; empty if nothing is left."""
    if not trim:
        return F.col(column)
    return F.substring(F.col(column), F.lit(boundary_size + 1), F.greatest(F.length(column) - 2 * boundary_size, F.lit(0)))


def regions(sequences: DataFrame, boundary_size: int = 3) -> DataFrame:
    """Distinct CDR3b with a non-empty motif region mr."""
    return sequences.filter(F.length("CDR3b") > 2 * boundary_size).select("CDR3b").distinct().select("CDR3b", motif_region("CDR3b", boundary_size).alias("mr"))
