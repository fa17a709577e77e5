"""Saving and loading the tables and parameters of a run."""

from __future__ import annotations

import json
import re
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonelake.params import Params
from clonelake.schema import REFERENCE_NAMES

#: Tables of a run and whether each is there in both kinds of clustering.
TABLES = ("sample_log", "all_motifs", "selected_motifs", "global_enrichment", "connections", "cluster_properties", "cluster_members")


#: File names of the text form; <...> stands for a parameter, lists joined by underscores.
FILES = {
    "sample_log": "kmer_resample_<sim_depth>_log.txt",
    "selected_motifs": "local_similarities.txt",
    "all_motifs": "all_motifs.txt",
    "global_enrichment": "global_similarities.txt",
    "connections": "clone_network.txt",
    "cluster_members": "cluster_member_details.txt",
    "cluster_properties": "convergence_groups.txt",
}
PARAMETERS = "parameter.txt"
#: Names that differ in results of the combined method, and of the methods of the first and second kind.
OTHER_FILES = {
    None: {
        "selected_motifs": "local_similarities_minp_<lcminp>_minove_<lcminove>_kmer_mindepth_<lckmer_mindepth>.txt",
        "selected_structs": "global_similarities_minp_<gcminp>_minove_<gcminove>_kmer_mindepth_<gckmer_mindepth>.txt",
        "all_structs": "all_global_similarities.txt",
    },
    1: {
        "selected_motifs": "kmer_resample_<sim_depth>_minp<lcminp>_ove<lcminove>.txt",
        "all_motifs": "kmer_resample_<sim_depth>_all_motifs.txt",
    },
    2: {"selected_motifs": "local_similarities_minp_<lcminp>_minove_<lcminove>_kmer_mindepth_<kmer_mindepth>.txt"},
}


def save(folder: str, tables: dict[str, DataFrame], params: Params, form: str = "parquet", overwrite: bool = False) -> None:
    """The tables and parameters below ``folder``: Parquet and one JSON line, or (form 'text') tab-separated text.

    The text form has the names of FILES, a header in all but the connections, NA for null, and parameters as lines of
    name and value. Unless ``overwrite``, tables that are there are an error. Unknown table names are an error. The
    folder may be on any file system that Spark can write to; each table is a folder of parts.
    """
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown tables: {', '.join(sorted(unknown))}")
    if form not in ("parquet", "text"):
        raise ValueError("form must be parquet or text")
    mode = "overwrite" if overwrite else "errorifexists"
    spark = SparkSession.getActiveSession()
    own = asdict(params)
    if form == "parquet":
        spark.createDataFrame([(json.dumps(own),)], "value string").coalesce(1).write.mode(mode).text(f"{folder}/parameters")
    else:
        lines = [(f"{k}\t{_written(v)}",) for k, v in own.items() if v is not None]
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode(mode).text(f"{folder}/{PARAMETERS}")
    for name, df in tables.items():
        writer = df.write.mode(mode)
        if form == "parquet":
            writer.parquet(f"{folder}/{name}")
        else:
            writer.option("sep", "\t").option("header", name != "connections").option("nullValue", "NA").option("quote", "").csv(f"{folder}/{_named(FILES[name], own)}")


def _written(v) -> str:
    if isinstance(v, tuple | list):
        return ",".join(map(_written, v))
    return str(v).upper() if isinstance(v, bool) else f"{v:g}" if isinstance(v, float) else str(v)


def _named(pattern: str, params: dict) -> str | None:
    """The file name with the parameters' values; None if one is missing."""
    for k in re.findall(r"<(\w+)>", pattern):
        if params.get(k) is None:
            return None
        v = params[k]
        pattern = pattern.replace(f"<{k}>", "_".join(map(_written, v)) if isinstance(v, tuple | list) else _written(v))
    return pattern


def _there(spark: SparkSession, folder: str) -> set[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    return {s.getPath().getName() for s in fs.listStatus(path)}


def read_parameters(spark: SparkSession, path: str) -> dict:
    """Lines of name and value: numbers where they parse, TRUE and FALSE as logical values, lists at commas."""

    def value(x: str):
        if x in ("TRUE", "FALSE"):
            return x == "TRUE"
        try:
            number = float(x)
        except ValueError:
            return x
        return int(number) if number.is_integer() else number

    out = {}
    for row in spark.read.text(path).collect():  # a line per parameter
        name, _, text = row.value.partition("\t")
        if name:
            out[name] = tuple(value(x.strip()) for x in text.split(",")) if name in ("motif_length", "lcminove", "gcminove") else value(text)
    return out


def load_text(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables and parameters of a run in text form, of this package or of the original's three layouts.

    ``parameter.txt`` must be there; which layout it is tells ``gliph_version`` (none, 1 or 2) in it. Every other file
    may be missing, and the newer file names are taken where the layout's own are absent. The sample log comes as sim, motif, n, from
    a row per simulation as well.
    """
    there = _there(spark, folder)
    if PARAMETERS not in there:
        raise FileNotFoundError(f"{folder}/{PARAMETERS}")
    params = read_parameters(spark, f"{folder}/{PARAMETERS}")
    version = params.get("gliph_version")
    if version not in OTHER_FILES:
        raise ValueError(f"unknown gliph_version {version}")
    found = {}
    for name in dict.fromkeys([*FILES, *OTHER_FILES[version]]):
        for pattern in (OTHER_FILES[version].get(name), FILES.get(name)):
            file = _named(pattern, params) if pattern else None
            if file in there:
                found[name] = _read_text(spark, f"{folder}/{file}", name)
                break
    return found, params


def _read_text(spark: SparkSession, path: str, name: str) -> DataFrame:
    if name == "sample_log":
        head = spark.read.text(path).first()
        if head is not None and head.value.split("\t") != ["sim", "motif", "n"]:
            return _wide_log(spark, path, head.value)
    df = spark.read.csv(path, sep="\t", header=name != "connections", inferSchema=name != "connections", nullValue="NA", quote="")
    return df.toDF(*("v1", "v2", "type", "cluster_tag")[: len(df.columns)]) if name == "connections" else df


def _wide_log(spark: SparkSession, path: str, head: str) -> DataFrame:
    """A row per simulation, its name first, and a column per motif -> sim, motif, n without zero rows."""
    names = spark.createDataFrame([(head.split("\t"),)], "names array<string>")  # one row
    lines = spark.read.text(path).filter(F.col("value") != head).withColumn("v", F.split("value", "\t"))
    own = F.slice("v", F.size("v") - F.size("names") + 1, F.size("names"))
    rows = lines.crossJoin(F.broadcast(names)).select(F.col("v")[0].cast("int").alias("sim"), F.inline(F.arrays_zip(F.col("names").alias("motif"), own.alias("n"))))
    return rows.select("sim", "motif", F.col("n").cast("bigint").alias("n")).filter("n > 0")


def load(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], Params]:
    """The tables that are there, and the parameters, which must be; of the Parquet form."""
    there = _there(spark, folder)
    raw = json.loads(spark.read.text(f"{folder}/parameters").first().value)
    params = Params(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES if name in there}, params


def one_group(tables: dict[str, DataFrame], tag: str) -> DataFrame:
    """The member rows of one group."""
    return tables["cluster_members"].filter(F.col("tag") == tag).drop("tag")


def convert_reference(spark: SparkSession, sequences: str, v_usage: str, lengths: str, into: str, name: str) -> None:
    """Header-less tab-separated lists of a reference (sequence and V gene, V gene shares, length shares) to Parquet by ref_name."""
    for path, kind, schema in ((sequences, "refseqs", "CDR3b string, TRBV string"), (v_usage, "vgene_frequencies", "vgene string, freq double"), (lengths, "cdr3_length_frequencies", "len int, freq double")):
        spark.read.csv(path, sep="\t", schema=schema).write.mode("overwrite").parquet(f"{into}/{kind}/ref_name={name}")


#: References of this session, by folder and name.
_CACHE: dict[tuple[str, str, str], dict[str, DataFrame]] = {}


def named_reference(spark: SparkSession, folder: str, name: str, again: bool = False) -> dict[str, DataFrame]:
    """refseqs (CDR3b, TRBV), vgene_frequencies and cdr3_length_frequencies of a reference that ``convert_reference`` wrote.

    The name must be one of REFERENCE_NAMES. Tables are kept for the session, in memory or on disk, unless ``again``.
    """
    if name not in REFERENCE_NAMES:
        raise ValueError(f"the reference must be one of {', '.join(REFERENCE_NAMES)}")
    key = (spark.sparkContext.applicationId, folder, name)
    if again:
        for df in _CACHE.pop(key, {}).values():
            df.unpersist()
    if key not in _CACHE:
        kinds = ("refseqs", "vgene_frequencies", "cdr3_length_frequencies")
        _CACHE[key] = {k: spark.read.parquet(f"{folder}/{k}/ref_name={name}").persist() for k in kinds}
    return _CACHE[key]


def contig_repertoire(contigs: DataFrame, chain: str = "TRB") -> DataFrame:
    """barcode, CDR3b, TRBV, patient of assembled contigs (barcode, chain, v_gene, cdr3): one chain, rows with a sequence.

    patient is the barcode up to its first underscore.
    """
    own = contigs.filter((F.col("chain") == chain) & F.col("cdr3").isNotNull() & ~F.col("cdr3").isin("", "None", "NA"))
    return own.select("barcode", F.col("cdr3").alias("CDR3b"), F.col("v_gene").alias("TRBV"), F.regexp_replace("barcode", "_.*", "").alias("patient"))


def save_new_sequences(folder: str, tag: str, sequences: DataFrame, overwrite: bool = False) -> None:
    """``<tag>_de_novo.txt``: tab-separated with a header, in order."""
    one = sequences.coalesce(1).orderBy("rank")  # at most num_tops rows
    one.write.mode("overwrite" if overwrite else "errorifexists").option("sep", "\t").option("header", True).csv(f"{folder}/{tag}_de_novo.txt")
