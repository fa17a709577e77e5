"""Readers for the tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table of ``folder``; only ``columns`` if given, so that the scan reads no others."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def clone_records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Records of cdr3_sequences: a row that was delivered twice counts once.

    Deliveries of one record have equal content, so distinct over the wanted columns (combined on the map side)
    does what a window over loaded_at would, without a sort.
    """
    return table(spark, folder, "cdr3_sequences", "seq_ID", *columns).distinct()
