"""Queries p3 and p7: packed fields and uneven keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonelake.functions.text import clean, is_sequence
from clonelake.operators.balanced import balanced_key_stats, heavy_keys
from clonelake.operators.packed import explode_packed
from clonelake.sources.tables import clone_records, table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    hla = explode_packed(clone_records(spark, sf, "HLA").filter("HLA is not null"), "HLA", ["seq_ID"])
    members = explode_packed(table(spark, sf, "local_res", "res_id", "members").distinct(), "members", ["res_id"])
    return hla.select(F.lit("cdr3_sequences").alias("tbl"), F.col("seq_ID").alias("row_id"), "pos", "val").unionByName(
        members.select(F.lit("local_res").alias("tbl"), F.col("res_id").alias("row_id"), "pos", "val")
    )


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_keys(table(spark, sf, "cdr3_sequences", "seq_ID", "TRBV", "patient"), ["TRBV", "patient"], "seq_ID")


def p7_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "cdr3_sequences", "seq_ID", "TRBV", "patient", "CDR3b").withColumn("CDR3b", F.when(is_sequence(clean("CDR3b")), clean("CDR3b")))
    return balanced_key_stats(rows, ["TRBV", "patient"], "seq_ID", "CDR3b").withColumn("share", F.round("share", 9))


QUERIES = {"p3_found": p3_found, "p7_found": p7_found, "p7_stats": p7_stats}

_CLEAN = "upper(trim({}, ' ' || chr(9) || chr(160)))"
_P7 = f"""
WITH r AS (SELECT DISTINCT seq_ID, TRBV, patient FROM cdr3_sequences),
k AS (SELECT 'TRBV' AS field, TRBV AS val FROM r UNION ALL SELECT 'patient', patient FROM r),
g AS (SELECT field, val, count(*) AS records FROM k WHERE {_CLEAN.format("val")} <> '' GROUP BY ALL),
s AS (SELECT field, val, records, sum(records) OVER (PARTITION BY field) AS t FROM g)"""
SQL = {
    "p3_found": r"""
WITH f AS (
  SELECT DISTINCT 'cdr3_sequences' AS tbl, seq_ID AS row_id, HLA AS x FROM cdr3_sequences WHERE HLA IS NOT NULL
  UNION ALL SELECT 'local_res', res_id, members FROM local_res WHERE members IS NOT NULL),
t AS (SELECT tbl, row_id, regexp_replace(x, '^[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g') AS x FROM f),
b AS (SELECT tbl, row_id, CASE WHEN length(x) > 1 AND left(x, 1) || right(x, 1) IN ('()', '[]', '{}') THEN x[2:-2] ELSE x END AS x FROM t),
v AS (SELECT tbl, row_id, regexp_extract_all(x, '"(?:[^"]|"")*"|[^",;|/&+，；、\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+') AS vs FROM b),
w AS (SELECT tbl, row_id, list_filter(list_transform(vs, lambda s: CASE WHEN left(s, 1) = '"' THEN replace(s[2:-2], '""', '"') ELSE s END), lambda s: s <> '') AS vs FROM v),
e AS (SELECT tbl, row_id, unnest(range(1, len(vs) + 1)) AS p, vs FROM w)
SELECT tbl, row_id, p::INTEGER AS pos, vs[p] AS val FROM e""",
    "p7_found": _P7 + " SELECT field, val FROM s WHERE records * 20 >= t",
    "p7_stats": _P7
    + f""",
c AS (SELECT TRBV, patient, {_CLEAN.format("CDR3b")} AS s FROM cdr3_sequences),
d AS (SELECT 'TRBV' AS field, TRBV AS val, s FROM c UNION ALL SELECT 'patient', patient, s FROM c),
n AS (SELECT field, val, count(DISTINCT s) AS n FROM d WHERE regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWY]+') GROUP BY ALL)
SELECT s.field, s.val, s.records, round(s.records / s.t, 9) AS share, coalesce(n.n, 0) AS distinct_values FROM s LEFT JOIN n USING (field, val)""",
}
