"""Queries of the operators of this subpackage, with their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonelake.functions.text import clean, is_sequence, not_blank
from clonelake.llm.bpe import count_tokens, encode_texts
from clonelake.llm.canonical import reference_names, resolve_values
from clonelake.llm.components import connected_components
from clonelake.llm.frequencies import marked, term_frequencies
from clonelake.llm.mixing import Mix, mix_sources
from clonelake.llm.near import near_groups, near_pairs
from clonelake.llm.sampling import Sample, proportional_sample
from clonelake.llm.sentences import split_sentences
from clonelake.llm.vgenes import BETA
from clonelake.session import cut
from clonelake.sources.tables import clone_records, table


def _sample(spark: SparkSession, sf: str) -> Sample:
    clones = table(spark, sf, "cdr3_sequences", "TRBV", "CDR3b").withColumn("CDR3b", clean("CDR3b")).filter(is_sequence(F.col("CDR3b")))
    return proportional_sample(clones, "TRBV", "CDR3b", table(spark, sf, "trbv_targets"), "target_share", "min_rows")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    short = F.array_compact(F.array(F.when(F.col("short_target"), "target"), F.when(F.col("short_minimum"), "minimum")))
    return _sample(spark, sf).report.select(F.col("TRBV").alias("trbv"), F.explode(short).alias("short_of"))


def p1_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf).rows.select(F.col("TRBV").alias("trbv"), F.col("CDR3b").alias("cdr3b"))


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf).report.select(F.col("TRBV").alias("trbv"), "available", "quota", "min_rows", "taken", F.round("share", 9).alias("share"), "short_target", "short_minimum")


def _frequencies(spark: SparkSession, sf: str) -> DataFrame:
    motifs = table(spark, sf, "all_motifs", "run_id", "motif")
    clones = clone_records(spark, sf, "TRBV", "patient")
    rows = motifs.select(F.lit("motif").alias("field"), clean("motif").alias("term"), F.col("run_id").cast("string").alias("record")).unionByName(
        clones.filter(not_blank("TRBV")).select(F.lit("TRBV").alias("field"), clean("TRBV").alias("term"), F.col("patient").alias("record"))
    )
    totals = motifs.agg(F.countDistinct("run_id").alias("all")).select(F.lit("motif").alias("field"), "all")
    totals = totals.unionByName(table(spark, sf, "cdr3_sequences", "patient").agg(F.countDistinct("patient").alias("all")).select(F.lit("TRBV").alias("field"), "all"))
    return marked(term_frequencies(rows), totals, 3, {"motif": 30, "TRBV": 80})


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _frequencies(spark, sf).filter("mark is not null").select("field", "term", "mark")


def p2_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return _frequencies(spark, sf).select("field", "term", "occurrences", "records", "mark")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return connected_components(table(spark, sf, "clone_network", "V1", "V2"), clean("V1"), clean("V2"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    genes = table(spark, sf, "vgene_frequencies", "vgene")
    names = reference_names(genes, "vgene")  # checks the size of the list, so it may be broadcast
    typed = clone_records(spark, sf, "TRBV").filter(not_blank("TRBV"))
    typed = typed.join(F.broadcast(genes.select(F.col("vgene").alias("TRBV"))), "TRBV", "left_anti")
    return resolve_values(typed, "TRBV", names, rules=BETA).select(F.col("seq_ID").alias("seq_id"), "gene")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    clones = table(spark, sf, "cdr3_sequences", "CDR3b").select(clean("CDR3b").alias("s"))
    return near_pairs(clones, "s").select(F.col("a").alias("cdr3_a"), F.col("b").alias("cdr3_b"))


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    clones = table(spark, sf, "cdr3_sequences", "CDR3b").select(clean("CDR3b").alias("s"))
    return near_groups(clones, "s").select(F.col("member").alias("cdr3b"), "grp", "links")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


def _mix(spark: SparkSession, sf: str) -> Mix:
    weights = table(spark, sf, "mix_weights")
    listed = table(spark, sf, "documents", "doc_id", "source", "text").join(weights.select("source"), "source", "left_semi")
    sizes = cut(count_tokens(listed, ["doc_id", "source"], "text"))
    return mix_sources(sizes, "doc_id", "source", "tokens", weights)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report.filter("exhausted").select("source")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).rows.select("doc_id", "source", "repeat", "tokens")


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report.select("source", "weight", "own", "target", "capacity", "exhausted", "taken", F.round("share", 6).alias("share"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_sentences(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_sample": p1_sample,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_frequencies": p2_frequencies,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_mix": p9_mix,
    "p9_report": p9_report,
    "p10_found": p10_found,
}

_CLEAN = "upper(trim({}, ' ' || chr(9) || chr(160)))"
_P1 = f"""
WITH pool AS (SELECT DISTINCT TRBV AS t, {_CLEAN.format("CDR3b")} AS s FROM cdr3_sequences WHERE TRBV IN (SELECT TRBV FROM trbv_targets)),
v AS (SELECT t, count(*) AS n FROM pool WHERE regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWY]+') GROUP BY t),
z AS (SELECT coalesce(sum(n), 0)::BIGINT // 5 AS size FROM v),
r AS (SELECT TRBV AS trbv, coalesce(n, 0) AS available, round(target_share * 1000)::BIGINT * size AS goal, min_rows::BIGINT AS min_rows, target_share, size
      FROM trbv_targets LEFT JOIN v ON t = TRBV CROSS JOIN z)"""
_P6 = f"""
WITH v AS (SELECT DISTINCT {_CLEAN.format("CDR3b")} AS s FROM cdr3_sequences),
u AS (SELECT s FROM v WHERE regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWY]+')),
e(i, j) AS (SELECT a, b FROM range(0, 21) x(a), range(0, 21) y(b) WHERE (a = 0 AND b = 0) OR (a > 0 AND (b = 0 OR b > a))),
k AS (SELECT DISTINCT s, CASE WHEN i = 0 THEN s WHEN j = 0 THEN s[:i - 1] || s[i + 1:] ELSE s[:i - 1] || s[i + 1:j - 1] || s[j + 1:] END AS x
      FROM u, e WHERE greatest(i, j) <= length(s) AND (i > 0)::INT + (j > 0)::INT <= length(s) // 7)
SELECT DISTINCT a.s AS cdr3_a, b.s AS cdr3_b FROM k a JOIN k b ON a.x = b.x AND a.s < b.s
WHERE 7 * damerau_levenshtein(a.s, b.s) <= greatest(length(a.s), length(b.s))"""
_P2 = f"""
WITH c AS (SELECT DISTINCT seq_ID, TRBV, patient FROM cdr3_sequences),
r AS (SELECT 'motif' AS field, {_CLEAN.format("motif")} AS term, run_id::VARCHAR AS record FROM all_motifs
      UNION ALL SELECT 'TRBV', {_CLEAN.format("TRBV")}, patient FROM c WHERE {_CLEAN.format("TRBV")} <> ''),
g AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT record) AS records FROM r WHERE term IS NOT NULL GROUP BY ALL),
m AS (SELECT field, term, occurrences, records, CASE WHEN records < 3 THEN 'rare'
  WHEN field = 'motif' AND records * 100 >= 30 * (SELECT count(DISTINCT run_id) FROM all_motifs) THEN 'common'
  WHEN field = 'TRBV' AND records * 100 >= 80 * (SELECT count(DISTINCT patient) FROM cdr3_sequences) THEN 'common' END AS mark FROM g)"""
SQL = {
    "p1_found": _P1 + " SELECT trbv, 'target' AS short_of FROM r WHERE available * 1000 < goal UNION ALL SELECT trbv, 'minimum' FROM r WHERE available < min_rows",
    "p1_report": _P1
    + """, k AS (SELECT *, least(min_rows, available)::DOUBLE AS lo, available::DOUBLE AS hi, least(min_rows, available) / target_share AS a, available / target_share AS z FROM r),
b AS (SELECT DISTINCT v FROM (SELECT 0.0::DOUBLE AS v UNION ALL SELECT a FROM k WHERE target_share > 0 UNION ALL SELECT z FROM k WHERE target_share > 0)),
f AS (SELECT v, sum(CASE WHEN target_share > 0 THEN least(greatest(target_share * v, lo), hi) ELSE lo END) AS total, sum(CASE WHEN target_share > 0 AND a <= v AND z > v THEN target_share ELSE 0.0 END) AS slope FROM b, k GROUP BY v),
t AS (SELECT max(size) AS size, sum(lo) AS los, sum(hi) AS his FROM k),
h AS (SELECT v + CASE WHEN slope > 1e-15 THEN (size - total) / slope ELSE 0 END AS height FROM f, t WHERE total <= size ORDER BY v DESC LIMIT 1),
q AS (SELECT k.*, CASE WHEN his <= t.size THEN hi WHEN los >= t.size THEN lo ELSE least(greatest(target_share * (SELECT height FROM h), lo), hi) END AS q FROM k, t),
w AS (SELECT *, floor(q + 1e-9)::BIGINT AS base FROM q),
o AS (SELECT *, CASE WHEN base < available THEN row_number() OVER (PARTITION BY base < available ORDER BY round(q - base, 9) DESC, trbv) END AS nth,
  least(round(sum(q) OVER ()), greatest(size, sum(base) OVER ()))::BIGINT - (sum(base) OVER ())::BIGINT AS more FROM w),
u AS (SELECT *, base + CASE WHEN nth <= more THEN 1 ELSE 0 END AS quota FROM o)
SELECT trbv, available, quota, min_rows, quota AS taken, round(quota / sum(quota) OVER (), 9) AS share, available * 1000 < goal AS short_target, available < min_rows AS short_minimum FROM u""",
    "p6_found": _P6,
    "p6_groups": f"""
WITH RECURSIVE pr AS ({_P6}), v AS (SELECT DISTINCT {_CLEAN.format("CDR3b")} AS s FROM cdr3_sequences), u AS (SELECT s FROM v WHERE regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWY]+')),
l AS (SELECT cdr3_a AS u, cdr3_b AS v FROM pr UNION ALL SELECT cdr3_b, cdr3_a FROM pr), n AS (SELECT u, count(*) AS links FROM l GROUP BY u),
cc(member, grp) USING KEY (member) AS (
  SELECT s, s FROM u
  UNION
  SELECT l.u, min(n.grp) FROM cc AS n JOIN l ON l.v = n.member JOIN recurring.cc AS o ON o.member = l.u WHERE n.grp < o.grp GROUP BY l.u)
SELECT member AS cdr3b, grp, coalesce(links, 0) AS links FROM cc LEFT JOIN n ON n.u = member""",
    "p2_found": _P2 + " SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p2_frequencies": _P2 + " SELECT * FROM m",
    "p4_found": f"""
WITH RECURSIVE e AS (SELECT {_CLEAN.format("V1")} AS a, {_CLEAN.format("V2")} AS b FROM clone_network),
l AS (SELECT DISTINCT coalesce(a, b) AS u, coalesce(b, a) AS v FROM e WHERE a IS NOT NULL OR b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL
      UNION SELECT a, a FROM e WHERE a IS NOT NULL UNION SELECT b, b FROM e WHERE b IS NOT NULL),
cc(member, grp) USING KEY (member) AS (
  SELECT u, min(v) FROM l GROUP BY u
  UNION
  SELECT l.u, min(n.grp) FROM cc AS n JOIN l ON l.v = n.member JOIN recurring.cc AS o ON o.member = l.u WHERE n.grp < o.grp GROUP BY l.u)
SELECT member, grp FROM cc""",
}
