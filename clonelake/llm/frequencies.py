"""How often every distinct term occurs, and in how many records.

Method: a global dictionary gives each distinct term an integer; terms are encoded; each block of rows accumulates
count arrays, for occurrences and for record presence; the arrays are summed by range of identifiers.

Records fall into blocks by their hash; a hot term is one row per block when it meets the dictionary and one array cell
after that, so no task gets all rows of a term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonelake.operators.dense import block_sums, dictionary

#: Blocks of records.
BLOCKS = 64


def term_frequencies(rows: DataFrame) -> DataFrame:
    """rows: field, term, record -> field, term, occurrences, records.

    Each row with a term is an occurrence; records are the distinct non-null ``record`` values having the term, so a
    term whose records are all null has 0. Null terms are none; the empty string is a term like any other.
    """
    pairs = rows.select("field", "term", "record").filter("term is not null").groupBy("field", "term", "record").agg(F.count("*").alias("n"))
    words = dictionary(pairs, ["field", "term"])
    # at most BLOCKS rows per term, however many records hold it, before the terms meet the dictionary
    block = F.pmod(F.xxhash64("record"), F.lit(BLOCKS)).alias("block")
    blocks = pairs.groupBy("field", "term", block).agg(F.sum("n").alias("n"), F.count("record").alias("present"))
    counts = block_sums(blocks.join(words, ["field", "term"]).select("id", "n", "present"), ["n", "present"])
    return words.join(counts, "id").select("field", "term", F.col("n").alias("occurrences"), F.col("present").alias("records"))


def marked(frequencies: DataFrame, totals: DataFrame, rare_below: int, common_percent: dict[str, int]) -> DataFrame:
    """With ``mark``: 'rare' below ``rare_below`` records, 'common' at the field's percentage of ``totals`` or more, else null.

    totals: field, all (distinct records of the field). A term that is both, in a tiny collection, is rare.
    """
    limit = F.create_map(*[x for f, p in common_percent.items() for x in (F.lit(f), F.lit(p))])[F.col("field")]
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * 100 >= limit * F.col("all"), "common")
    return frequencies.join(F.broadcast(totals), "field").withColumn("mark", mark)  # a row per field name
