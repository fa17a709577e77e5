"""Per-key results where a few keys hold most rows.

Method: dense accumulator arrays. Rows lie in equal splits, by the hash of the record and not of the key. Each split
encodes its keys and runs numpy's bincount over the codes, so it gives one count per key it holds, however many rows
the key has. A global dictionary then numbers the keys, the splits' counts become arrays over its numbers, and the
arrays are summed by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonelake.functions.text import not_blank
from clonelake.operators.dense import block_sums, dictionary
from clonelake.session import cut


def _bincount_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, val) rows of one split -> (field, val, n). Memory grows with the split's distinct keys, not its rows."""
    codes: dict[tuple[str, str], int] = {}
    totals = np.zeros(1024, dtype=np.int64)
    for batch in batches:
        fields = batch.column(0).dictionary_encode()
        vals = batch.column(1).dictionary_encode()
        wide = len(vals.dictionary)
        both = fields.indices.to_numpy(zero_copy_only=False).astype(np.int64) * wide + vals.indices.to_numpy(zero_copy_only=False)
        if not len(both):
            continue
        local = np.bincount(both, minlength=wide * len(fields.dictionary))
        at = np.flatnonzero(local)
        names, keys = fields.dictionary.to_pylist(), vals.dictionary.to_pylist()
        ids = np.fromiter((codes.setdefault((names[x // wide], keys[x % wide]), len(codes)) for x in at), dtype=np.int64, count=len(at))
        if len(codes) > len(totals):
            totals = np.concatenate([totals, np.zeros(max(len(codes), len(totals)), dtype=np.int64)])
        np.add.at(totals, ids, local[at])
    if codes:
        names, keys = zip(*codes, strict=True)
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(keys, pa.string()), pa.array(totals[: len(codes)])], names=["field", "val", "n"])


def count_by_key(rows: DataFrame) -> DataFrame:
    """(field, val) rows, in splits of about equal size -> (field, val, n)."""
    splits = cut(rows.mapInArrow(_bincount_split, "field string, val string, n bigint"))  # a row per split and key
    keys = cut(dictionary(splits, ["field", "val"]))
    sums = block_sums(splits.join(keys, ["field", "val"]), ["n"])
    return keys.join(sums, "id").select("field", "val", "n")


def _keys(df: DataFrame, fields: list[str], *more: str) -> DataFrame:
    """One row per record and field, with the keys that are neither null nor blank."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("val")) for f in fields])
    return df.select(*more, F.inline(pairs)).filter(not_blank("val"))


def balanced_key_stats(records: DataFrame, fields: list[str], record: str, distinct_of: str | None = None) -> DataFrame:
    """Per key of each field: records, distinct values, and its share of the field's records.

    records: rows with ``record`` (an id; a record delivered twice counts once), the key columns ``fields`` and
    ``distinct_of``. Gives field, val (as stored), records, share, and distinct_values if ``distinct_of`` is given
    (null values of it don't count). Null and blank keys are no keys. An empty table gives no rows.
    """
    once = records.select(F.col(f"`{record}`").alias("__r"), *[F.col(f"`{f}`") for f in dict.fromkeys(fields)]).distinct()
    counts = count_by_key(_keys(once, fields)).withColumnRenamed("n", "records")
    totals = counts.groupBy("field").agg(F.sum("records").alias("__all"))
    out = counts.join(F.broadcast(totals), "field")  # a row per field name
    out = out.select("field", "val", "records", (F.col("records") / F.col("__all")).alias("share"))
    if distinct_of is None:
        return out
    # hot keys spread by the value that is counted: the hash of (key, value) makes splits equal
    apart = _keys(records.select(*[F.col(f"`{f}`") for f in fields], F.col(f"`{distinct_of}`").alias("__v")).filter("__v is not null"), fields, "__v").distinct()
    values = count_by_key(apart.select("field", "val")).withColumnRenamed("n", "distinct_values")
    return out.join(values, ["field", "val"], "left").select("field", "val", "records", "share", F.coalesce("distinct_values", F.lit(0)).cast("bigint").alias("distinct_values"))


def heavy_keys(records: DataFrame, fields: list[str], record: str, percent: int = 5) -> DataFrame:
    """field, val of the keys that hold at least ``percent`` % of the records having such a key."""
    stats = balanced_key_stats(records, fields, record)
    return stats.filter(F.col("share") * 100 >= percent - 1e-9).select("field", "val")
