import random
from collections import Counter

import numpy as np
import pyarrow as pa

from clonelake.operators import dense


def test_sums_by_range(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([0, 5, 65_535, 65_536, 3_000_000_000, rnd.randrange(10**6)]), rnd.randrange(5), rnd.randrange(3)) for _ in range(5000)]
    got = {r.id: (r.a, r.b) for r in dense.block_sums(spark.createDataFrame(rows, "id long, a long, b long"), ["a", "b"]).collect()}
    a, b = Counter(), Counter()
    for i, x, y in rows:
        a[i] += x
        b[i] += y
    assert got == {i: (a[i], b[i]) for i in {r[0] for r in rows}}
    assert dense.block_sums(spark.createDataFrame([], "id long, a long"), ["a"]).count() == 0


def test_blocks_grow_with_rows_only(monkeypatch):
    monkeypatch.setattr(dense, "HELD", 1000)
    ids = np.random.default_rng(1).integers(0, 10**12, 10_000)
    batches = [pa.record_batch([pa.array(x), pa.array(np.ones(len(x), dtype=np.int64))], names=["id", "n"]) for x in np.array_split(ids, 40)]
    out = list(dense._blocks(iter(batches)))
    assert sum(sum(x.as_py()) for b in out for x in b.column(2)) == 10_000
    assert max(b.nbytes for b in out) < 60_000


def test_dictionary(spark):
    df = spark.createDataFrame([(x, y) for x in "abc" for y in [None, "", "q", "q"]], "f string, t string")
    rows = dense.dictionary(df, ["f", "t"]).collect()
    assert sorted(r.id for r in rows) == list(range(9)) and len({(r.f, r.t) for r in rows}) == 9
