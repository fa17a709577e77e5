from collections import Counter

from clonelake.operators.balanced import balanced_key_stats, heavy_keys


def test_counts_with_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}", None if i % 7 == 0 else f"d{i % 4}", f"S{i % 11}") for i in range(3000)]
    rows += rows[:500] + [(9001, None, "", None), (9002, " \xa0", "d1", "S1")]
    df = spark.createDataFrame(rows, "id int, a string, b string, s string")
    once = set(rows)
    got = {(r.field, r.val): (r.records, r.distinct_values) for r in balanced_key_stats(df, ["a", "b"], "id", "s").collect()}
    for field, at in (("a", 1), ("b", 2)):
        keys = [r for r in once if r[at] and r[at].strip(" \t\xa0")]
        n = Counter(r[at] for r in keys)
        for k in n:
            assert got[field, k] == (n[k], len({r[3] for r in keys if r[at] == k and r[3] is not None}))
        assert {k for f, k in got if f == field} == set(n)
    assert ("a", "hot") in {tuple(r) for r in heavy_keys(df, ["a"], "id").collect()}


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "id int, field string, val string")
    assert balanced_key_stats(df, ["field", "val"], "id").count() == 0
    df = spark.createDataFrame([(1, "x", "y"), (2, "x", "z")], "id int, field string, val string")
    assert {tuple(r) for r in heavy_keys(df, ["field", "val"], "id").collect()} == {("field", "x"), ("val", "y"), ("val", "z")}
