import math

import pytest

from clonelake.operators import denovo

MEMBERS = ["CATSWDPGRTHEKLFF", "CATSWDPKRTHEKLFF", "CATSWDPGETQEKLFF", "CATSWDPQRTHEKLFF", "CATSWDPGRGHEKLFF", "CATSWDPGRGHKLFF"]
REFERENCE = ["CATSWDPGRTHEKLFF", "CATSWTPGRTHEKLFF", "CSVKDMGQGTEQYF", "CASKPGSGVYEQFF"]


def shares(members, place):
    seen = [m[place] for m in members]
    missing = 20 - len(set(seen))
    return {a: seen.count(a) / len(seen) * (1 - missing * 0.005) if a in seen else 0.005 for a in "ACDEFGHIKLMNPQRSTVWY"}


def test_draws_and_ranks(spark):
    own = spark.createDataFrame([("t", m, v) for m, v in zip(MEMBERS, ["V1", "V2", None, "V1", "V1", "V2"], strict=True)] + [("u", "CAF", "V1")], "tag string, CDR3b string, TRBV string")
    refs = spark.createDataFrame(list(zip(REFERENCE, ["V1", "V1", "V2", None], strict=True)), "CDR3b string, TRBV string")
    group = own.filter("tag = 't'")
    new = [r.seq for r in denovo.generate(group, 200).collect()]
    assert len(new) == len(set(new)) > 20
    assert all(s[0] == "C" and s[-1] == "F" and len(s) in (15, 16) for s in new)
    assert sorted(new) == sorted(r.seq for r in denovo.generate(group.repartition(3), 200).collect())
    free = [r.seq for r in denovo.generate(group, 400, accept_cf=False).collect()]
    assert any(s[0] != "C" for s in free) and any(s[-1] != "F" for s in free)
    tables = [shares(MEMBERS, k) for k in range(10)]
    score = lambda s: math.prod(tables[k][s[k]] for k in range(10))
    norm = lambda x: sum(score(r) >= x * (1 - 1e-12) for r in REFERENCE) / len(REFERENCE)
    plain = denovo.new_sequences(own, "t", sims=200, num_tops=15)
    got = plain.sequences.collect()
    assert [r.seq for r in sorted(got, key=lambda r: r.rank)] == sorted(new, key=lambda s: (-round(score(s), 15), s))[:15]
    assert all(r.known == (r.seq in MEMBERS) and r.length == len(r.seq) for r in got)
    assert [r.CDR3b for r in plain.members.orderBy("rank").collect()] == sorted(MEMBERS, key=lambda s: (-round(score(s), 15), s))
    out = denovo.new_sequences(own, "t", refs, normalization=True, sims=200, num_tops=15)
    for r in out.sequences.collect():
        assert math.isclose(r.score, score(r.seq), rel_tol=1e-9) and r.norm == norm(r.score)
    want = sorted(new, key=lambda s: (norm(score(s)), -round(score(s), 15), s))[:15]
    assert [r.seq for r in out.sequences.orderBy("rank").collect()] == want
    genes = dict(zip(REFERENCE, ["V1", "V1", "V2", None], strict=True))
    for r in out.members.collect():
        assert r.norm == sum(score(x) >= r.score * (1 - 1e-12) and genes[x] == r.TRBV and r.TRBV is not None for x in REFERENCE) / len(REFERENCE)
    norms = [r.norm for r in out.members.orderBy("rank").collect()]
    assert norms == sorted(norms)


def test_matrices_of_split_groups(spark, monkeypatch):
    rows = [(f"t{i % 7}", "C" + "ACDEFGHIKL"[i % 10] * (9 + i % 3) + "QF") for i in range(300)]
    df = spark.createDataFrame(rows, "tag string, CDR3b string")
    for part, held in ((1_000_000, 20_000), (10, 7), (40, 50)):
        monkeypatch.setattr(denovo, "PART", part)
        monkeypatch.setattr(denovo, "HELD", held)
        got = {(r.tag, r.pos, r.aa): r.freq for r in denovo.scoring_matrix(df).collect()}
        by_length = {(r.tag, r.len, r.pos, r.aa): r.freq for r in denovo.prediction_matrix(df).collect()}
        for t in range(7):
            own = [s for g, s in rows if g == f"t{t}"]
            for k in range(10):
                for a, f in shares(own, k).items():
                    assert math.isclose(got[f"t{t}", k + 1, a], f)
            for n in {len(s) for s in own}:
                for a, f in shares([s for s in own if len(s) == n], n - 3).items():
                    assert math.isclose(by_length[f"t{t}", n, n - 2, a], f)
        assert len(got) == 7 * 200


def test_refusals(spark):
    own = spark.createDataFrame([("t", "CAF"), ("u", MEMBERS[0]), ("u", "CASSF")], "tag string, CDR3b string")
    for bad in ({"tag": "x"}, {"tag": "t"}, {"tag": "u", "sims": 0}, {"tag": "u", "num_tops": "a"}, {"tag": "u", "normalization": 1}, {"tag": "u", "normalization": True}, {"tag": 3}):
        with pytest.raises(ValueError):
            denovo.new_sequences(own, **bad)
    with pytest.warns(UserWarning):
        assert denovo.new_sequences(own, "u", sims=5).members.count() == 1
