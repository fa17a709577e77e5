import math
from fractions import Fraction

import numpy as np
import pytest

from clonelake import schema
from clonelake.functions.stats import hypergeometric_tails, similar_pairs
from clonelake.operators import clusters, germline, graph, motifs, network, resampling, scoring, similarity
from clonelake.params import Params
from clonelake.plans.pipeline import run
from clonelake.sources import results

EIGHT = "CATSWDPGRTHEKLFF CATTVDKGEIFF CASRYMSGGKNTVYF CATRLSGGDETQYF CASKMGGKETEYF CASKMGQTYEQFF CAWSFTTCSVNFGYSF CASKPSGGFEQFF".split()


def seqs(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "CDR3b string")


def test_aliases_and_parsing(spark):
    assert schema.standard_names(["cdr3", "v_gene", "donor"]) == {"cdr3": "CDR3b", "v_gene": "TRBV", "donor": "patient"}
    assert schema.standard_names(["CDR3b", "cdr3"]) == {}
    assert schema.standard_names(["x"]) == {"x": "CDR3b"}
    df = spark.createDataFrame([("CASSF", None, 1), ("CAS*F", "2", 2), (None, "1", 3), ("", "x", 4)], "junction_aa string, frequency string, extra int")
    got = {r.CDR3b: (r.counts, r.extra) for r in schema.parse_sequences(df).collect()}
    assert got == {"CASSF": (1.0, 1), "": (1.0, 4)}
    with pytest.raises(ValueError):
        schema.parse_sequences(spark.createDataFrame([(1, 2)], "a int, b int"))


def test_reference_and_region(spark):
    df = spark.createDataFrame([("CATSWDPGRTHEKLFF", "V1"), ("CATSWDPGRTHEKLFF", "V1"), ("CASF", "V1"), ("AATSWDPGF", "V1"), ("CATSWDPGY", "V2")], "a string, b string")
    assert schema.load_reference(df).count() == 1
    assert schema.load_reference(df, accept_cf=False).count() == 3
    assert {r.mr for r in schema.regions(seqs(spark, ["CATSWDPGRTHEKLFF", "CATTVDKGEIFF", "CASSF"])).collect()} == {"SWDPGRTHEK", "TVDKGE"}


def test_params():
    assert Params(method="gliph1").local_method == "rrs" and Params(method="gliph1", local_method="fisher").local_method == "fisher"
    assert Params(sim_depth=2.6).sim_depth == 3 and Params(min_seq_length=2).min_seq_length == 7
    assert Params().cutoff(100) == 2 and Params().cutoff(125) == 1 and Params(gccutoff=3).cutoff(5) == 3
    for bad in ({"lcminp": 0}, {"sim_depth": 0}, {"hla_cutoff": 2}, {"lcminove": (1, 2)}, {"lcminove": 0}, {"local_similarities": False, "global_similarities": False}, {"gccutoff": -1}, {"accept_cf": 1}, {"method": "x"}, {"n_cores": 0}, {"cluster_min_size": "a"}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_hypergeometric_tail():
    cases = [(c, m, n, k) for m in (0, 1, 5, 40) for n in (0, 3, 60) for k in (0, 2, 30) for c in range(0, 12) if k <= m + n]
    got = hypergeometric_tails(*(np.array(x) for x in zip(*cases, strict=True)))
    for (c, m, n, k), p in zip(cases, got, strict=True):
        want = sum(Fraction(math.comb(m, x) * math.comb(n, k - x), math.comb(m + n, k)) for x in range(max(c, 0, k - n), min(m, k) + 1))
        assert p == pytest.approx(float(want), rel=1e-9, abs=1e-14)
    big = hypergeometric_tails(np.array([60]), np.array([100]), np.array([10**9]), np.array([10**7]))[0]
    assert 0 < big < 1e-60


def test_blosum():
    pairs = similar_pairs()
    assert "AS" in pairs and "SA" in pairs and "WW" in pairs and "AW" not in pairs and len(pairs) == 20 + 2 * 46


def test_motif_counts(spark):
    two = seqs(spark, ["CACAF", "AAA", "", None])
    n = {r.motif: r.n for r in motifs.find_motifs(two, lengths=(2,)).collect()}
    assert n == {"CA": 2, "AC": 1, "AF": 1, "AA": 2}
    dotted = {r.motif: r.n for r in motifs.find_motifs(two, lengths=(2,), dotted=True).collect()}
    assert dotted["C.C"] == 1 and dotted["A.A"] == 2 and dotted["CA"] == 2
    assert motifs.find_motifs(two.limit(0)).count() == 0


def test_local_links_have_the_components_of_all_pairs(spark):
    own = schema.regions(seqs(spark, EIGHT))
    found = motifs.motif_members(own, motifs.find_motifs(own, "mr", (2,)), (2,))
    pairs, links = motifs.local_pairs(found), motifs.local_links(found)
    group = lambda e: {frozenset(m.vertex for m in g) for g in _groups(graph.components(e, "v1", "v2").collect()).values()}
    one = found.filter("motif = 'GG'")
    assert group(motifs.local_pairs(one)) == group(motifs.local_links(one).filter("v1 is not null"))
    assert pairs.count() >= links.distinct().count()


def _groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.component, []).append(r)
    return out


def test_similarity(spark):
    three = ["CATSWAPGRTHEKLFF", "CATSWTPGRTHEKLFF", "CATSWMPGRTHEKLFF"]
    own = schema.regions(seqs(spark, [*three, "CATTVDKGEIFF", "CATTVDKGQIFF"]))
    tags = {r.tag: r.n for r in similarity.struct_counts(own).filter("n > 1").collect()}
    assert tags["SW%PGRTHEK"] == 3
    brute = lambda d: {(a.CDR3b, b.CDR3b) for a in rows for b in rows if a.CDR3b < b.CDR3b and len(a.mr) == len(b.mr) and sum(x != y for x, y in zip(a.mr, b.mr, strict=True)) <= d}
    rows = own.collect()
    for d in range(5):
        assert {(r.v1, r.v2) for r in similarity.hamming_pairs(own, d).collect()} == brute(d)
    assert {r.aas for r in clusters.global_members(own).select("aas").distinct().collect()} == {"AT", "EQ"}


def test_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "e"), ("x", "x"), (None, "q"), ("a", "b")], "u string, v string")
    assert {(r.vertex, r.component) for r in graph.components(edges, "u", "v").collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("x", "x")}
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(120)], "u string, v string")
    assert {r.component for r in graph.components(chain, "u", "v").collect()} == {"n000"}


def test_leader_names(spark):
    rows = spark.createDataFrame([("1", "A", "A"), ("1", "A", "B"), ("2", "A", "A"), ("2", "A", "C")], "comp string, leader string, CDR3b string")
    assert {r.tag for r in clusters.leader_names(rows).collect()} == {"CRG-A", "CRG-A-1"}


def test_stratified_overflow(spark):
    pool = spark.createDataFrame([(f"s{i}", "x" if i < 3 else "y") for i in range(40)], "s string, k string")
    wanted = spark.createDataFrame([("x", 10), ("y", 5)], "k string, want int")
    got = resampling.stratified_subsample(pool, "s", ["k"], wanted, 2)
    assert {r["sim"]: r["count"] for r in got.groupBy("sim").count().collect()} == {0: 15, 1: 15}
    assert got.distinct().count() == 30
    assert resampling.subsample(pool, "s", 2, 1000).count() == 80


def test_germline(spark):
    f = lambda *x: spark.createDataFrame([(v,) for v in x], "fragment string")
    row = germline.germline_ranges(seqs(spark, ["CASSAGGTEQYF"]), f("CAS", "CASS"), f("GG", "G"), f("EQYF", "YF")).first()
    assert (row.start_1, row.stop_1, row.start_2, row.stop_2, row.masked) == (5, 5, 8, 8, "CASSaGGtEQYF")
    none = germline.germline_ranges(seqs(spark, ["QQQ"]), f("CAS"), f("GG"), f("EQYF")).first()
    assert (none.start_1, none.stop_1, none.start_2, none.stop_2, none.masked) == (1, 3, 0, -1, "qqq")
    with pytest.raises(ValueError):
        germline.germline_ranges(seqs(spark, ["QQQ"]), f("CAS"), spark.range(germline.MOST + 1).selectExpr("cast(id as string) AS fragment"), f("EQYF"))


def test_hla(spark):
    rows = spark.createDataFrame(
        [(1, "S1", "P1:a", "A*02:01,B*07:02"), (2, "S2", "P2:a", "A*02:01,B*08:01"), (3, "S3", "P3", "A*03:01"), (4, "S4", "P4", None), (5, "S5", None, "A*01")], "seq_ID long, CDR3b string, patient string, HLA string"
    )
    group = rows.filter("seq_ID < 3").selectExpr("'t' AS tag", "*")
    assert {(r.allele, r.k, r.c, r.h, r.donors): round(r.p, 6) for r in scoring.hla_tests(group, rows).collect()} == {("A*02", 2, 2, 2, 3): round(1 / 3, 6)}
    assert scoring.hla_score(group, rows).first().score == pytest.approx(1 / 3)


def test_pipeline_both_kinds_and_round_trip(spark, tmp_path):
    rows = [(i, s, f"TRBV{i % 2 + 5}", f"P{i % 3}", "A*02:01" if i % 2 else None, float(i % 4)) for i, s in enumerate(EIGHT * 2 + ["CATSWTPGRTHEKLFF", "CATSWMPGRTHEKLFF"])]
    rep = spark.createDataFrame(rows, "seq_ID long, CDR3b string, TRBV string, patient string, HLA string, counts double")
    rng = np.random.default_rng(42)
    ref = seqs(spark, ["C" + "".join(rng.choice(list("ADEGHIKLNPQRSTYV"), rng.integers(8, 14))) + "F" for _ in range(100)])
    for method in ("gliph1", "gliph2"):
        out = run(rep, ref, Params(method=method, lcminove=(1,), lcminp=0.9, kmer_mindepth=1, sim_depth=3, scoring_sim_depth=3))
        props = out.tables["cluster_properties"].collect()
        assert props and all(p.cluster_size >= 2 and 0 < p.total_score <= 1 and p.total_score_text for p in props)
        tags = [p.tag for p in props]
        assert len(tags) == len(set(tags))
    results.save(str(tmp_path / "run"), {"cluster_members": out.tables["cluster_members"]}, out.params)
    for _ in ("parquet",):
        tables, params = results.load(spark, str(tmp_path / "run"))
        assert params == out.params and {r.tag for r in tables["cluster_members"].collect()} == set(tags)
    with pytest.raises(Exception):  # noqa: B017
        results.save(str(tmp_path / "run"), {"cluster_members": out.tables["cluster_members"]}, out.params)


def test_network(spark):
    groups = spark.createDataFrame([("t", "A"), ("t", "B"), ("t", "C"), ("u", "A")], "tag string, CDR3b string")
    rows = spark.createDataFrame([(1, "A", 1.0), (2, "B", 3.0), (3, "C", 5.0)], "seq_ID long, CDR3b string, counts double")
    nodes = network.network_nodes(groups, rows)
    assert {(r.id, r.size) for r in nodes.collect()} == {(1, 12.0), (2, 16.0), (3, 20.0)}
    edges = spark.createDataFrame([("A", "B", "local"), ("B", "A", "global"), ("C", "C", "singleton")], "v1 string, v2 string, type string")
    assert [tuple(r) for r in network.network_edges(edges, nodes).collect()] == [(1, 2, "local")]
