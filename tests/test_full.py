"""Whole runs, their options, and what is drawn and saved."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sqlcheck import FOLDER

from clonelake import schema
from clonelake.functions.stats import draws, lines, ranks
from clonelake.functions.text import scientific
from clonelake.operators import motifs, network, resampling, scoring
from clonelake.params import Params, share_table
from clonelake.plans import reference_queries as q
from clonelake.plans.pipeline import run
from clonelake.sources import results


def test_draws_as_many_as_the_compared_sequences(spark):
    want = q._known(spark, FOLDER).count()
    assert want < q._sample(spark, FOLDER).count()
    drawn = q.QUERIES["subsample_srswor"](spark, FOLDER).groupBy("sim").agg(F.count_distinct("cdr3b").alias("n")).collect()
    assert [r.n for r in drawn] == [want] * q.DRAWN


def test_every_group_has_a_matrix(spark):
    groups = q._groups(spark, FOLDER).filter(F.length("CDR3b") >= 10).select("tag").distinct()
    for name in ("pwm_scoring", "pwm_prediction"):
        tags = q.QUERIES[name](spark, FOLDER).select("tag").distinct()
        assert groups.exceptAll(tags).count() == tags.exceptAll(groups).count() == 0 < groups.count()


def test_random_numbers_are_even():
    u = draws(range(100), "x", 0, 2000)
    assert abs(u.mean() - 0.5) < 0.005 and abs(u.var() * 12 - 1) < 0.02
    cells = np.histogram(u, 50, (0, 1))[0]
    assert ((cells - 4000) ** 2 / 4000).sum() < 100
    assert 60 < (u < 0.05).sum(axis=1).var() < 140  # 95 if draws are independent
    assert (draws(range(100), "x", 500, 510) == u[:, 500:510]).all()
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 2**31 - 1, (2, 2000))
    of = lines(range(200))
    first = np.array([np.argsort(ranks(x, y, of[:, s]))[:500] for s in range(200)])
    hits = np.bincount(first.ravel(), minlength=2000)
    assert 25 < hits.var() < 50  # 37.5 for independent samples


@pytest.mark.parametrize("split", [500_000, 40])
def test_samples_are_the_first_ranks(spark, monkeypatch, split):
    pool = [(f"CAS{a}{b}{c}QYF", "AC"[(ord(a) + ord(b)) % 2]) for a in "ACDEFGHIK" for b in "LMNPQRST" for c in "VWYA"]
    df = spark.createDataFrame(pool, "s string, k string")
    wanted = spark.createDataFrame([("A", 20), ("C", 200), ("Z", 7)], "k string, want int")
    numbers = {s: [int(resampling_md5(s)[8 * i : 8 * i + 8], 16) % (2**31 - 1) for i in (0, 1)] for s, _ in pool}
    monkeypatch.setattr(resampling, "SPLIT", split)
    got = {(r["sim"], r.s) for r in resampling.stratified_subsample(df, "s", ["k"], wanted, 7).collect()}
    plain = {(r["sim"], r.s) for r in resampling.subsample(df, "s", 7, 100).collect()}
    of = lines(range(7))
    for sim in range(7):
        rank = {s: int(ranks(np.array([x]), np.array([y]), of[:, sim])[0]) for s, (x, y) in numbers.items()}
        order = sorted(rank, key=rank.get)
        kind = dict(pool)
        first = [s for s in order if kind[s] == "A"][:20] + [s for s in order if kind[s] == "C"][:200]
        rest = [s for s in order if s not in set(first)][: 227 - len(first)]
        assert {s for i, s in got if i == sim} == set(first + rest)
        assert {s for i, s in plain if i == sim} == set(order[:100])


def resampling_md5(s):
    import hashlib

    return hashlib.md5(s.encode()).hexdigest()


def test_motifs_of_samples(spark, monkeypatch):
    seqs = sorted({f"{a}{b}{a}GG{c}" for a in "ACDEF" for b in "GHIKL" for c in ["", "GG", "LMNPQ"]})
    pool = spark.createDataFrame([(s, s) for s in seqs], "CDR3b string, mr string")
    for split in (500_000, 30):
        monkeypatch.setattr(resampling, "SPLIT", split)
        monkeypatch.setattr(resampling, "PART", split)
        samples = resampling.reference_samples(pool, 40, 130, lengths=(2, 3), dotted=True)
        drawn = Counter()
        for r in resampling.subsample(pool, "CDR3b", 130, 40).collect():
            for k, dots in ((2, False), (3, False), (3, True), (4, True)):
                for i in range(len(r.CDR3b) - k + 1):
                    m = r.CDR3b[i : i + k]
                    for w in [m[:j] + "." + m[j + 1 :] for j in range(1, k - 1)] if dots else [m]:
                        drawn[r["sim"], w] += 1
        log = {(r["sim"], r.motif): r.n for r in resampling.sample_log(samples, motifs.find_motifs(pool, "mr", (2, 3), dotted=True)).collect()}
        assert log == dict(drawn)
        found = motifs.find_motifs(pool, "mr", (2, 3), dotted=True).withColumn("counts", F.expr("cast(n / 2 as bigint)"))
        for listed in (10**6, 0):
            monkeypatch.setattr(resampling, "LISTED", listed)
            stats = {r.motif: (r.t, r.m, r.a) for r in samples.compared(found.select("motif", "counts")).groupBy("motif").agg(F.sum("total").alias("t"), F.max("top").alias("m"), F.sum("above").alias("a")).collect()}
            for r in found.collect():
                own = [drawn.get((s, r.motif), 0) for s in range(130)]
                assert stats.get(r.motif, (0, 0, 0)) == (sum(own), max(own), sum(n >= r.counts for n in own) if r.counts else stats[r.motif][2])


def test_scientific(spark):
    values = [0.0, 1.0, 0.25, 0.0625, 0.00115, 9.96e-7, 123456.0, 5e-324, 0.099999999]
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "x double").select(scientific(F.col("x"))).collect()]
    assert got[:7] == ["0.0e+00", "1.0e+00", "2.5e-01", "6.3e-02", "1.2e-03", "1.0e-06", "1.2e+05"] and got[8] == "1.0e-01"


def test_large_groups_are_drawn_as_counts(monkeypatch):
    bounds = np.array([0.5, 0.9, 1.0])
    whole = {n: t.copy() for n, t in scoring._drawn([3, 40, 500], range(60), "s", bounds)}
    monkeypatch.setattr(scoring, "DRAWS", 100)
    again = {n: t.copy() for n, t in scoring._drawn([3, 40, 500], range(60), "s", bounds)}
    for place, size in enumerate((3, 40, 500)):
        assert (whole[place].sum(axis=1) == size).all() and (again[place].sum(axis=1) == size).all()
        assert abs(again[place].mean(axis=0)[0] / size - 0.5) < 0.1
    assert (whole[0] == again[0]).all() and (whole[1] == again[1]).all()  # steps change nothing


def test_totals_hold_all_five_factors(spark):
    groups, rows = q._groups(spark, FOLDER), q._rows(spark, FOLDER)
    score = lambda df: {r.tag: r.score for r in df.collect()}
    part = [
        score(scoring.length_score(groups, q._length_freqs(spark, FOLDER), q.SIMS, 2)),
        score(scoring.clonal_score(groups, rows, q.SIMS)),
        score(scoring.hla_score(groups, rows)),
        score(q._sizes(spark, FOLDER)),
        score(scoring.vgene_score(groups, q._vgene_freqs(spark, FOLDER), q.SIMS, 2)),
    ]
    total = score(q.QUERIES["score_total_v2"](spark, FOLDER))
    for tag, x in total.items():
        assert abs(x - math.prod(p.get(tag, 1.0) for p in part)) < 1e-6
    assert any(abs(total[t] - part[0][t] * part[1][t] * part[2][t]) > 1e-4 for t in total)


def _repertoire(spark):
    rows = []
    for i, (a, b) in enumerate((a, b) for a in "LRKMT" for b in "TNDS"):
        rows.append((i, f"CASS{a}GQG{b}EQYF", f"TRBV{i % 3}", f"P{i % 4}", "A*02:01,B*07" if i % 2 else None, float(i % 3 + 1)))
    rows += [(100 + i, s, "TRBV1", "P9", "A*02:01", 1.0) for i, s in enumerate(["CASRWWWHHEQFF", "CASRWWWHHEQFF", "CAWPNTYMMKLFF"])]
    return spark.createDataFrame(rows, "seq_ID long, CDR3b string, TRBV string, patient string, HLA string, counts double")


def _reference(spark):
    return spark.createDataFrame([(f"CASS{a}{b}PTN{c}LFF", f"TRBV{i % 5}") for i, (a, b, c) in enumerate((a, b, c) for a in "LRKAVI" for b in "AVILTS" for c in "KE")], "CDR3b string, TRBV string")


BASE = dict(lcminove=(1,), lcminp=1.1, kmer_mindepth=2, scoring_sim_depth=20)


def test_tags_and_rows_of_the_second_kind(spark):
    rep = _repertoire(spark)
    out = run(rep, _reference(spark), Params(**BASE))
    props, rows, edges = (out.tables[t].collect() for t in ("cluster_properties", "cluster_members", "connections"))
    tags = {p.tag for p in props}
    assert {e.cluster_tag for e in edges if e.type != "singleton"} <= tags == {r.tag for r in rows} and any(e.type == "global" for e in edges) and any(e.type == "local" for e in edges)
    ends = {s for e in edges if e.type != "singleton" for s in (e.v1, e.v2)}
    alone = [e for e in edges if e.type == "singleton"]
    want = [r.CDR3b for r in rep.orderBy("seq_ID").collect() if r.CDR3b not in ends]
    assert [e.v1 for e in sorted(alone, key=lambda e: int(e.cluster_tag.split("_")[1]))] == want and len(want) == 3
    assert out.tables["cluster_properties"].columns[-1] == "members"
    for p in props:
        own = {r.CDR3b for r in rows if r.tag == p.tag}
        assert p.members == " ".join(sorted(own)) and p.cluster_size == len(own)
        factors = [p[f"{n}_score"] for n in ("cdr3_length", "vgene", "clonal_expansion", "hla")]
        assert p.total_score == pytest.approx(math.prod(factors))
    gene = run(rep, _reference(spark), Params(global_vgene=True, local_similarities=False, **BASE), score=False)
    for r in gene.tables["cluster_members"].collect():
        assert r.tag.split("_")[1] == r.TRBV
    with pytest.raises(ValueError):
        run(_reference(spark), rep, Params(**BASE))
    with pytest.raises(ValueError):
        run(rep.drop("TRBV"), _reference(spark), Params(global_vgene=True))


def test_only_rows_with_alleles_are_the_pool(spark):
    rep = _repertoire(spark)
    sizes = spark.createDataFrame([(n, s, n * 1000.0 + s) for n in range(1, 101) for s in (12, 23)], "cluster_size int, sample_size int, prob double")
    out = run(rep, _reference(spark), Params(**BASE), cluster_sizes={"original": sizes, "simulated": sizes.withColumn("prob", F.lit(0.5))})
    assert all(p.network_size_score % 1000 == 12 for p in out.tables["cluster_properties"].collect())  # 13 rows have alleles, 23 there are
    other = run(rep, _reference(spark), Params(ref_cluster_size="simulated", **BASE), cluster_sizes={"original": sizes, "simulated": sizes.withColumn("prob", F.lit(0.5))})
    assert {p.network_size_score for p in other.tables["cluster_properties"].collect()} == {0.5}


def test_donors_and_genes_bind_edges(spark):
    rep, ref = _repertoire(spark), _reference(spark)
    base = dict(method="custom", local_similarities=False, local_method="fisher", gccutoff=1, **BASE)
    groups = {}
    for public, match in (("all", "none"), ("none", "none"), ("local", "none"), ("global", "none"), ("all", "global"), ("all", "local")):
        out = run(rep, ref, Params(public_tcrs=public, vgene_match=match, **base), score=False)
        groups[public, match] = out.tables["cluster_members"].collect()
    assert len({r.tag for r in groups["all", "none"]}) == 1
    for key in (("none", "none"), ("local", "none")):  # global edges only, and those stay within donors
        assert all(len({r.patient for r in groups[key] if r.tag == t}) == 1 for t in {r.tag for r in groups[key]}) and groups[key]
    assert len({r.tag for r in groups["global", "none"]}) == len({r.tag for r in groups["all", "local"]}) == 1
    assert all(len({r.TRBV for r in groups["all", "global"] if r.tag == t}) == 1 for t in {r.tag for r in groups["all", "global"]})
    for bad in (dict(public_tcrs="x", method="custom"), dict(public_tcrs="none"), dict(vgene_match="all"), dict(public_tcrs=False)):
        with pytest.raises(ValueError):
            Params(**bad)


def test_tables_of_shares(spark):
    good = spark.createDataFrame([("TRBV1", "0.5"), ("TRBV2", "1")], "v string, f string")
    assert {(r.category, r.freq) for r in share_table(good, "x").collect()} == {("TRBV1", 0.5), ("TRBV2", 1.0)}
    for bad in (good.select("v"), good.limit(0), good.withColumn("f", F.lit("a"))):
        with pytest.raises(ValueError):
            share_table(bad, "x")


def test_text_form_and_layouts(spark, tmp_path):
    folder = str(tmp_path / "own")
    tables = {
        "connections": spark.createDataFrame([("A", "B", "local", "t"), ("C", "C", "singleton", None)], "v1 string, v2 string, type string, cluster_tag string"),
        "cluster_members": spark.createDataFrame([("t", "A", None), ("t", "B", 2.5)], "tag string, CDR3b string, counts double"),
        "sample_log": spark.createDataFrame([(0, "AB", 3)], "sim int, motif string, n long"),
    }
    results.save(folder, tables, Params(sim_depth=7), form="text")
    found, params = results.load_text(spark, folder)
    assert set(found) == set(tables) and params["sim_depth"] == 7 and params["motif_length"] == (2, 3, 4) and params["accept_cf"] is True
    for name in tables:
        assert {tuple(r) for r in found[name].collect()} == {tuple(r) for r in tables[name].collect()}
    assert results.one_group(found, "t").count() == 2
    for version, motif_file, extra in (("1", "kmer_resample_5_minp0.01_ove10_20.txt", {}), ("2", "local_similarities_minp_0.01_minove_10_20_kmer_mindepth_3.txt", {}), (None, "local_similarities_minp_0.01_minove_10_20_kmer_mindepth_4.txt", {"lckmer_mindepth": "4"})):
        old = tmp_path / f"v{version}"
        old.mkdir()
        lines_ = {"motif_length": "2,3", "lcminove": "10,20", "lcminp": "0.01", "sim_depth": "5", "kmer_mindepth": "3", "method": "x"} | extra | ({"gliph_version": version} if version else {})
        (old / "parameter.txt").write_text("".join(f"{k}\t{v}\n" for k, v in lines_.items()))
        (old / motif_file).write_text("motif\tcounts\nABC\t4\n")
        (old / "kmer_resample_5_log.txt").write_text("AB\tCD\n1\t0\t2\n2\t3\t0\n")
        found, params = results.load_text(spark, str(old))
        assert {tuple(r) for r in found["selected_motifs"].collect()} == {("ABC", 4)} and params["lcminove"] == (10, 20) and params["method"] == "x"
        assert {tuple(r) for r in found["sample_log"].collect()} == {(1, "CD", 2), (2, "AB", 3)}
    with pytest.raises(FileNotFoundError):
        results.load_text(spark, str(tmp_path))


def test_named_references_and_contigs(spark, tmp_path):
    for name, text in (("s", "CASSF\tTRBV1\nCAF\tTRBV2\n"), ("v", "TRBV1\t0.5\n"), ("l", "12\t0.25\n")):
        (tmp_path / name).write_text(text)
    into = str(tmp_path / "refs")
    results.convert_reference(spark, *[str(tmp_path / x) for x in "svl"], into, "human_v2.0_CD8")
    got = results.named_reference(spark, into, "human_v2.0_CD8")
    assert got["refseqs"].count() == 2 and got["vgene_frequencies"].first().freq == 0.5 and got["cdr3_length_frequencies"].first()["len"] == 12
    assert results.named_reference(spark, into, "human_v2.0_CD8") is got and results.named_reference(spark, into, "human_v2.0_CD8", again=True) is not got
    with pytest.raises(ValueError):
        results.named_reference(spark, into, "x")
    contigs = spark.createDataFrame([("P1_AAA", "TRB", "TRBV1", "CASSF"), ("P1_AAA", "TRA", "TRAV1", "CAVF"), ("P2_BBB", "TRB", "TRBV2", None)], "barcode string, chain string, v_gene string, cdr3 string")
    assert [(r.CDR3b, r.TRBV, r.patient) for r in results.contig_repertoire(contigs).collect()] == [("CASSF", "TRBV1", "P1")]


def test_numbers_without_an_id(spark):
    df = spark.createDataFrame([(f"CAS{a}{b}F",) for a in "DCA" for b in "ACDEFGHIKL"], "CDR3b string")
    got = schema.parse_sequences(df).orderBy("CDR3b").collect()
    assert [r.seq_ID for r in got] == list(range(1, 31))


def test_network_tables(spark):
    members = spark.createDataFrame([("AB", "1", "ABXXXXXAB"), ("AB", "2", "XXXXXXABX"), ("AB", "3", "XXXABXXXX"), ("A.C", "4", "ADCAACX"), ("A.C", "5", "XXXXXAFC")], "motif string, CDR3b string, mr string")
    got = {(r.v1, r.v2, r.motif) for r in network.motif_edges(members, 3).collect()}
    assert got == {("1", "2", "AB"), ("4", "5", "A.C")} - ({("4", "5", "A.C")} if abs(4 - 6) >= 3 else set())
    nodes = spark.createDataFrame([(1, "A", "t", "P1", "V1"), (2, "B", "t", "P1", "V2"), (3, "B", "t", "P2", "V1"), (4, "A", "u", "P2", "V1")], "id long, label string, tag string, patient string, TRBV string")
    edges = spark.createDataFrame([("A", "B", "global")], "v1 string, v2 string, type string")
    pairs = lambda **k: {(r["from"], r["to"]) for r in network.bound_edges(edges, nodes, **k).collect()}
    assert pairs() == {(1, 2), (1, 3)} and pairs(public="none") == {(1, 2)} and pairs(public="global") == {(1, 2), (1, 3)} and pairs(vgene_match="all") == {(1, 3)}
    values = spark.createDataFrame([(i, float(10**i), "ab"[i % 2], None) for i in range(1, 7)], "id int, y double, z string, w double")
    assert network.colour_scale(values, "y") == "log" and network.colour_scale(values, "id") == "linear"
    by_number = [r.color for r in network.coloured(values, "y").orderBy("id").collect()]
    assert by_number[0] == network.RAMP[0] and by_number[-1] == network.RAMP[-1] and len(set(by_number)) == 6
    assert len({r.color for r in network.coloured(values, "z").collect()}) == 2 and {r.color for r in network.coloured(values, "w").collect()} == {"gray"}


def test_options_of_a_run_are_honoured(spark):
    rep = spark.createDataFrame([(f"CASS{a}GQG{b}EQYF",) for a in "LRK" for b in "TND"], "CDR3b string")
    ref = spark.createDataFrame([(f"CASS{a}{b}PTNEKLFF",) for a in "LRKAVI" for b in "AVILTS"] + [(f"CASS{a}GQG{b}EQYF",) for a in "LRKAVI" for b in "DEHW"], "CDR3b string")
    base = dict(lcminove=(1,), lcminp=1.1, kmer_mindepth=1, sim_depth=2, scoring_sim_depth=2)
    out = run(rep, ref, Params(method="gliph1", discontinuous_motifs=True, **base), score=False)
    motifs = {r.motif: r.counts for r in out.tables["all_motifs"].collect()}
    assert motifs["G.G"] == 9 and "G.G" in {r.motif for r in out.tables["selected_motifs"].collect()}
    log = out.tables["sample_log"].collect()
    assert {r.motif for r in log} <= set(motifs) and any("." in r.motif for r in log)
    f = lambda *x: spark.createDataFrame([(s,) for s in x], "fragment string")
    plain = run(rep, ref, Params(**base), score=False).tables["cluster_properties"].filter("type = 'local'")
    boost = run(rep, ref, Params(boost_local_significance=True, **base), score=False, germline=(f("CASS"), f("GG"), f("EQYF"))).tables["cluster_properties"].filter("type = 'local'")
    a, b = ({r.tag: r.p for r in x.collect()} for x in (plain, boost))
    assert a.keys() == b.keys() and all(b[t] <= a[t] for t in a) and any(b[t] < a[t] for t in a)
    for bad in (Params(boost_local_significance=True), Params(method="gliph1", global_method="fisher"), Params(global_method="cutoff")):
        with pytest.raises(ValueError):
            run(rep, ref, bad)
