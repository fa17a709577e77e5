"""The table of connections: structures are made once, of sequences that share one; ends are found without pairs."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from test_full import BASE, _reference, _repertoire

from clonelake import schema
from clonelake.operators import clusters, dense, motifs, similarity
from clonelake.params import Params
from clonelake.plans.pipeline import run


def _sequences(spark, n=400):
    rnd = random.Random(5)
    texts = {"CAS" + "".join(rnd.choice("LRKT") for _ in range(rnd.randrange(1, 7))) + "YFF" for _ in range(n)}
    return schema.regions(spark.createDataFrame([(t,) for t in texts | {"CASSF", "CASWWWWWWYFF"}], "CDR3b string"))


def test_structures_are_made_once_and_without_the_reference(spark, monkeypatch):
    made = []
    for name in ("struct_members", "struct_counts"):
        plain = getattr(clusters, name)
        monkeypatch.setattr(clusters, name, lambda seqs, plain=plain, name=name: made.append(name) or plain(seqs))
    out = run(_repertoire(spark), _reference(spark), Params(**BASE), score=False)
    assert made.count("struct_members") == 1
    plan = out.tables["connections"]._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "num_in_ref" not in plan  # what the reference tells of a group names no edge


def test_only_sequences_that_share_a_structure_are_kept(spark):
    own = _sequences(spark)
    tags = defaultdict(set)
    for r in own.collect():
        for i, aa in enumerate(r.mr):
            tags[r.mr[:i] + "%" + r.mr[i + 1 :]].add((r.CDR3b, aa, i + 1))
    want = {(t, *x) for t, xs in tags.items() if len(xs) > 1 for x in xs}
    got = similarity.struct_members(own).select("tag", "CDR3b", "aa", "place").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    kept = {r.CDR3b for r in similarity._sharing(own).collect()}
    assert kept >= {x[1] for x in want} and "CASWWWWWWYFF" not in kept
    assert similarity._sharing(own.limit(0)).count() == 0


def test_hashes_of_structures():
    texts = ["LLR", "LTR", "L", "R", "LR", "Lé😀", "Té😀", "LLRLLR"]
    hashes, row = similarity.struct_hashes(texts)
    names = []
    for t in texts:
        names += [t[:i] + "%" + t[i + 1 :] for i in range(len(t))]
    assert [len(t) for t in texts] == [Counter(row.tolist())[i] for i in range(len(texts))]
    assert all((hashes[i] == hashes[j]) == (names[i] == names[j]) for i in range(len(names)) for j in range(len(names)))


def test_kmers_of_any_length_and_letter(spark, monkeypatch):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ACDY") for _ in range(rnd.randrange(20))) for _ in range(200)] + ["AC*é😀AC", "acA", "A" * 40]
    lengths = (1, 2, 4, 5, 14, 15)
    want = Counter(t[i : i + k] for t in texts for k in lengths for i in range(len(t) - k + 1))
    for held in (motifs.HELD, 50):
        monkeypatch.setattr(motifs, "HELD", held)
        got = motifs.find_motifs(spark.createDataFrame([(t,) for t in [*texts, None]], "x string"), "x", lengths).collect()
        assert {r.motif: r.n for r in got} == want and len(got) == len(want)


def test_numbers_follow_the_order(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(50), i) for i in range(3000)] + [(None, -1)]
    got = dense.numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), ["a", "b"], "n", 7).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(rows, key=lambda x: (x[0] is not None, x)) and sorted(r.n for r in got) == list(range(7, 3008))
    plan = dense.numbered(spark.createDataFrame(rows, "a int, b int"), ["a"], "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan  # rows are sorted once


def test_ends_without_pairs(spark):
    own = _sequences(spark, 60)
    members = motifs.motif_members(own, motifs.find_motifs(own, "mr", (2, 3)).filter("n >= 2"), (2, 3)).cache()
    for loose in (False, True):
        rows = clusters.global_members(own, interchangeable=loose).cache()
        for within in (0, 0.5, 1, 2, 3):
            for least in (2, 5):
                tags = clusters.cluster_tags(members, rows, least).cache()
                edges = clusters.local_edges(members, within).unionByName(clusters.global_edges(rows, loose)).join(tags.withColumnRenamed("tag", "cluster_tag"), "cluster_tag", "left_semi")
                want = {r[0] for r in edges.select(F.explode(F.array("v1", "v2"))).distinct().collect()}
                got = [r.CDR3b for r in clusters.edge_ends(members, rows, tags, within).collect()]
                assert set(got) == want and len(got) == len(want), (loose, within, least)
