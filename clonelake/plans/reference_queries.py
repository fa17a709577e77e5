"""Queries of the repertoire operators over the tables of a data folder, with their SQL twins.

The sample is cdr3_sequences and the reference is refseqs; where a method needs a reference at least as large as the
sample (resampling) they change places. Groups for scoring are those of clone_network's cluster tags.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonelake import schema
from clonelake.functions.stats import PRIME, similar_pairs
from clonelake.functions.text import RESIDUES, clean
from clonelake.operators import clusters as cl
from clonelake.operators import denovo, germline, motifs, network, resampling, scoring, similarity
from clonelake.params import Params
from clonelake.plans.pipeline import run
from clonelake.session import cut, ensure_checkpoint_dir
from clonelake.sources import results
from clonelake.sources.tables import table

FOLDS = {2: 1000.0, 3: 100.0, 4: 10.0}
#: Simulations of the scores and of the resampling method; of the sampling queries, whose rows are the samples; of the log.
SIMS, DRAWN, LOGGED = 1000, 5, 20
#: New sequences that are drawn, and how many of the best are kept.
NEW, TOP = 100_000, 1000


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return schema.parse_sequences(table(spark, sf, "cdr3_sequences", "seq_ID", "CDR3b", "TRBV", "patient", "HLA", "counts"))


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).filter("CDR3b <> ''")


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    return schema.load_reference(table(spark, sf, "refseqs", "CDR3b", "TRBV"))


def _sample(spark: SparkSession, sf: str) -> DataFrame:
    return schema.regions(_rows(spark, sf))


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return schema.regions(_refs(spark, sf))


def parse_sequences(spark, sf):
    return _parsed(spark, sf).select(F.col("seq_ID").alias("seq_id"), F.col("CDR3b").alias("cdr3b"), F.col("TRBV").alias("trbv"), "patient", "counts")


def load_reference(spark, sf):
    return _refs(spark, sf).select(F.col("CDR3b").alias("cdr3b"), F.col("TRBV").alias("trbv"))


def motif_region(spark, sf):
    return _rows(spark, sf).select(F.col("CDR3b").alias("cdr3b"), schema.motif_region().alias("motif_region")).distinct()


def find_motifs(spark, sf):
    return motifs.find_motifs(_rows(spark, sf).select("CDR3b").distinct())


def find_motifs_mindepth(spark, sf):
    return motifs.find_motifs(_rows(spark, sf).select("CDR3b").distinct(), min_depth=10)


def find_motifs_discontinuous(spark, sf):
    return motifs.find_motifs(_rows(spark, sf).select("CDR3b").distinct(), lengths=(2, 3), min_depth=3, dotted=True)


def _rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _fisher(spark, sf):
    return motifs.local_fisher(_sample(spark, sf), _known(spark, sf))


def local_fisher_all(spark, sf):
    return _rounded(_fisher(spark, sf), avg_ref=6, ove=6, p=6)


def _selected(spark, sf):
    return motifs.select_motifs(_fisher(spark, sf), FOLDS)


def local_fisher_selected(spark, sf):
    return _rounded(_selected(spark, sf), avg_ref=6, ove=6, p=6)


def subsample_srswor(spark, sf):
    return resampling.subsample(_sample(spark, sf), "CDR3b", DRAWN, _known(spark, sf).count()).select("sim", F.col("CDR3b").alias("cdr3b"))


def _strata(spark, sf, names):
    def add(df, rows):
        df = df.withColumn("len", F.length("CDR3b"))
        return df.join(rows.groupBy("CDR3b").agg(F.coalesce(F.min("TRBV"), F.lit("")).alias("v")), "CDR3b") if "v" in names else df

    wanted = add(_known(spark, sf), _refs(spark, sf)).groupBy(*names).agg(F.count("*").alias("want"))
    pool = add(_sample(spark, sf), _rows(spark, sf))
    return resampling.stratified_subsample(pool, "CDR3b", names, wanted, DRAWN).select("sim", F.col("CDR3b").alias("cdr3b"))


def subsample_len(spark, sf):
    return _strata(spark, sf, ["len"])


def subsample_vgene(spark, sf):
    return _strata(spark, sf, ["v"])


def subsample_both(spark, sf):
    return _strata(spark, sf, ["len", "v"])


def _resampled(spark, sf):
    samples = resampling.reference_samples(_sample(spark, sf), _known(spark, sf).count(), SIMS)
    return resampling.local_resampling(_known(spark, sf), samples)


def local_rrs(spark, sf):
    return _rounded(_resampled(spark, sf), avg_ref=6, ove=9, p=6)


def rrs_sample_log(spark, sf):
    samples = resampling.reference_samples(_sample(spark, sf), _known(spark, sf).count(), LOGGED)
    return resampling.sample_log(samples, motifs.find_motifs(_known(spark, sf), "mr"))


def local_rrs_selected(spark, sf):
    return _rounded(motifs.select_motifs(_resampled(spark, sf), {2: 2.0, 3: 3.0, 4: 4.0}, 0.01, 3, strict=True), avg_ref=6, ove=9, p=6)


def _members(spark, sf):
    return motifs.motif_members(_sample(spark, sf), _selected(spark, sf))


def motif_positions(spark, sf):
    return _members(spark, sf).select("motif", F.col("CDR3b").alias("cdr3b"), "pos", "full_pos")


def local_edges_fullpos(spark, sf):
    return motifs.local_pairs(_members(spark, sf), "full_pos", 3)


def local_edges_trimpos(spark, sf):
    return motifs.local_pairs(_members(spark, sf), "pos", 3).withColumnRenamed("motif", "tag")


def hamming_pairs_d0(spark, sf):
    return similarity.hamming_pairs(_sample(spark, sf), 0)


def hamming_pairs_d1(spark, sf):
    return similarity.hamming_pairs(_sample(spark, sf), 1)


def hamming_pairs_d2(spark, sf):
    return similarity.hamming_pairs(_sample(spark, sf), 2)


def hamming_pairs_d3_reference(spark, sf):
    return similarity.hamming_pairs(_known(spark, sf), 3)


def hamming_pairs_vgene(spark, sf):
    return similarity.hamming_pairs(_sample(spark, sf), 1, _rows(spark, sf).select("CDR3b", "TRBV"))


def hamming_isolated(spark, sf):
    return similarity.isolated(_sample(spark, sf), hamming_pairs_d1(spark, sf)).select(F.col("CDR3b").alias("cdr3b"))


def struct_tags(spark, sf):
    return similarity.struct_counts(_sample(spark, sf)).filter("n >= 2")


def struct_edges(spark, sf):
    return similarity.struct_edges(similarity.struct_members(_sample(spark, sf)))


def struct_edges_blosum(spark, sf):
    return similarity.struct_edges(similarity.struct_members(_sample(spark, sf)), blosum=True)


def struct_edges_vgene(spark, sf):
    return similarity.struct_edges(similarity.struct_members(_sample(spark, sf)), vgenes=_rows(spark, sf)).withColumnRenamed("TRBV", "trbv")


def global_fisher_clusters(spark, sf):
    return _rounded(cl.global_clusters(_sample(spark, sf), _known(spark, sf), interchangeable=True), p=6)


def global_fisher_blosum(spark, sf):
    return _rounded(cl.global_clusters(_sample(spark, sf), _known(spark, sf)), p=6)


def global_fisher_vgene(spark, sf):
    return _rounded(cl.global_clusters(_sample(spark, sf), _known(spark, sf), _rows(spark, sf)), p=6).withColumnRenamed("TRBV", "trbv")


def gliph1_components(spark, sf):
    links = motifs.local_links(_members(spark, sf), "full_pos", 3).select("v1", "v2").distinct().withColumn("type", F.lit("local"))
    groups = cl.cluster_by_components(links.unionByName(hamming_pairs_d1(spark, sf).withColumn("type", F.lit("global"))), _rows(spark, sf))
    return groups.groupBy("leader").agg(F.count_distinct("CDR3b").alias("cluster_size"), F.array_join(F.array_sort(F.collect_set("CDR3b")), " ").alias("members"))


def gliph1_donor_groups(spark, sf):
    edges = hamming_pairs_d1(spark, sf).withColumn("type", F.lit("global"))
    groups = cl.leader_names(cl.cluster_by_components(edges, _rows(spark, sf).filter("patient is not null AND TRBV is not null"), "none", "global"))
    return groups.select("tag", "cluster_size", "members")


def _both_kinds(spark, sf):
    sample = _sample(spark, sf)
    stats = cl.global_clusters(sample, _known(spark, sf))
    return cl.cluster_by_motif(_selected(spark, sf), _members(spark, sf), stats, 2)


def gliph2_clusters(spark, sf):
    return _rounded(_both_kinds(spark, sf), ove=6, p=6)


def gliph2_members(spark, sf):
    rows = cl.global_members(_sample(spark, sf), _rows(spark, sf))
    stats = cl.global_clusters(_sample(spark, sf), _known(spark, sf), _rows(spark, sf))
    properties = cl.cluster_by_motif(_selected(spark, sf), _members(spark, sf), stats, 2)
    named = cl.motif_cluster_members(_members(spark, sf), rows).join(properties.select("tag"), "tag", "left_semi")
    return cl.member_rows(named, _rows(spark, sf)).select("tag", F.col("seq_ID").alias("seq_id"))


def gliph2_edges(spark, sf):
    edges = cl.local_edges(_members(spark, sf), 3).unionByName(cl.global_edges(cl.global_members(_sample(spark, sf))))
    return cl.cluster_edges(edges, _rows(spark, sf), _both_kinds(spark, sf))


def _run(spark, sf, params, **more):
    """A whole run of the clones against the clones and refseqs together, as a reference must not be the smaller one."""
    clones = table(spark, sf, "cdr3_sequences", "seq_ID", "CDR3b", "TRBV", "patient", "HLA", "counts")
    return run(clones, clones.select("CDR3b", "TRBV").unionByName(table(spark, sf, "refseqs", "CDR3b", "TRBV")), params, **more)


def run_gliph2(spark, sf):
    out = _run(spark, sf, Params(lcminove=1.0), cluster_sizes=_size_table(spark))
    columns = [F.round(c, 6).alias(c) for c in ("p", "total_score", "cdr3_length_score", "network_size_score", "vgene_score", "clonal_expansion_score", "hla_score")]
    return out.tables["cluster_properties"].select("type", "tag", "cluster_size", *columns, "lowest_hlas", "members")


def run_gliph2_connections(spark, sf):
    return _run(spark, sf, Params(lcminove=1.0), score=False).tables["connections"]


def run_gliph1(spark, sf):
    out = _run(spark, sf, Params(method="gliph1", sim_depth=20, lcminp=0.051, lcminove=1.0, motif_length=4), score=False)
    return out.tables["cluster_properties"].select("tag", "cluster_size", "members")


def _groups(spark, sf, rows=None):
    """tag and member rows of the groups that clone_network names."""
    net = table(spark, sf, "clone_network", "V1", "V2", "cluster_tag").filter("cluster_tag is not null")
    named = net.select(F.col("cluster_tag").alias("tag"), F.explode(F.array(clean("V1"), clean("V2"))).alias("CDR3b")).filter("CDR3b is not null").distinct()
    return named.join(_rows(spark, sf) if rows is None else rows, "CDR3b")


def _fragments(spark, sf):
    f = lambda x: spark.createDataFrame([(s,) for s in x], "fragment string")
    return f(V), f(D), f(J)


#: Example fragments for the germline queries; a caller brings his own.
V, D, J = ("CAS", "CASS", "CSA", "CSV", "CAI", "CAT", "CAW"), ("GG", "GT", "GTG", "GQG", "RD", "SG"), ("EQYF", "EAFF", "TQYF", "NEQYF", "GEQYF", "PLHF", "KLFF", "YTFF", "TIYF", "VLTF", "LFF", "QYF")


def germline_ranges(spark, sf):
    return germline.germline_ranges(_sample(spark, sf), *_fragments(spark, sf)).withColumnRenamed("CDR3b", "cdr3b")


def germline_boost(spark, sf):
    members = _members(spark, sf)
    heads = _selected(spark, sf).join(members.groupBy("motif").agg(F.min("pos").alias("start")), "motif")
    rows = members.select("motif", "CDR3b").join(_rows(spark, sf).select("CDR3b", "seq_ID"), "CDR3b")
    return germline.germline_boost(heads, rows, germline.germline_ranges(_sample(spark, sf), *_fragments(spark, sf))).withColumn("p_boosted", F.round("p_boosted", 9))


def _size_table(spark):
    probs = spark.range(1, 101).select(F.col("id").cast("int").alias("cluster_size"), F.explode(F.array(*[F.lit(x) for x in (125, 500, 2000, 10000)])).alias("sample_size"))
    return probs.withColumn("prob", 1 / (F.col("cluster_size") + F.col("sample_size") / 1000))


def _sizes(spark, sf):
    return scoring.size_score(_groups(spark, sf), _size_table(spark), _rows(spark, sf).count())


def score_size(spark, sf):
    return _rounded(_sizes(spark, sf), score=9)


def _length_freqs(spark, sf):
    return scoring.frequencies(_refs(spark, sf).select("CDR3b").distinct().select(F.length("CDR3b").alias("len")), "len")


def _vgene_freqs(spark, sf):
    return table(spark, sf, "vgene_frequencies").select(F.col("vgene").alias("category"), "freq")


def ref_frequencies(spark, sf):
    both = _length_freqs(spark, sf).withColumn("kind", F.lit("length")).unionByName(scoring.frequencies(_refs(spark, sf), "TRBV").withColumn("kind", F.lit("vgene")))
    return _rounded(both, freq=9)


def score_length(spark, sf):
    return _rounded(scoring.length_score(_groups(spark, sf), _length_freqs(spark, sf), SIMS), score=6)


def score_vgene(spark, sf):
    return _rounded(scoring.vgene_score(_groups(spark, sf), _vgene_freqs(spark, sf), SIMS, 1), score=6)


def score_clonal(spark, sf):
    return scoring.clonal_score(_groups(spark, sf), _rows(spark, sf), SIMS)


def score_hla(spark, sf):
    return _rounded(scoring.hla_score(_groups(spark, sf), _rows(spark, sf)), score=6)


def hla_listing(spark, sf):
    return scoring.hla_listing(_groups(spark, sf), _rows(spark, sf))


def _totals(spark, sf, version):
    rows = cut(_rows(spark, sf))
    groups = cut(_groups(spark, sf, rows))
    parts = {
        "cdr3_length": scoring.length_score(groups, _length_freqs(spark, sf), SIMS, version),
        "network_size": scoring.size_score(groups, _size_table(spark), rows.count()),
        "vgene": scoring.vgene_score(groups, _vgene_freqs(spark, sf), SIMS, version),
        "clonal_expansion": scoring.clonal_score(groups, rows, SIMS),
        "hla": scoring.hla_score(groups, rows),
    }
    return scoring.score_table(parts, version).select("tag", F.round("total_score", 6).alias("score"))


def score_total_v1(spark, sf):
    return _totals(spark, sf, 1)


def score_total_v2(spark, sf):
    return _totals(spark, sf, 2)


def _cdr3_groups(spark, sf):
    return _groups(spark, sf).select("tag", "CDR3b").distinct()


def pwm_scoring(spark, sf):
    return _rounded(denovo.scoring_matrix(_groups(spark, sf)), freq=9)


def pwm_prediction(spark, sf):
    return _rounded(denovo.prediction_matrix(_groups(spark, sf)), freq=9)


def length_distribution(spark, sf):
    return _rounded(denovo.length_distribution(_groups(spark, sf)), prob=9)


def _largest(spark, sf):
    """The tag with the most member rows of ten residues or more, the least on ties."""
    groups = _groups(spark, sf).filter(F.length("CDR3b") >= 10)
    return groups.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").first().tag


def _new(spark, sf, **more):
    return denovo.new_sequences(_groups(spark, sf), _largest(spark, sf), table(spark, sf, "refseqs", "CDR3b", "TRBV"), sims=NEW, num_tops=TOP, **more)


def denovo_generate(spark, sf):
    return denovo.generate(_groups(spark, sf).filter(F.col("tag") == _largest(spark, sf)), NEW)


def denovo_rank(spark, sf):
    return _rounded(_new(spark, sf).sequences.select("rank", "length", "seq", "score", "known"), score=12)


def denovo_norm(spark, sf):
    return _rounded(_new(spark, sf, normalization=True).sequences.select("length", "seq", "score", "norm"), score=12, norm=9)


def denovo_members(spark, sf):
    members = _new(spark, sf, normalization=True).members
    return _rounded(members.select(F.col("seq_ID").alias("seq_id"), F.col("CDR3b").alias("cdr3b"), "score", "norm"), score=12, norm=9)


def _nodes(spark, sf):
    scores = scoring.hla_score(_groups(spark, sf), _rows(spark, sf))
    return network.network_nodes(_groups(spark, sf), _rows(spark, sf), scores)


def network_nodes(spark, sf):
    return _rounded(_nodes(spark, sf), size=6, weight=6)


def network_edges(spark, sf):
    nodes = network.network_nodes(_groups(spark, sf), _rows(spark, sf))
    edges = table(spark, sf, "clone_network", "V1", "V2", "type").select(clean("V1").alias("v1"), clean("V2").alias("v2"), F.lower(clean("type")).alias("type")).filter("type in ('local', 'global')")
    return network.network_edges(edges, nodes)


def network_motif_edges(spark, sf):
    return network.motif_edges(_members(spark, sf), 3)


def network_legend(spark, sf):
    return _rounded(network.legend(_nodes(spark, sf)), weight=9)


def network_colours(spark, sf):
    return network.coloured(_nodes(spark, sf), "weight", "log").select("id", "tag", "color")


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def roundtrip_save_load(spark, sf):
    folder = _folder(spark, "saved")
    results.save(folder, {"cluster_members": _cdr3_groups(spark, sf)}, Params())
    return results.load(spark, folder)[0]["cluster_members"].select("tag", F.col("CDR3b").alias("cdr3b"))


def roundtrip_text(spark, sf):
    folder = _folder(spark, "text")
    results.save(folder, {"cluster_members": _cdr3_groups(spark, sf)}, Params(), form="text")
    return results.load_text(spark, folder)[0]["cluster_members"].select("tag", F.col("CDR3b").alias("cdr3b"))


_NAMES = """parse_sequences load_reference motif_region find_motifs find_motifs_mindepth find_motifs_discontinuous local_fisher_all
local_fisher_selected subsample_srswor subsample_len subsample_vgene subsample_both local_rrs local_rrs_selected rrs_sample_log motif_positions
local_edges_fullpos local_edges_trimpos hamming_pairs_d0 hamming_pairs_d1 hamming_pairs_d2 hamming_pairs_d3_reference hamming_pairs_vgene
hamming_isolated struct_tags struct_edges struct_edges_blosum struct_edges_vgene global_fisher_clusters global_fisher_blosum
global_fisher_vgene gliph1_components gliph1_donor_groups gliph2_clusters gliph2_edges germline_ranges germline_boost score_size
score_length score_vgene score_clonal score_hla hla_listing score_total_v1 score_total_v2 ref_frequencies pwm_scoring pwm_prediction
length_distribution denovo_generate denovo_rank denovo_norm denovo_members network_nodes network_edges network_motif_edges
network_legend network_colours roundtrip_save_load roundtrip_text gliph2_members run_gliph2 run_gliph2_connections run_gliph1""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_AA = f"'[{RESIDUES}]"
_BASE = f"""WITH RECURSIVE
q AS (SELECT DISTINCT seq_ID, CDR3b AS s, TRBV AS v, patient AS pt, HLA AS hla, coalesce(counts, 1.0) AS n FROM cdr3_sequences WHERE regexp_full_match(CDR3b, {_AA}*')),
seqs AS (SELECT * FROM q WHERE s <> ''),
refs AS (SELECT DISTINCT CDR3b AS s, TRBV AS v FROM refseqs WHERE regexp_full_match(CDR3b, {_AA}+') AND CDR3b LIKE 'C%F' AND length(CDR3b) >= 8),
sam AS (SELECT DISTINCT s, s[4:-4] AS mr FROM seqs WHERE length(s) > 6),
ref AS (SELECT DISTINCT s, s[4:-4] AS mr FROM refs),
ks(k) AS (VALUES (2), (3), (4)),
"""


def _kmers(name, source, column, ks="ks"):
    return f"{name} AS (SELECT m AS motif, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length({column}) - k + 2), lambda i: {column}[i:i + k - 1])) AS m FROM {source}, {ks} WHERE length({column}) >= k) GROUP BY m)"


def _tail(c, m, n, k):
    """P(X >= c) in DuckDB, clamped."""
    t = f"exp(lgamma({m} + 1) - lgamma(x + 1) - lgamma({m} - x + 1) + lgamma({n} + 1) - lgamma({k} - x + 1) - lgamma({n} - {k} + x + 1) - lgamma({m} + {n} + 1) + lgamma({k} + 1) + lgamma({m} + {n} - {k} + 1))"
    return f"(CASE WHEN {c} <= greatest(0, {k} - ({n})) THEN 1.0 ELSE least(1.0, coalesce(list_sum(list_transform(range({c}, least({m}, {k}) + 1), lambda x: {t})), 0.0)) END)"


_FISHER = (
    _kmers("a", "sam", "mr")
    + ",\n"
    + _kmers("b", "ref", "mr")
    + f""",
z AS (SELECT (SELECT count(*) FROM sam) AS ns, (SELECT count(*) FROM ref) AS nr),
j AS (SELECT a.motif, a.n AS counts, coalesce(b.n, 0) AS num_in_ref, ns, nr FROM a LEFT JOIN b USING (motif), z),
fisher AS (SELECT motif, counts, num_in_ref, num_in_ref / nr * ns AS avg_ref, counts / (num_in_ref + 0.01) / ns * nr AS ove, {_tail("counts", "(num_in_ref + counts)", "greatest(nr + ns - num_in_ref - counts, 0)", "ns")} AS p FROM j),
sel AS (SELECT * FROM fisher WHERE ove >= CASE length(motif) WHEN 2 THEN 1000 WHEN 3 THEN 100 WHEN 4 THEN 10 ELSE 0 END AND p <= 0.01 AND counts >= 3)"""
)
_MEMBERS = _FISHER + ",\nmem AS (SELECT motif, s, strpos(mr, motif) AS pos, strpos(s, motif) AS full_pos FROM (SELECT DISTINCT s, mr, unnest(list_transform(range(1, length(mr) - k + 2), lambda i: mr[i:i + k - 1])) AS motif FROM sam, ks WHERE length(mr) >= k) JOIN sel USING (motif))"
_TAGS = "tg AS (SELECT s, unnest(list_transform(range(1, length(mr) + 1), lambda i: struct_pack(tag := mr[:i - 1] || '%' || mr[i + 1:], aa := mr[i]))) AS t FROM sam),\nst AS (SELECT s, t.tag AS tag, t.aa AS aa FROM tg),\nshared AS (SELECT tag, count(*) AS n FROM st GROUP BY tag HAVING count(*) >= 2)"
_PAIRS = "pr(x) AS (VALUES " + ", ".join(f"('{p}')" for p in similar_pairs()) + ")"
_RTAGS = "rt AS (SELECT tag, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(mr) + 1), lambda i: mr[:i - 1] || '%' || mr[i + 1:])) AS tag FROM ref) GROUP BY tag)"
_Z = "zz AS (SELECT (SELECT count(*) FROM sam) AS ns, (SELECT count(*) FROM ref) AS nr)"


def _global(extra=""):
    """Structure groups: closure of residues within a tag (and V gene)."""
    v = ", v" if extra else ""
    rows = "SELECT DISTINCT st.tag, st.s, st.aa, seqs.v FROM st JOIN shared USING (tag) JOIN seqs USING (s) WHERE seqs.v IS NOT NULL" if extra else "SELECT tag, s, aa FROM st JOIN shared USING (tag)"
    return f"""gr AS ({rows}),
ga AS (SELECT DISTINCT tag{v}, aa FROM gr),
rc AS (SELECT tag{v}, aa AS a, aa AS b FROM ga UNION SELECT rc.tag{', rc.v' if extra else ''}, rc.a, ga.aa FROM rc JOIN ga ON rc.tag = ga.tag{' AND rc.v = ga.v' if extra else ''} JOIN pr ON x = rc.b || ga.aa),
cg AS (SELECT tag{v}, a, string_agg(b, '' ORDER BY b) AS aas FROM rc GROUP BY ALL),
gs AS (SELECT gr.tag{', gr.v' if extra else ''}, aas, count(*) AS cluster_size, count(DISTINCT s) AS u FROM gr JOIN cg ON gr.tag = cg.tag AND gr.aa = cg.a{' AND gr.v = cg.v' if extra else ''} GROUP BY ALL HAVING count(*) > 1),
gc AS (SELECT gs.*, coalesce(rt.n, 0) AS num_in_ref, {_tail("u", "(coalesce(rt.n, 0) + u)", "greatest(nr + ns - coalesce(rt.n, 0) - u, 0)", "ns")} AS p FROM gs LEFT JOIN rt ON rt.tag = gs.tag, zz)"""


def _md5(x, part):
    return f"(('0x' || substr(md5({x}), {8 * part + 1}, 8))::BIGINT % {PRIME})"


def _simulations(n):
    lines = ", ".join(f"greatest({_md5(f"'{kind}:' || sim", part)}, 1) AS {kind}{part}" for kind in ("low", "high") for part in range(3))
    return f"sim AS (SELECT sim, {lines} FROM (SELECT unnest(range({n})) AS sim))"


def _line(kind):
    return f"(({kind}0 * x + ({kind}1 * y) % {PRIME} + {kind}2) % {PRIME})"


_RANK = f"({_line('low')} * {2**31} + {_line('high')})"
_XY = f"{_md5('s', 0)} AS x, {_md5('s', 1)} AS y"


def _stratified(names):
    cols = ", ".join(names)
    on = " AND ".join(f"a.{n} = b.{n}" for n in names)
    return f"""{_simulations(DRAWN)},
rv AS (SELECT s, coalesce(min(v), '') AS v FROM refs GROUP BY s), sv AS (SELECT s, coalesce(min(v), '') AS v FROM seqs GROUP BY s),
pool AS (SELECT s, length(s) AS len, v, {_XY} FROM sam JOIN sv USING (s)), own AS (SELECT s, length(s) AS len, v FROM ref JOIN rv USING (s)),
want AS (SELECT {cols}, count(*) AS want FROM own GROUP BY ALL),
h AS (SELECT sim, s, {cols}, {_RANK} AS h FROM pool, sim),
rk AS (SELECT *, row_number() OVER (PARTITION BY sim, {cols} ORDER BY h) AS k FROM h),
d AS (SELECT a.sim, a.s FROM rk a JOIN want b ON {on} WHERE a.k <= b.want),
miss AS (SELECT sim, (SELECT sum(want) FROM want) - coalesce((SELECT count(*) FROM d WHERE d.sim = sim.sim), 0) AS m FROM sim),
le AS (SELECT sim, s, row_number() OVER (PARTITION BY sim ORDER BY h) AS k FROM h ANTI JOIN d USING (sim, s))
SELECT sim::INTEGER AS sim, s AS cdr3b FROM d UNION ALL SELECT le.sim::INTEGER, s FROM le JOIN miss USING (sim) WHERE k <= m"""


def _samples(n, pool="sam", size="ref"):
    return f"""{_simulations(n)},
it AS (SELECT s, mr, {_XY} FROM {pool}),
rk AS (SELECT sim, s, mr, row_number() OVER (PARTITION BY sim ORDER BY {_RANK}) AS k FROM it, sim),
dr AS (SELECT sim, s, mr FROM rk WHERE k <= (SELECT count(*) FROM {size}))"""


def _rrs(n, pool="sam", sample="ref"):
    return f"""{_samples(n, pool, sample)},
{_kmers("f", sample, "mr")},
lg AS (SELECT sim, m AS motif, count(*) AS n FROM (SELECT sim, unnest(list_transform(range(1, length(mr) - k + 2), lambda i: mr[i:i + k - 1])) AS m FROM dr, ks WHERE length(mr) >= k) WHERE m IN (SELECT motif FROM f) GROUP BY ALL),
rs AS (SELECT f.motif, f.n AS counts, coalesce(sum(lg.n), 0)::BIGINT AS total, coalesce(max(lg.n), 0) AS top_ref, count(*) FILTER (lg.n >= f.n) AS above FROM f LEFT JOIN lg USING (motif) GROUP BY f.motif, f.n),
rr AS (SELECT motif, counts, total / {n}.0 AS avg_ref, top_ref, CASE WHEN total = 0 THEN 1.0 / ({n}.0 * (SELECT count(*) FROM {sample})) ELSE counts / (total / {n}.0) END AS ove, greatest(above / {n}.0, 1 / {n}.0) AS p FROM rs)"""


_CLEAN = "upper(trim({}, ' ' || chr(9) || chr(160)))"
_GROUPS = f"nt AS (SELECT DISTINCT cluster_tag AS tag, unnest([{_CLEAN.format('V1')}, {_CLEAN.format('V2')}]) AS s FROM clone_network WHERE cluster_tag IS NOT NULL),\ng AS (SELECT nt.tag, seqs.* FROM nt JOIN seqs USING (s)),\ngd AS (SELECT DISTINCT tag, s FROM g)"


def _fifth(x):
    return f"(((({x}) * ({x}) % {PRIME}) * (({x}) * ({x}) % {PRIME}) % {PRIME}) * ({x}) % {PRIME})"


def _draws(name, sizes, salt):
    """size, sim, u: the first draws of each simulation, as many as the size of a group."""
    return f"""{name}b AS (SELECT sim, {_md5(f"sim || ':{salt}'", 0)} AS x, {_md5(f"sim || ':{salt}'", 1)} AS y FROM (SELECT unnest(range({SIMS})) AS sim)),
{name}t AS (SELECT sim, d, {_u("d")} AS u FROM {name}b, (SELECT unnest(range(1, (SELECT max(size) FROM {sizes}) + 1)) AS d)),
{name} AS (SELECT size, sim, u FROM {sizes} JOIN {name}t ON d <= size)"""


def _u(place):
    """A draw of the pair x, y."""
    return f"{_fifth(f'({_fifth(f"((x + ({place}) * 1000003) % {PRIME})")} + y) % {PRIME}')} / {PRIME}::DOUBLE"


_MILLE = "floor((product(n / size) + 1e-9) * 1000 + 0.5)"


def _category(rows, freqs, op, salt, p=""):
    """Scores by draws from a distribution; rows: SQL giving tag, c; freqs: SQL giving c, f; p: prefix of all names."""
    return f"""{p}cr AS ({rows}), {p}cf AS ({freqs}),
{p}cs AS (SELECT tag, count(*) AS size FROM {p}cr GROUP BY tag), {p}cz AS (SELECT DISTINCT size FROM {p}cs),
{p}co AS (SELECT tag, size, {_MILLE} AS own FROM (SELECT tag, c, count(*) AS n FROM {p}cr GROUP BY ALL) JOIN {p}cs USING (tag) GROUP BY tag, size),
{p}cum AS (SELECT list(x ORDER BY c) AS cum FROM (SELECT c, sum(f) OVER (ORDER BY c) / sum(f) OVER () AS x FROM {p}cf)),
{_draws(p + "cu", p + "cz", salt)},
{p}cd AS (SELECT size, sim, least(len(list_filter(cum, lambda q: q <= u)), len(cum) - 1) AS place FROM {p}cu, {p}cum),
{p}ct AS (SELECT size, sim, {_MILLE} AS test FROM (SELECT size, sim, place, count(*) AS n FROM {p}cd GROUP BY ALL) GROUP BY size, sim),
{p}cx AS (SELECT tag, greatest(count(*) FILTER (test {op} own) / {SIMS}.0, 1 / {SIMS}.0) AS score FROM {p}co JOIN {p}ct USING (size) GROUP BY tag)"""


def _clonal(pool="seqs", groups="g"):
    return f"""po AS (SELECT list(n ORDER BY n) AS ns FROM {pool}),
ow AS (SELECT tag, sum(n) AS total, count(*) AS size FROM {groups} GROUP BY tag), oz AS (SELECT DISTINCT size FROM ow),
{_draws("bu", "oz", "c")},
bt AS (SELECT size, sim, sum(ns[floor(u * len(ns))::BIGINT + 1]) AS test FROM bu, po GROUP BY size, sim),
cl AS (SELECT tag, round(greatest(count(*) FILTER (test >= total) / {SIMS}.0, 1 / {SIMS}.0) + 1e-12, 3) AS score FROM ow JOIN bt USING (size) GROUP BY tag)"""


_LEN = ("SELECT tag, length(s)::VARCHAR AS c FROM gd", "SELECT c, n / sum(n) OVER () AS f FROM (SELECT length(s)::VARCHAR AS c, count(*) AS n FROM (SELECT DISTINCT s FROM refs) GROUP BY ALL)")
_CLONAL = _clonal()
_HLA = f"""hr AS (SELECT *, split_part(pt, ':', 1) AS donor FROM seqs WHERE hla IS NOT NULL AND hla <> '' AND pt IS NOT NULL),
al AS (SELECT DISTINCT donor, split_part(a, ':', 1) AS allele FROM (SELECT donor, unnest(string_split(arg_min(hla, seq_ID), ',')) AS a FROM hr GROUP BY donor)),
ah AS (SELECT allele, count(*) AS h FROM al GROUP BY allele), ad AS (SELECT count(DISTINCT donor) AS donors FROM hr),
hm AS (SELECT DISTINCT tag, split_part(pt, ':', 1) AS donor FROM g WHERE hla IS NOT NULL AND hla <> '' AND pt IS NOT NULL),
hc AS (SELECT tag, count(*) AS c FROM hm GROUP BY tag),
hk AS (SELECT tag, allele, count(*) AS k FROM hm JOIN al USING (donor) GROUP BY ALL HAVING count(*) > 1),
ht AS (SELECT tag, allele, k, c, h, donors, {_tail("k", "h", "(donors - h)", "c")} AS p FROM hk JOIN hc USING (tag) JOIN ah USING (allele), ad),
hs AS (SELECT tag, least(coalesce(min(p), 1.0), 1.0) AS score FROM (SELECT DISTINCT tag FROM g) LEFT JOIN ht USING (tag) GROUP BY tag)"""


def _pwm(keys, where, length):
    ks = ", ".join(keys)
    return f"""lt AS (SELECT tag, length(s) AS len, unnest(range(1, {length} + 1)) AS pos, s FROM g WHERE {where}),
ct AS (SELECT {ks}, s[pos] AS aa, count(*) AS n FROM lt GROUP BY ALL),
tt AS (SELECT {ks}, sum(n) AS total, count(*) AS seen FROM ct GROUP BY ALL),
aas AS (SELECT unnest(string_split('{RESIDUES}', '')) AS aa)
SELECT {', '.join('tt.' + k + ('::INTEGER AS ' + k if k != 'tag' else '') for k in keys)}, aas.aa, round(CASE WHEN n IS NULL THEN 0.005 ELSE n / total * (1 - (20 - seen) * 0.005) END, 9) AS freq
FROM tt CROSS JOIN aas LEFT JOIN ct ON {' AND '.join(f'ct.{k} = tt.{k}' for k in keys)} AND ct.aa = aas.aa"""


def _hamming(most, source="sam"):
    return f"SELECT a.s AS v1, b.s AS v2 FROM {source} a JOIN {source} b ON a.s < b.s AND length(a.mr) = length(b.mr) WHERE a.mr <> '' AND hamming(a.mr, b.mr) <= {most}"


def _edges(position):
    return f"SELECT a.s AS v1, b.s AS v2, a.motif FROM mem a JOIN mem b ON a.motif = b.motif AND a.s < b.s WHERE abs(a.{position} - b.{position}) < 3"


def _list(values):
    return "(VALUES " + ", ".join(f"('{v}')" for v in values) + ")"


_GERM = f"""v(f) AS {_list(V)}, d(f) AS {_list(D)}, jj(f) AS {_list(J)},
e0 AS (SELECT s, 1 + coalesce((SELECT max(length(f)) FROM v WHERE starts_with(s, f)), 0) AS a, length(s) - coalesce((SELECT max(length(f)) FROM jj WHERE ends_with(s, f)), 0) AS b FROM (SELECT DISTINCT s FROM sam)),
e1 AS (SELECT s, a, b, CASE WHEN b >= a THEN s[a:b] ELSE '' END AS i FROM e0),
e2 AS (SELECT s, a, b, (SELECT min(struct_pack(k := -length(f), at := strpos(i, f), f := f)) FROM d WHERE strpos(i, f) > 0) AS hit FROM e1),
gm AS (SELECT s, a AS start_1, CASE WHEN hit IS NULL THEN b ELSE a + hit.at - 2 END AS stop_1, CASE WHEN hit IS NULL THEN 0 ELSE a + hit.at - 1 - hit.k END AS start_2, CASE WHEN hit IS NULL THEN -1 ELSE b END AS stop_2 FROM e2)"""
_NODES = """ng AS (SELECT tag FROM gd GROUP BY tag HAVING count(*) >= 3),
no AS (SELECT seqs.seq_ID AS id, gd.s AS label, tag, n FROM gd JOIN ng USING (tag) JOIN seqs USING (s)),
nn AS (SELECT id, label, tag, CASE WHEN max(n) OVER () = min(n) OVER () THEN 12.0 ELSE 12.0 + (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) * 8 END AS size FROM no)"""
_CC = """ll AS (SELECT v1 AS u, v2 AS w FROM ce UNION SELECT v2, v1 FROM ce UNION SELECT v1, v1 FROM ce UNION SELECT v2, v2 FROM ce),
cc(member, grp) USING KEY (member) AS (SELECT u, min(w) FROM ll GROUP BY u UNION
  SELECT ll.u, min(n.grp) FROM cc AS n JOIN ll ON ll.w = n.member JOIN recurring.cc AS o ON o.member = ll.u WHERE n.grp < o.grp GROUP BY ll.u)"""
_R6 = "round(avg_ref, 6) AS avg_ref, round(ove, 6) AS ove, round(p, 6) AS p"

_MEM = _MEMBERS.removeprefix(_FISHER + ",\n")
_OWN_REFS = _BASE.replace("FROM refseqs WHERE", "FROM (SELECT CDR3b, TRBV FROM refseqs UNION ALL SELECT CDR3b, TRBV FROM cdr3_sequences) WHERE")
_ONE = "ove >= CASE length(motif) WHEN 2 THEN 1000 WHEN 3 THEN 100 WHEN 4 THEN 10 ELSE 0 END"
_MEMBERS_ONE = _MEMBERS.replace(_ONE, "ove >= 1")
_VGENE = ("SELECT tag, v AS c FROM g WHERE v IS NOT NULL", "SELECT vgene AS c, coalesce(freq, 0.0) AS f FROM vgene_frequencies")
_SPANS = "lc AS (SELECT motif, motif || '_' || min(pos) || '_' || max(pos) AS tag, count(DISTINCT s) AS n FROM mem GROUP BY motif)"


def _global_rows():
    """Structure groups without their statistics."""
    return _global()[: _global().index(",\ngs AS")]


_EDGES = f"""{_SPANS},
ed AS (SELECT v1, v2, 'local' AS type, lc.tag AS cluster_tag FROM ({_edges('pos')}) JOIN lc USING (motif) WHERE n >= 2
  UNION SELECT a.s, b.s, 'global', cg.tag || '_' || aas FROM gr a JOIN gr b USING (tag) JOIN pr ON x = a.aa || b.aa JOIN cg ON cg.tag = a.tag AND cg.a = a.aa WHERE a.s < b.s)
SELECT * FROM ed UNION ALL SELECT s, s, 'singleton', 'singleton_' || row_number() OVER (ORDER BY seq_ID) FROM seqs WHERE s NOT IN (SELECT v1 FROM ed UNION SELECT v2 FROM ed) AND ((SELECT count(*) FROM lc WHERE n >= 2) > 0 OR (SELECT count(*) FROM cg GROUP BY ALL) > 0)"""
_HLA_TEXT = """h0 AS (SELECT *, floor(log10(p))::INT AS e0 FROM ht WHERE p < 0.1), h1 AS (SELECT *, floor(round(p / pow(10.0, e0), 6) * 10 + 0.5)::INT AS d0 FROM h0),
h2 AS (SELECT *, CASE WHEN d0 = 100 THEN e0 + 1 ELSE e0 END AS e, CASE WHEN d0 = 100 THEN 10 ELSE d0 END AS d FROM h1),
hl AS (SELECT tag, string_agg(allele || ' [(' || k || '/' || c || ') vs (' || h || '/' || donors || ') = ' || (d // 10) || '.' || (d % 10) || CASE WHEN e < 0 THEN 'e-' ELSE 'e+' END || CASE WHEN abs(e) < 10 THEN '0' ELSE '' END || abs(e) || ']', ' , ' ORDER BY allele) AS hlas FROM h2 GROUP BY tag)"""


def _size_sql(pool="seqs"):
    return f"""ss(x) AS (VALUES (125), (500), (2000), (10000)), ne AS (SELECT x FROM ss ORDER BY abs(1.0 - x / (SELECT count(*) FROM {pool})), x LIMIT 1),
si AS (SELECT tag, 1 / (least(count(*), 100) + (SELECT x FROM ne) / 1000) AS size_score FROM gd GROUP BY tag)"""


def _totals_sql(op, factor):
    return f"""{_category(*_LEN, op, "len")}, {_category(*_VGENE, op, "v", "v_")}, {_CLONAL}, {_HLA}, {_size_sql()}
SELECT cx.tag, round({factor} * cx.score * size_score * coalesce(v_cx.score, 1.0) * cl.score * hs.score, 6) AS score FROM cx JOIN cl USING (tag) JOIN hs USING (tag) JOIN si USING (tag) LEFT JOIN v_cx USING (tag)"""


_OWN_V = "SELECT v AS c, count(*) AS f FROM refs WHERE v IS NOT NULL GROUP BY v"
_RUN_SCORES = f"""pp AS (SELECT 'local' AS type, lc.tag, n AS cluster_size, p FROM sel JOIN lc USING (motif) WHERE n >= 2 UNION ALL SELECT 'global', tag || '_' || aas, cluster_size, p FROM gc),
gd AS (SELECT DISTINCT lc.tag, s FROM mem JOIN lc USING (motif) WHERE lc.n >= 2 UNION SELECT gr.tag || '_' || cg.aas, s FROM gr JOIN cg ON gr.tag = cg.tag AND gr.aa = cg.a JOIN gc ON gc.tag = gr.tag AND gc.aas = cg.aas),
g AS (SELECT gd.tag, seqs.* FROM gd JOIN seqs USING (s)), wh AS (SELECT * FROM seqs WHERE hla IS NOT NULL AND hla <> ''),
{_category(*_LEN, ">", "len")}, {_category("SELECT tag, v AS c FROM g WHERE v IS NOT NULL", _OWN_V, ">", "v", "v_")}, {_clonal("wh")}, {_HLA}, {_HLA_TEXT}, {_size_sql("wh")}
SELECT pp.type, pp.tag, cluster_size, round(p, 6) AS p, round(cx.score * size_score * coalesce(v_cx.score, 1.0) * cl.score * hs.score, 6) AS total_score, round(cx.score, 6) AS cdr3_length_score, round(size_score, 6) AS network_size_score,
round(v_cx.score, 6) AS vgene_score, round(cl.score, 6) AS clonal_expansion_score, round(hs.score, 6) AS hla_score, coalesce(hlas, '') AS lowest_hlas, members
FROM pp JOIN cx USING (tag) JOIN cl USING (tag) JOIN hs USING (tag) JOIN si USING (tag) JOIN (SELECT tag, string_agg(s, ' ' ORDER BY s) AS members FROM gd GROUP BY tag) USING (tag) LEFT JOIN v_cx USING (tag) LEFT JOIN hl USING (tag)"""


def _matrix(p, keys, length):
    """{p}m: keys, aa, freq of the rows ``own``; as _pwm, but not rounded."""
    ks = ", ".join(keys)
    return f"""{p}lt AS (SELECT length(s) AS len, unnest(range(1, {length} + 1)) AS pos, s FROM own),
{p}ct AS (SELECT {ks}, s[pos] AS aa, count(*) AS n FROM {p}lt GROUP BY ALL), {p}tt AS (SELECT {ks}, sum(n)::BIGINT AS total, count(*) AS seen FROM {p}ct GROUP BY ALL),
{p}m AS (SELECT {', '.join(f'{p}tt.{k}' for k in keys)}, aas.aa, CASE WHEN n IS NULL THEN 0.005::DOUBLE ELSE n / total * (1 - (20 - seen) * 0.005::DOUBLE) END AS freq
FROM {p}tt CROSS JOIN aas LEFT JOIN {p}ct ON {' AND '.join(f'{p}ct.{k} = {p}tt.{k}' for k in keys)} AND {p}ct.aa = aas.aa)"""


def _scored(source, text):
    """text and its score, factors in order."""
    return f"""SELECT {text}, list_reduce(list_prepend(1.0::DOUBLE, list(freq ORDER BY pos)), lambda a, b: a * b) AS score FROM (SELECT {text}, unnest(range(1, 11)) AS pos FROM (SELECT DISTINCT {text} FROM {source})) x
JOIN sm USING (pos) WHERE sm.aa = {text}[pos] GROUP BY {text}"""


_RUNNING = "list_transform(range(1, len(w) + 1), lambda i: list_sum(w[:i]))"
_NEW = f"""big AS (SELECT tag FROM g WHERE length(s) >= 10 GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 1),
own AS (SELECT * FROM g WHERE tag = (SELECT tag FROM big) AND length(s) >= 10), aas AS (SELECT unnest(string_split('{RESIDUES}', '')) AS aa),
{_matrix("s", ["pos"], "10")}, {_matrix("l", ["len", "pos"], "length(s)")},
ld AS (SELECT length(s) AS len, count(*) / (SELECT count(*) FROM own) AS prob FROM own GROUP BY length(s)),
ll0 AS (SELECT list(len ORDER BY len) AS lens, list(prob ORDER BY len) AS w FROM ld), ll AS (SELECT lens, {_RUNNING} AS cum FROM ll0),
lw AS (SELECT len, pos, list(freq ORDER BY aa) AS w FROM lm GROUP BY len, pos), lc_ AS (SELECT len, pos, {_RUNNING} AS cum FROM lw),
sb AS (SELECT tag, sim, {_md5("tag || ':' || sim", 0)} AS x, {_md5("tag || ':' || sim", 1)} AS y FROM big, (SELECT unnest(range({NEW})) AS sim)),
sn AS (SELECT *, {_u(0)} AS u FROM sb),
sl AS (SELECT tag, sim, x, y, lens[least(len(list_filter(cum, lambda q: q <= u)), len(cum) - 1) + 1] AS len FROM sn, ll),
sp AS (SELECT tag, sim, len, pos, cum, {_u("pos")} AS u FROM (SELECT *, unnest(range(1, len + 1)) AS pos FROM sl) JOIN lc_ USING (len, pos)),
dn AS (SELECT tag, sim, string_agg(CASE WHEN pos = 1 THEN 'C' WHEN pos = len THEN 'F' ELSE '{RESIDUES}'[least(len(list_filter(cum, lambda q: q <= u)), 19) + 1] END, '' ORDER BY pos) AS seq FROM sp GROUP BY tag, sim),
ds AS ({_scored("dn", "seq")}), os AS ({_scored("own", "s")})"""
_NORM = f"""rl AS (SELECT * FROM refs WHERE length(s) >= 10), rs_ AS ({_scored("rl", "s")}), rsc AS (SELECT s, v, score FROM rl JOIN rs_ USING (s))"""


SQL = {
    "parse_sequences": _BASE + "x AS (SELECT 1) SELECT seq_ID AS seq_id, s AS cdr3b, v AS trbv, pt AS patient, n AS counts FROM q",
    "load_reference": _BASE + "x AS (SELECT 1) SELECT s AS cdr3b, v AS trbv FROM refs",
    "motif_region": _BASE + "x AS (SELECT 1) SELECT DISTINCT s AS cdr3b, CASE WHEN length(s) > 6 THEN s[4:-4] ELSE '' END AS motif_region FROM seqs",
    "find_motifs": _BASE + "un AS (SELECT DISTINCT s FROM seqs), " + _kmers("a", "un", "s") + " SELECT * FROM a",
    "find_motifs_mindepth": _BASE + "un AS (SELECT DISTINCT s FROM seqs), " + _kmers("a", "un", "s") + " SELECT * FROM a WHERE n >= 10",
    "find_motifs_discontinuous": _BASE
    + "un AS (SELECT DISTINCT s FROM seqs), k1(k) AS (VALUES (2), (3)), k2(k) AS (VALUES (3), (4)), "
    + _kmers("a", "un", "s", "k1")
    + ", "
    + _kmers("b", "un", "s", "k2")
    + """, o AS (SELECT unnest(list_transform(range(2, length(motif)), lambda i: motif[:i - 1] || '.' || motif[i + 1:])) AS motif, n FROM b WHERE n >= 3)
SELECT motif, n FROM a WHERE n >= 3 UNION ALL SELECT motif, sum(n)::BIGINT FROM o GROUP BY motif HAVING sum(n) >= 3""",
    "local_fisher_all": _BASE + _FISHER + f" SELECT motif, counts, num_in_ref, {_R6} FROM fisher",
    "local_fisher_selected": _BASE + _FISHER + f" SELECT motif, counts, num_in_ref, {_R6} FROM sel",
    "subsample_srswor": _BASE + _samples(DRAWN) + " SELECT sim::INTEGER AS sim, s AS cdr3b FROM dr",
    "subsample_len": _BASE + _stratified(["len"]),
    "subsample_vgene": _BASE + _stratified(["v"]),
    "subsample_both": _BASE + _stratified(["len", "v"]),
    "local_rrs": _BASE + _rrs(SIMS) + " SELECT motif, counts, round(avg_ref, 6) AS avg_ref, top_ref, round(ove, 9) AS ove, round(p, 6) AS p FROM rr",
    "local_rrs_selected": _BASE + _rrs(SIMS) + " SELECT motif, counts, round(avg_ref, 6) AS avg_ref, top_ref, round(ove, 9) AS ove, round(p, 6) AS p FROM rr WHERE ove >= length(motif) AND p < 0.01 AND counts >= 3",
    "rrs_sample_log": _BASE + _rrs(LOGGED) + " SELECT sim::INTEGER AS sim, motif, n FROM lg",
    "motif_positions": _BASE + _MEMBERS + " SELECT motif, s AS cdr3b, pos::INTEGER AS pos, full_pos::INTEGER AS full_pos FROM mem",
    "local_edges_fullpos": _BASE + _MEMBERS + " " + _edges("full_pos"),
    "local_edges_trimpos": _BASE + _MEMBERS + " SELECT v1, v2, motif AS tag FROM (" + _edges("pos") + ")",
    "hamming_pairs_d0": _BASE + "x AS (SELECT 1) " + _hamming(0),
    "hamming_pairs_d1": _BASE + "x AS (SELECT 1) " + _hamming(1),
    "hamming_pairs_d2": _BASE + "x AS (SELECT 1) " + _hamming(2),
    "hamming_pairs_d3_reference": _BASE + "x AS (SELECT 1) " + _hamming(3, "ref"),
    "hamming_pairs_vgene": _BASE + f"h AS ({_hamming(1)}) SELECT DISTINCT v1, v2 FROM h JOIN seqs a ON a.s = v1 JOIN seqs b ON b.s = v2 AND a.v = b.v",
    "hamming_isolated": _BASE + f"h AS ({_hamming(1)}) SELECT DISTINCT s AS cdr3b FROM sam WHERE s NOT IN (SELECT v1 FROM h UNION SELECT v2 FROM h)",
    "struct_tags": _BASE + _TAGS + " SELECT tag, n FROM shared",
    "struct_edges": _BASE + _TAGS + " SELECT a.s AS v1, b.s AS v2, tag FROM st a JOIN st b USING (tag) WHERE a.s < b.s",
    "struct_edges_blosum": _BASE + _TAGS + ", " + _PAIRS + " SELECT a.s AS v1, b.s AS v2, tag FROM st a JOIN st b USING (tag) JOIN pr ON x = a.aa || b.aa WHERE a.s < b.s",
    "struct_edges_vgene": _BASE + _TAGS + ", sv AS (SELECT DISTINCT tag, s, v FROM st JOIN shared USING (tag) JOIN seqs USING (s) WHERE v IS NOT NULL) SELECT a.s AS v1, b.s AS v2, tag, v AS trbv FROM sv a JOIN sv b USING (tag, v) WHERE a.s < b.s",
    "global_fisher_clusters": _BASE + _TAGS + ", " + _RTAGS + ", " + _Z
    + f", gs AS (SELECT tag, string_agg(DISTINCT aa, '' ORDER BY aa) AS aas, count(*) AS u FROM st JOIN shared USING (tag) GROUP BY tag) SELECT gs.tag, aas, u AS cluster_size, u AS unique_cdr3b, coalesce(rt.n, 0) AS num_in_ref, round({_tail('u', '(coalesce(rt.n, 0) + u)', 'greatest(nr + ns - coalesce(rt.n, 0) - u, 0)', 'ns')}, 6) AS p FROM gs LEFT JOIN rt ON rt.tag = gs.tag, zz",
    "global_fisher_blosum": _BASE + _TAGS + ", " + _RTAGS + ", " + _Z + ", " + _PAIRS + ", " + _global() + " SELECT tag, aas, cluster_size, u AS unique_cdr3b, num_in_ref, round(p, 6) AS p FROM gc",
    "global_fisher_vgene": _BASE + _TAGS + ", " + _RTAGS + ", " + _Z + ", " + _PAIRS + ", " + _global("v") + " SELECT tag, v AS trbv, aas, cluster_size, u AS unique_cdr3b, num_in_ref, round(p, 6) AS p FROM gc",
    "gliph1_components": _BASE + _MEMBERS + f", ce AS (SELECT v1, v2 FROM ({_edges('full_pos')}) UNION {_hamming(1)}), " + _CC
    + " SELECT grp AS leader, count(*) AS cluster_size, string_agg(member, ' ' ORDER BY member) AS members FROM cc GROUP BY grp HAVING count(*) >= 2",
    "gliph1_donor_groups": _BASE
    + f"h AS ({_hamming(1)}), kd AS (SELECT DISTINCT s, pt, v, s || chr(1) || pt || chr(1) || v AS id FROM seqs WHERE pt IS NOT NULL AND v IS NOT NULL), ce AS (SELECT a.id AS v1, b.id AS v2 FROM h JOIN kd a ON a.s = h.v1 JOIN kd b ON b.s = h.v2 AND a.pt = b.pt AND a.v = b.v), "
    + _CC
    + """, gg AS (SELECT grp, min(s) AS leader, count(DISTINCT s) AS n, string_agg(DISTINCT s, ' ' ORDER BY s) AS members FROM cc JOIN kd ON id = member GROUP BY grp HAVING count(DISTINCT s) >= 2)
SELECT 'CRG-' || leader || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS tag, n AS cluster_size, members FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY grp) - 1 AS k FROM gg)""",
    "gliph2_clusters": _BASE + _MEMBERS + ", " + _TAGS + ", " + _RTAGS + ", " + _Z + ", " + _PAIRS + ", " + _global()
    + """, lc AS (SELECT motif, min(pos) AS a, max(pos) AS b, count(DISTINCT s) AS n FROM mem GROUP BY motif)
SELECT 'local' AS type, motif || '_' || a || '_' || b AS tag, n AS cluster_size, counts AS unique_cdr3_sample, num_in_ref AS unique_cdr3_ref, round(ove, 6) AS ove, round(p, 6) AS p FROM sel JOIN lc USING (motif) WHERE n >= 2
UNION ALL SELECT 'global', tag || '_' || aas, cluster_size, u, num_in_ref, 0.0, round(p, 6) FROM gc WHERE cluster_size >= 2""",
    "gliph2_edges": _BASE + _MEMBERS + ", " + _TAGS + ", " + _PAIRS + ", " + _global_rows() + ", " + _EDGES,
    "germline_ranges": _BASE + _GERM
    + """ SELECT s AS cdr3b, start_1::INTEGER AS start_1, stop_1::INTEGER AS stop_1, start_2::INTEGER AS start_2, stop_2::INTEGER AS stop_2,
array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN (i BETWEEN start_1 AND stop_1) OR (i BETWEEN start_2 AND stop_2) THEN lower(s[i]) ELSE s[i] END), '') AS masked FROM gm""",
    "germline_boost": _BASE + _MEMBERS + ", " + _GERM
    + """, sp AS (SELECT motif, min(pos) AS a FROM mem GROUP BY motif), bo AS (SELECT motif, count(*) FILTER ((start_1 <= a + length(motif) - 1 AND stop_1 >= a) OR (start_2 <= a + length(motif) - 1 AND stop_2 >= a)) AS hits
FROM mem JOIN sp USING (motif) JOIN gm USING (s) JOIN seqs USING (s) GROUP BY motif) SELECT motif, round(p / pow(2.0, hits), 9) AS p_boosted FROM sel JOIN bo USING (motif)""",
    "score_size": _BASE + _GROUPS
    + """, ss(x) AS (VALUES (125), (500), (2000), (10000)), ne AS (SELECT x FROM ss ORDER BY abs(1.0 - x / (SELECT count(*) FROM seqs)), x LIMIT 1)
SELECT tag, round(1 / (least(count(*), 100) + (SELECT x FROM ne) / 1000), 9) AS score FROM gd GROUP BY tag""",
    "score_length": _BASE + _GROUPS + ", " + _category(*_LEN, ">", "len") + " SELECT tag, round(score, 6) AS score FROM cx",
    "score_vgene": _BASE + _GROUPS + ", " + _category(*_VGENE, ">=", "v") + " SELECT tag, round(score, 6) AS score FROM cx",
    "score_clonal": _BASE + _GROUPS + ", " + _CLONAL + " SELECT tag, score FROM cl",
    "score_hla": _BASE + _GROUPS + ", " + _HLA + " SELECT tag, round(score, 6) AS score FROM hs",
    "hla_listing": _BASE + _GROUPS + ", " + _HLA + ", " + _HLA_TEXT + " SELECT * FROM hl",
    "score_total_v1": _BASE + _GROUPS + ", " + _totals_sql(">=", 0.064),
    "score_total_v2": _BASE + _GROUPS + ", " + _totals_sql(">", 1.0),
    "ref_frequencies": _BASE
    + "fl AS (SELECT 'length' AS kind, length(s)::VARCHAR AS c FROM (SELECT DISTINCT s FROM refs) UNION ALL SELECT 'vgene', v FROM refs WHERE v IS NOT NULL) SELECT kind, c AS category, round(count(*) / sum(count(*)) OVER (PARTITION BY kind), 9) AS freq FROM fl GROUP BY kind, c",
    "pwm_scoring": _BASE + _GROUPS + ", " + _pwm(["tag", "pos"], "length(s) >= 10", "10"),
    "pwm_prediction": _BASE + _GROUPS + ", " + _pwm(["tag", "len", "pos"], "length(s) >= 10", "length(s)"),
    "length_distribution": _BASE + _GROUPS + " SELECT tag, length(s)::INTEGER AS len, round(count(*) / sum(count(*)) OVER (PARTITION BY tag), 9) AS prob FROM g WHERE length(s) >= 10 GROUP BY tag, length(s)",
    "network_nodes": _BASE + _GROUPS + ", " + _HLA + ", " + _NODES + " SELECT id, label, nn.tag, round(size, 6) AS size, round(score, 6) AS weight FROM nn LEFT JOIN hs USING (tag)",
    "network_edges": _BASE + _GROUPS + ", " + _NODES
    + ", ee AS (SELECT * FROM (SELECT " + _CLEAN.format("V1") + " AS v1, " + _CLEAN.format("V2") + " AS v2, lower(" + _CLEAN.format("type") + ") AS type FROM clone_network) WHERE type IN ('local', 'global') AND v1 <> v2) SELECT least(a.id, b.id) AS \"from\", greatest(a.id, b.id) AS \"to\", max(type) AS label FROM ee JOIN nn a ON a.label = ee.v1 JOIN nn b ON b.label = ee.v2 AND a.tag = b.tag GROUP BY ALL",
    "roundtrip_save_load": _BASE + _GROUPS + " SELECT tag, s AS cdr3b FROM gd",
    "network_legend": _BASE + _GROUPS + ", " + _HLA + ", " + _NODES
    + " SELECT step::INTEGER AS step, round(lo + (hi - lo) * step / 50, 9) AS weight FROM (SELECT min(score) AS lo, max(score) AS hi FROM nn LEFT JOIN hs USING (tag)), (SELECT unnest(range(0, 51, 10)) AS step)",
    "network_motif_edges": _BASE + _MEMBERS
    + """, ap AS (SELECT motif, s, p FROM (SELECT motif, s, mr, unnest(range(1, length(mr) - length(motif) + 2)) AS p FROM mem JOIN sam USING (s)) WHERE mr[p:p + length(motif) - 1] = motif)
SELECT DISTINCT a.s AS v1, b.s AS v2, a.motif FROM ap a JOIN ap b ON a.motif = b.motif AND a.s < b.s WHERE abs(a.p - b.p) < 3""",
    "gliph2_members": _BASE + _MEMBERS + ", " + _SPANS + ", " + _TAGS + ", " + _RTAGS + ", " + _Z + ", " + _PAIRS + ", " + _global("v")
    + """ SELECT lc.tag, seq_ID AS seq_id FROM mem JOIN lc USING (motif) JOIN seqs USING (s) WHERE lc.n >= 2
UNION SELECT gr.tag || '_' || gr.v || '_' || cg.aas, seq_ID FROM gr JOIN cg ON gr.tag = cg.tag AND gr.v = cg.v AND gr.aa = cg.a JOIN gc ON gc.tag = gr.tag AND gc.v = gr.v AND gc.aas = cg.aas JOIN seqs ON seqs.s = gr.s AND seqs.v = gr.v""",
    "roundtrip_text": _BASE + _GROUPS + " SELECT tag, s AS cdr3b FROM gd",
    "denovo_generate": _BASE + _GROUPS + ", " + _NEW + " SELECT DISTINCT tag, seq FROM dn",
    "denovo_rank": _BASE + _GROUPS + ", " + _NEW
    + " SELECT row_number() OVER (ORDER BY score DESC, seq)::INTEGER AS rank, length(seq)::INTEGER AS length, seq, round(score, 12) AS score, seq IN (SELECT s FROM own) AS known FROM ds ORDER BY ds.score DESC, seq LIMIT 1000",
    "denovo_norm": _BASE + _GROUPS + ", " + _NEW + ", " + _NORM
    + """, nz AS (SELECT seq, score, (SELECT count(*) FROM rsc WHERE rsc.score >= dv.score) / (SELECT count(*) FROM rsc) AS norm FROM (SELECT seq, score FROM ds) dv)
SELECT length(seq)::INTEGER AS length, seq, round(score, 12) AS score, round(norm, 9) AS norm FROM nz ORDER BY nz.norm, nz.score DESC, seq LIMIT 1000""",
    "denovo_members": _BASE + _GROUPS + ", " + _NEW + ", " + _NORM
    + """, ms AS (SELECT seq_ID, s, v, score FROM own JOIN (SELECT s, score FROM os) USING (s))
SELECT seq_ID AS seq_id, s AS cdr3b, round(score, 12) AS score, round((SELECT count(*) FROM rsc WHERE rsc.v = ms.v AND rsc.v <> '' AND rsc.score >= ms.score) / (SELECT count(*) FROM rsc), 9) AS norm FROM ms""",
    "run_gliph2": _OWN_REFS + _MEMBERS_ONE + ", " + _SPANS + ", " + _TAGS + ", " + _RTAGS + ", " + _Z + ", " + _PAIRS + ", " + _global() + ", " + _RUN_SCORES,
    "run_gliph2_connections": _OWN_REFS + _MEMBERS_ONE + ", " + _TAGS + ", " + _PAIRS + ", " + _global_rows() + ", " + _EDGES,
    "run_gliph1": _OWN_REFS + _rrs(20, "ref", "sam") + ", sel AS (SELECT motif FROM rr WHERE ove >= 1 AND p < 0.051 AND counts >= 3 AND length(motif) = 4), " + _MEM + f", ce AS (SELECT v1, v2 FROM ({_edges('full_pos')}) UNION {_hamming(1)}), " + _CC
    + " SELECT 'CRG-' || grp AS tag, count(*) AS cluster_size, string_agg(member, ' ' ORDER BY member) AS members FROM cc GROUP BY grp HAVING count(*) >= 2",
}
