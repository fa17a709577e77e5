import random
import sys
from collections import Counter, defaultdict

import pytest
from sqlcheck import FOLDER, rows_of, rows_of_sql

from clonelake.llm import bpe, queries
from clonelake.llm.canonical import Resolver, resolve_values
from clonelake.llm.components import connected_components
from clonelake.llm.frequencies import dictionary, marked, term_frequencies
from clonelake.llm.mixing import mix_sources
from clonelake.llm.near import near_groups, near_pairs
from clonelake.llm.sampling import feasible, proportional_sample, whole_quotas
from clonelake.llm.sentences import Segmenter, split_sentences
from clonelake.llm.vgenes import BETA


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, FOLDER)) == rows_of_sql(queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


# 1


def test_sample(spark):
    items = [("a", f"x{i}") for i in range(600)] + [("b", f"x{i}") for i in range(30)] + [("c", "x1"), ("d", "x"), (None, "x"), ("a", None)] + [("a", "x1")] * 50
    targets = [("a", 0.5, 0), ("b", 0.4, 10), ("c", 0.05, 2), ("e", 0.05, None), (None, 0.0, 1)]
    df = spark.createDataFrame(items, "k string, v string").selectExpr("*", "1 AS cat", "2 AS item")
    t = spark.createDataFrame(targets, "k string, share double, least int")
    got = proportional_sample(df, "k", "v", t, "share", "least")
    pool = {x for x in items if x[0] in ("a", "b", "c") and x[1]}
    s = len(pool) // 5
    report = {r.k: r for r in got.report.collect()}
    assert {k: r.available for k, r in report.items()} == {"a": 600, "b": 30, "c": 1, "e": 0}
    assert {k: (r.short_target, r.short_minimum) for k, r in report.items()} == {"a": (False, False), "b": (30 < 0.4 * s, False), "c": (1 < 0.05 * s, True), "e": (True, False)}
    rows = [tuple(r) for r in got.rows.collect()]
    assert len(rows) == len(set(rows)) and set(rows) <= pool
    assert Counter(k for k, _ in rows) == {k: r.quota for k, r in report.items() if r.quota} == {k: r.taken for k, r in report.items() if r.taken}
    assert sum(r.quota for r in report.values()) == s and sum(r.share for r in report.values()) == pytest.approx(1)
    again = proportional_sample(df.repartition(7), "k", "v", t, "share", "least", slack=50.0)
    assert {tuple(r) for r in again.rows.collect()} == set(rows)  # reservoirs merge alike however they are cut
    plain = {r.k: r.quota for r in proportional_sample(df, "k", "v", t, "share", "least", refill=False).report.collect()}
    assert plain == {"a": round(0.5 * s), "b": 30, "c": 1, "e": 0}


def test_small_reservoirs_are_made_again(spark):
    items = [("a", f"x{i}") for i in range(20_000)] + [("b", f"x{i}") for i in range(9_000)] + [("c", f"x{i}") for i in range(15)]
    df = spark.createDataFrame(items, "k string, v string")
    t = spark.createDataFrame([("a", 0.3, 0), ("b", 0.6, 0), ("c", 0.1, 20)], "k string, share double, least int")
    want = {tuple(r) for r in proportional_sample(df, "k", "v", t, "share", "least").rows.collect()}
    got = proportional_sample(df, "k", "v", t, "share", "least", slack=-9.0)  # too small on purpose
    assert {tuple(r) for r in got.rows.collect()} == want and len(want) == 29_015 // 5
    assert Counter(k for k, _ in want)["c"] == 15


def test_quotas():
    import numpy as np

    rnd = np.random.default_rng(5)
    for _ in range(300):
        n = rnd.integers(1, 8)
        available, least = rnd.integers(0, 60, n), rnd.integers(0, 12, n)
        share = rnd.random(n) * (rnd.random(n) > 0.2)
        size = int(rnd.integers(0, 150))
        real = feasible(available, share, least, size)
        low = np.minimum(least, available)
        assert (real >= low - 1e-9).all() and (real <= available + 1e-9).all()
        whole = whole_quotas(real, available, size)
        assert (np.abs(whole - real) < 1 + 1e-6).all() and (whole <= available).all() and (whole >= low).all()
        grows = (share > 0) & (available > low)
        if low.sum() < size and (available[grows].sum() + low[~grows].sum()) > size:
            assert real.sum() == pytest.approx(size) and whole.sum() == size
            inner = (real > low + 1e-6) & (real < available - 1e-6)
            assert np.ptp(real[inner] / share[inner]) < 1e-6 if inner.any() else True


def test_sample_of_nothing(spark):
    t = spark.createDataFrame([("a", 1.0, 3)], "k string, share double, least int")
    got = proportional_sample(spark.createDataFrame([], "k string, v string"), "k", "v", t, "share", "least")
    r = got.report.first()
    assert (r.available, r.quota, r.short_target, r.short_minimum) == (0, 0, False, True) and got.rows.count() == 0


# 2


def test_frequencies(spark):
    rnd = random.Random(1)
    rows = [("f", rnd.choice(["hot"] * 20 + [f"t{i}" for i in range(9000)] + ["", None]), rnd.choice(["r1", "r2", "r3", None])) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "field string, term string, record string")
    got = {r.term: (r.occurrences, r.records) for r in term_frequencies(df).collect()}
    occurrences, records = Counter(), defaultdict(set)
    for _, t, r in rows:
        if t is not None:
            occurrences[t] += 1
            records[t] |= {r} - {None}
    assert got == {t: (n, len(records[t])) for t, n in occurrences.items()}
    ids = sorted(r.id for r in dictionary(df.filter("term is not null"), ["field", "term"]).collect())
    assert ids == list(range(len(occurrences)))
    totals = spark.createDataFrame([("f", 3)], "field string, all bigint")
    assert {r.term: r.mark for r in marked(term_frequencies(df), totals, 3, {"f": 90}).collect()}["hot"] == "common"
    assert term_frequencies(df.limit(0)).count() == 0


# 4


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ends = [x for x in (a, b) if x is not None]
        if ends:
            ra, rb = root(ends[0]), root(ends[-1])
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "tree", "odd"])
def test_components(spark, kind):
    rnd = random.Random(kind)
    name = list(range(500))
    rnd.shuffle(name)
    n = lambda i: f"v{name[i]:03}"
    edges = {
        "random": [(n(rnd.randrange(400)), n(rnd.randrange(400))) for _ in range(330)],
        "chain": [(n(i), n(i + 1)) for i in range(300)],
        "star": [(n(0), n(i)) for i in range(1, 400)] + [(n(i), n(i + 1)) for i in range(400, 450)],
        "tree": [(n(i), n(i // 2)) for i in range(1, 400)],
        "odd": [("a", None), (None, "b"), (None, None), ("c", "c"), ("d", "e"), ("e", "d"), ("d", "e"), ("", "f")],
    }[kind]
    df = spark.createDataFrame(edges, "a string, b string").selectExpr("*", "1 AS member", "2 AS grp")
    got = [tuple(r) for r in connected_components(df, "a", "b").collect()]
    assert len(got) == len(set(got)) and dict(got) == union_find(edges)


def test_components_of_hot_vertices(spark, monkeypatch):
    from clonelake.llm import components

    monkeypatch.setattr(components, "EASY", 10)
    monkeypatch.setattr(components, "HOT", 20)
    edges = [("hub", f"x{i}") for i in range(300)] + [(f"x{i}", f"y{i}") for i in range(0, 300, 7)] + [("p", "q")]
    df = spark.createDataFrame(edges, "a string, b string")
    assert dict(tuple(r) for r in components.connected_components(df, "a", "b").collect()) == union_find(edges)
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


# 5

GENES = ["TRBV7-2", "TRBV7-3", "TRBV10-1", "TRBV11-3", "TRBV9", "TRBV1", "TRBV12-3", "TRBV20-1", "TRBV30", "TRBV2"]
MEANT = {
    "TRBV7-2": ["trbv7-2", "TRBV7-2*01", "TCRBV07-02*01", "Vβ7.2", "Vb 7.2", "BV7S2", "TRBV 7-2 ", "TRBV7_2", "TRBV7/2", "TRBV7 - 2", "TRBV7–2", "T R B V 7-2", "TBRV7-2", "TRVB7-2", "TRBVV7-2", "TRBW7-2", "TR8V7-2", "RBV7-2", "TRB7-2", '"TRBV7-2"', "TRBV7-2?", "TRBV7-2 (F)", "TRBV7-2 gene", "Homsap TRBV7-2*01 F", "hTRBV7-2*03", "ＴＲＢＶ７－２", "beta chain V 7-2", "vbeta 7-2", "trbv-7-2*01", "TRBV:7-2", "V7-2", "TRBV7-2\xa0", "TRBV7 2", "TRBV07-2"],
    "TRBV11-3": ["TRBVl1-3", "TRBVI1-3", "TRBV11-3;"],
    "TRBV10-1": ["TRBV1O-1", "TRBV1o-1*01", "TRBV10-I", "TRBV10-l", "TRBVl0-1", "TRBV10S1"],
    "TRBV1": ["TRBVI", "TRBVl", "TRBV1*01"],
    "TRBV30": ["TRBV3O", "TRBV3o*01", "Vb30"],
    "TRBV9": ["TRBV9", "V9", "beta chain V 9", "TRBV 9"],
    "UNMATCHED": ["", " ", "TRBV", "TRBV7", "TRBV20", "TRBV41", "TRBV6-31", "TRBV99-1", "TRAV7-2", "TRAV 7-2", "IGHV3-23", "TRGV9", "TRDV2", "TRBJ2-7", "TRBD1", "TRBC2", "TRBV7-2/TRBV7-3", "TRBV7-2 or TRBV7-3", "TRBV7-2,TRBV7-3", "trbv12*01", "unknown", "n/a", "-", "pseudogene", "V?", "Vβ", "TRBV2-1", "TRBV7-21"],
}


def test_names_that_are_meant(spark):
    resolver = Resolver(GENES, rules=BETA)
    assert {x: resolver.resolve(x) for xs in MEANT.values() for x in xs} == {x: g for g, xs in MEANT.items() for x in xs}
    rows = [(i, x, "clash") for i, x in enumerate([*MEANT["TRBV7-2"], None, *MEANT["UNMATCHED"]])]
    df = spark.createDataFrame(rows, "id int, v string, gene2 string")
    got = {r.id: r.gene for r in resolve_values(df, "v", GENES, rules=BETA).collect()}
    assert got == {i: None if x is None else resolver.resolve(x) for i, x, _ in rows}
    assert resolve_values(df.limit(0), "v", GENES, rules=BETA).count() == 0
    assert Resolver([], rules=BETA).resolve("TRBV7-2") == Resolver([]).resolve("x") == "UNMATCHED"
    both = Resolver(["TRBV7-2", "TRAV7-2", "TRBC"], rules=BETA)
    assert len(both.names) == 3 and both.resolve("vb7.2") == "TRBV7-2"


def test_names_of_any_list(spark):
    cities = ["Paris", "London", "New York", "Newcastle upon Tyne", "São Paulo", "San José", "San Juan", "York", "Springfield 3", "Springfield 4"]
    resolver = Resolver(cities, {"New York": ["NYC", "Big Apple"], "London": ["Londres"]})
    meant = {
        "Paris": ["paris", " PARIS, France", "Pariss", "the city of Paris"],
        "London": ["LONDON", "Londres", "Lodnon", "Londn"],
        "New York": ["new-york", "NYC", "New York City", "the big apple", "New Yrok"],
        "York": ["York", "york (UK)"],
        "Newcastle upon Tyne": ["Newcastle-upon-Tyne", "Tyne Newcastle upon", "Newcastel upon Tyne"],
        "São Paulo": ["sao paulo", "SÃO PAULO"],
        "San José": ["San Jose", "Jose, San"],
        "Springfield 3": ["springfield 3", "3 Springfeld"],
        "UNMATCHED": ["", "San", "Paris or London", "Springfield", "Springfield 5", "Berlin", "upon", "Parisian", "New"],
    }
    assert {x: resolver.resolve(x) for xs in meant.values() for x in xs} == {x: c for c, xs in meant.items() for x in xs}
    df = spark.createDataFrame([(x,) for xs in meant.values() for x in xs] + [(None,)], "v string")
    got = {r.v: r.city for r in resolve_values(df, "v", cities, "city", {"New York": ["NYC", "Big Apple"], "London": ["Londres"]}).collect()}
    assert got == {x: c for c, xs in meant.items() for x in xs} | {None: None}
    twice = Resolver(["Main St", "Main Street"], {"Main St": ["High St"], "Main Street": ["High St"]})
    assert twice.resolve("main street") == "Main Street" and twice.resolve("high st") == "UNMATCHED"
    with pytest.raises(ValueError):
        Resolver(["a"], {"b": ["c"]})


# 6


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        i = rnd.randrange(len(s))
        kind = rnd.randrange(4)
        if kind == 0:
            s[i] = rnd.choice("ACDEFGHIKLMNPQRSTVWY")
        elif kind == 1:
            s.insert(i, rnd.choice("ACDY"))
        elif kind == 2 and len(s) > 1:
            del s[i]
        elif i + 1 < len(s):
            s[i], s[i + 1] = s[i + 1], s[i]
    return "".join(s)


@pytest.mark.parametrize("sizes", [(5, 9), (11, 15), (12, 16), (18, 23), (26, 36)])
def test_near_pairs(spark, sizes):
    rnd = random.Random(sizes[0])
    own = []
    for _ in range(40):
        base = "".join(rnd.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rnd.randint(*sizes)))
        own += [base, *(edited(rnd, base, rnd.randint(1, max(1, len(base) // 7 + 1))) for _ in range(5))]
    own = sorted({x for x in own if x})
    want = {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if abs(len(a) - len(b)) <= 6 and 7 * osa(a, b) <= max(len(a), len(b))}
    assert want
    rows = [*own, *own[:9], None, "", "casx", "CAS*F", "B" * 20]
    df = spark.createDataFrame([(x, "clash") for x in rows], "s string, a string")
    got = [tuple(r) for r in near_pairs(df, "s").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_pairs_edges(spark):
    df = spark.createDataFrame([("ACDEFGH",), ("ACDEFHG",), ("ACDEFG",), ("A" * 400,), ("A" * 380,)], "s string")
    assert {tuple(r) for r in near_pairs(df, "s").collect()} == {("ACDEFGH", "ACDEFHG"), ("ACDEFG", "ACDEFGH"), ("A" * 380, "A" * 400)} | {("ACDEFG", "ACDEFHG")}
    assert near_pairs(df.limit(0), "s").count() == 0


def test_groups_of_near_sequences(spark):
    own = ["CASSLAPGATNEQFF", "CASSLAPGATNEKFF", "CASSLAPGWTNEKFF", "CASSLAPGWWNEKFF", "CASSQQQQQQ", "CASSQQQQQW", "CAWWWWWWWWWWF", None, "bad", ""]
    df = spark.createDataFrame([(x, 1) for x in own + own[:3]], "s string, grp int")
    got = {r.member: (r.grp, r.links) for r in near_groups(df, "s").collect()}
    valid = [x for x in own if x and x != "bad"]
    near = {x: [y for y in valid if x != y and 7 * osa(x, y) <= max(len(x), len(y))] for x in valid}
    groups = union_find([(x, y) for x in valid for y in [x, *near[x]]])
    assert got == {x: (groups[x], len(near[x])) for x in valid}
    assert near_groups(df.limit(0), "s").count() == 0


def test_pairs_in_small_portions(monkeypatch):
    import numpy as np

    from clonelake.llm import near

    rnd = random.Random(1)
    base = "CASSLAPGATNEQFF"
    own = sorted({edited(rnd, base, 2) for _ in range(60)})
    keys, owners = [np.zeros(len(own), dtype=np.uint64)] * 2, [np.arange(len(own))] * 2
    want = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if 7 * osa(own[i], own[j]) <= max(len(own[i]), len(own[j]))}
    for n in (10**6, 100, 1):
        monkeypatch.setattr(near, "CANDIDATES", n)
        got = {tuple(sorted(x)) for i, j in near._pairs_within(own, keys, owners) for x in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == want


def test_heavy_kmers_are_split(spark):
    import numpy as np

    from clonelake.llm.near import KMERS, Deal

    load = np.ones(KMERS)
    load[7] = 10_000
    deal = Deal(load, list(range(10)), 1000.0)
    keys = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)
    assert len(set(deal.task(keys, np.full(5000, 7)).tolist())) == 10
    assert len(set(deal.task(keys, np.full(5000, 8)).tolist())) == 1


# 8

TEXTS = [None, "", " ", "Hello, world! It's  3.14\n\n\tdon't 'quote'", "为什么阀门会失效？", "เพลาหยุดทำงาน 12", "q̇ ≤ 27.69·ΔV", "<|endoftext|> a", "a" * 5000, "x\x1c\x1dy z  ", "'s 'LL we'll're they''s", "𝔘𝔫𝔦 🙂🙂", "é́", "१२ ½ ⅷ", "　 b\xa0\xa0c \n", "CASSLAPGATNEKLFF" * 30]


def test_ids(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT)
    t.encode_special_tokens = True
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice(" \n'abcdé中ก١,.-") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, x, 5) for i, x in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode_texts(df, "doc_id", "text").collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    counts = {r.doc_id: r.tokens for r in bpe.count_tokens(df, ["doc_id"], "text").collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def _content(name="byte_bpe_50k.json"):
    with open(bpe.DEFAULT.replace("byte_bpe_50k.json", name), "rb") as f:
        return f.read()


def test_long_pieces_merge_alike():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT)
    own, rnd = bpe.BytePairs(_content()), random.Random(4)
    pieces = ["a" * 5000, "ab" * 3000 + "a", "é" * 3000, "-" * 2500 + "=" * 2501, "the" * 4000, "aaab" * 2000]
    pieces += ["".join(rnd.choice(x) for _ in range(n)) for x, n in (("etaoinshrdlu", 4097), ("aab", 9000), ("abcdefgh", 2048), ("อกขคงจฉชซ", 3000))]
    assert own.ordered
    for x, ids in zip(pieces, own.merge([x.encode() for x in pieces]), strict=True):
        assert ids.tolist() == t.encode(x, add_special_tokens=False).ids
    own.ordered = False  # the same by single merges
    assert all(a.tolist() == b.tolist() for a, b in zip(own.merge([x.encode() for x in pieces[:3]]), [own._merge_long(x.encode()) for x in pieces[:3]], strict=True))


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError):
        bpe.BytePairs(_content("word_bpe_49k.json"))
    with pytest.raises(ValueError):
        bpe.encode_texts(spark.createDataFrame([(1, "a")], "k int, t string"), "k", "t", bpe.DEFAULT.replace("byte_bpe_50k", "word_bpe_49k"))


def test_forgetting_changes_nothing(monkeypatch):
    own = bpe.BytePairs(_content())
    whole = own.encode(TEXTS)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "CHUNK", 10)
    parts = own.encode(TEXTS)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


# 9


def test_mix(spark):
    docs = [(i, "abc"[i % 3] if i % 4 else "a", (i * 7) % 50 + 1) for i in range(3000)] + [(9000, None, 5), (9001, "unlisted", 7), (9002, "a", None)]
    weights = [("a", 0.2, 1), ("b", 0.3, 1), ("c", 0.4, 3), ("d", 0.1, 5), ("e", None, None)]
    s = spark.createDataFrame(docs, "k long, src string, n long")
    w = spark.createDataFrame(weights, "source string, weight double, max_repeats int")
    mix = mix_sources(s, "k", "src", "n", w)
    rows = [tuple(r) for r in mix.rows.select("k", "src", "repeat", "n").collect()]
    report = {r.source: r for r in mix.report.collect()}
    total = sum(n for _, x, n in docs if x in ("a", "b", "c") and n)
    assert len(rows) == len(set(rows)) and total - 100 <= sum(r[3] for r in rows) <= total
    assert all(r[2] <= {"a": 1, "b": 1, "c": 3}[r[1]] for r in rows)
    own = Counter()
    for _, x, n in docs:
        own[x] += n or 0
    for name, weight, most in weights:
        assert report[name].exhausted == ((most or 1) * own[name] < (weight or 0) * total)
        assert report[name].taken == sum(r[3] for r in rows if r[1] == name)
    assert sum(r.share for r in report.values()) == pytest.approx(1)
    small = mix_sources(s, "k", "src", "n", w, budget=1000)
    shares = {r.source: r.share for r in small.report.collect()}
    for name, weight, _ in weights[:3]:
        assert shares[name] == pytest.approx(weight / 0.9, abs=0.06)


def test_mix_of_nothing(spark):
    w = spark.createDataFrame([("a", 1.0, 2)], "source string, weight double, max_repeats int")
    mix = mix_sources(spark.createDataFrame([], "k long, source string, n long"), "k", "source", "n", w)
    assert mix.rows.count() == 0 and mix.report.first().taken == 0


def test_mix_is_a_beginning_of_the_sorted_queue(spark):
    even = [(i, f"s{i % 10}", 100) for i in range(40)]
    rnd = random.Random(3)
    odd = [(i, rnd.choice("abc"), rnd.choice([0, 1, 7, 400, 90_000])) for i in range(200)]
    cases = [(even, {f"s{i}": (0.1, 1) for i in range(10)}, b) for b in (300, 0, 99, 10_000)]
    cases += [(odd, {"a": (0.7, 2), "b": (0.2, 1), "c": (0.1, 9)}, b) for b in (None, 500, 1_000_000)]
    for docs, weights, budget in cases:
        s = spark.createDataFrame(docs, "k long, src string, n long")
        w = spark.createDataFrame([(x, *y) for x, y in weights.items()], "source string, weight double, max_repeats int")
        full = sorted((r.finish, r.src, r["repeat"], r.k, r.n) for r in mix_sources(s, "k", "src", "n", w, budget=10**12).rows.collect())
        assert Counter((x[3], x[1]) for x in full) == Counter({(k, x): weights[x][1] for k, x, _ in docs})
        upto = Counter()
        for f, x, _, _, n in sorted(full, key=lambda x: (x[1], x[0])):
            upto[x] += n
            assert n == 0 or f == pytest.approx(upto[x] / weights[x][0])
        left = sum(n for _, _, n in docs) if budget is None else budget
        want = []
        for row in full:
            left -= row[4]
            if left < 0:
                break
            want.append(row[1:])
        mix = mix_sources(s, "k", "src", "n", w, budget=budget)
        assert sorted((r.src, r["repeat"], r.k, r.n) for r in mix.rows.collect()) == sorted(want)


# 10

SENTENCES = [
    ("Title here\n \r\nA valve, e.g. of steel, opens. It costs 3.5 kg.\nNext goes on.", ["Title here", "A valve, e.g. of steel, opens.", "It costs 3.5 kg.", "Next goes on."]),
    ("1. A device as in FIG. 2, i.e. narrow. 2.5 mm is cf. Sec. 3.1 too.", ["1. A device as in FIG. 2, i.e. narrow.", "2.5 mm is cf. Sec. 3.1 too."]),
    ('It reads "Stop! Do not open." before noon. A label is marked "closed." pH falls.', ['It reads "Stop! Do not open." before noon.', 'A label is marked "closed."', "pH falls."]),
    ("One wrote: 'It sticks. It must be oiled.' and left. (The lid is off.) Then A. B. Quillor et al. came.", ["One wrote: 'It sticks. It must be oiled.' and left.", "(The lid is off.)", "Then A. B. Quillor et al. came."]),
    ("Sold by Kestra & Co. The rest by Brinnow Corp. and others.It ends.", ["Sold by Kestra & Co.", "The rest by Brinnow Corp. and others.", "It ends."]),
    ("It may be thin ... or thick. The cause was not found... Later it was.", ["It may be thin ... or thick.", "The cause was not found...", "Later it was."]),
    ("压力为5.90 kPa，温度为4℃。他问道：“是否抵接？”如图5所示。标签写有“停！不要打开。”字样，随后被套设。", ["压力为5.90 kPa，温度为4℃。", "他问道：“是否抵接？”", "如图5所示。", "标签写有“停！不要打开。”字样，随后被套设。"]),
    ("「止まれ！開けるな。」という表示の後、固定される。注意！", ["「止まれ！開けるな。」という表示の後、固定される。", "注意！"]),
    ("Das 2. Lager ist, z. B. bzgl. des 1. Rohr, lösbar. Es gibt Lager usw. Das hält.", ["Das 2. Lager ist, z. B. bzgl. des 1. Rohr, lösbar.", "Es gibt Lager usw.", "Das hält."]),
    ("В 1998 г. были кольца и т. д. вал закреплён, т. е. узел 7 (см. табл. 5). Ок.", ["В 1998 г. были кольца и т. д.", "вал закреплён, т. е. узел 7 (см. табл. 5).", "Ок."]),
    ("मोटाई 7.12 मि.मी. है। डॉ. ओरविल आए। क्या?", ["मोटाई 7.12 मि.मी. है।", "डॉ. ओरविल आए।", "क्या?"]),
    ("รูปที่ 1 แสดง ความหนา 5 มม เพลา", ["รูปที่ 1 แสดง", "ความหนา 5 มม", "เพลา"]),
    ("L'écran indique « Arrêt ! Ne pas ouvrir. » puis il est vissé. Pourquoi ?", ["L'écran indique « Arrêt ! Ne pas ouvrir. » puis il est vissé.", "Pourquoi ?"]),
    ("لماذا يتعطل؟ يتصل الحلقة.", ["لماذا يتعطل؟", "يتصل الحلقة."]),
    (" \n\t ", []),
    ("", []),
    (None, []),
]


def test_sentences(spark):
    own = Segmenter()
    for text, want in SENTENCES:
        assert [text[a:b] for a, b in own.sentences(text)] == want
    df = spark.createDataFrame([(i, x, 1) for i, (x, _) in enumerate(SENTENCES)], "doc_id long, text string, start_pos int")
    got = defaultdict(list)
    for r in split_sentences(df, "doc_id", "text").orderBy("doc_id", "start_pos").collect():
        got[r.doc_id].append(SENTENCES[r.doc_id][0][r.start_pos : r.end_pos])
    assert got == {i: w for i, (_, w) in enumerate(SENTENCES) if w}
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0


def test_long_brackets_and_quotations():
    inner = "It opens at noon. " * 80
    for text in (f"The valve ({inner}) is closed. It ends.", f"It reads “{inner.strip()}” before noon. It ends.", f'It reads "{inner.strip()}" before noon. It ends.'):
        assert [text[a:b][-12:] for a, b in Segmenter().sentences(text)] == [text[: -len(" It ends.")][-12:], "It ends."]
    for mark in ("(", "“ ", ' "'):  # open marks without a mate take no time
        assert len(Segmenter().sentences((mark + "It opens. ") * 20_000)) > 10_000


def test_abbreviations_of_one_document(spark):
    shown = "Der Zyl. ist lang. Er hat einen Zyl. Brinnow nach innen. Am Zyl. Quillor liegt er."
    text = "The qual. level is low. A qual. Brinnow test follows. It has a qual. The level is low in the bath."
    plain = "It has a level. Brinnow came. The level is low. The level. it fell."
    spaceless = "See the mech.,and so on. See the mech. Quillor part."
    cases = [
        (shown, ["Der Zyl. ist lang.", "Er hat einen Zyl. Brinnow nach innen.", "Am Zyl. Quillor liegt er."]),
        (text, ["The qual. level is low.", "A qual. Brinnow test follows.", "It has a qual.", "The level is low in the bath."]),
        (plain, ["It has a level.", "Brinnow came.", "The level is low.", "The level. it fell."]),
        (spaceless, ["See the mech.,and so on.", "See the mech. Quillor part."]),
        ("A qual. Brinnow test follows.", ["A qual.", "Brinnow test follows."]),
    ]
    for x, want in cases[:2] + cases[3:]:
        assert [x[a:b] for a, b in Segmenter().sentences(x)] == want
    got = defaultdict(list)
    for r in split_sentences(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "doc_id long, text string"), "doc_id", "text").orderBy("doc_id", "start_pos").collect():
        got[r.doc_id].append(cases[r.doc_id][0][r.start_pos : r.end_pos])
    assert [got[i] for i in (0, 1, 3, 4)] == [cases[i][1] for i in (0, 1, 3, 4)]
    assert "It has a level." in got[2]
    # the document overrules the corpus: an abbreviation elsewhere is a plain word here, and an ordinary word an abbreviation
    own = "Its narr is wide. It is a narr. Brinnow came."
    assert [own[a:b] for a, b in Segmenter(frozenset(["narr"])).sentences(own)] == ["Its narr is wide.", "It is a narr.", "Brinnow came."]
    often = "The stat. is on. The stat. runs. The stat. goes. The stat. Brinnow stands."
    assert len(Segmenter(frozenset(), frozenset(["stat"])).sentences(often)) == 4
    once = "The unit. pH falls. The unit. mithin it falls. The unit. Brinnow came."
    assert len(Segmenter(frozenset(), frozenset(["unit"])).sentences(once)) == 6


def test_sentences_cover_all_but_white_space():
    rnd = random.Random(5)
    own = Segmenter()
    for _ in range(400):
        text = "".join(rnd.choice(['. ', "! ", "? ", "\n", "\n\n", " ", "abc", "Def", "3", "(", ")", '"', "“", "”", "。", "ก", "「", "」", "'", "e.g.", "No. ", "\r"]) for _ in range(rnd.randint(0, 60)))
        spans = own.sentences(text)
        assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        left = text
        for a, b in reversed(spans):
            left = left[:a] + left[b:]
        assert not left.strip()


def test_a_very_long_text():
    text = "The valve opens. " * 100_000
    assert len(Segmenter().sentences(text)) == 100_000


def test_nothing_outside_imports_this_subpackage():
    import pathlib

    root = pathlib.Path(queries.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "clonelake.llm" in p.read_text()]
    assert sys.modules["clonelake.llm"]
