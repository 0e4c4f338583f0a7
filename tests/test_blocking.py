import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import blocking as B
from kindred.operators import components, features, model


def test_key_caps_and_order(spark):
    s1 = spark.createDataFrame([("s", "acme shop", "1 road 12345")], "entity_id string, name string, address string")
    t = spark.createDataFrame([(f"t{i:02d}", "acme shop" if i < 20 else "acme shop two", "x 12345") for i in range(40)], "entity_id string, name string, address string")
    n, a = F.col("name"), F.col("address")
    with_keys = lambda x: x.withColumns({"k1": B.name_key(n), "k2": B.two_token_key(n), "k3": B.number_key(n, a)})
    got = B.multi_key(with_keys(s1), with_keys(t), [("k1", 15), ("k2", 10), ("k3", 5)], 25)
    assert {r.candidate_id: r.route for r in got.collect()} == {f"t{i:02d}": 1 for i in range(15)}
    assert B.multi_key(with_keys(s1), with_keys(t), [("k1", 3), ("k2", 10)], 8).count() == 8
    assert with_keys(spark.createDataFrame([("a", "x", "")], "entity_id string, name string, address string")).where("k1 is null and k2 is null and k3 is null").count() == 1


def test_dense_is_brute_force(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(200, 8))
    v[50:60] = v[0]  # ties
    df = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)], "id long, group long, vector array<double>").repartition(5)
    got = {}
    for x in B.dense_top_k(df.where("id % 20 = 0"), df, 7, block=4).collect():
        got.setdefault(x.s1_id, []).append((-x.sim, x.candidate_id))
    for q in range(0, 200, 20):
        want = sorted((-round(float(v[q] @ v[j]), 9), j) for j in range(200) if j != q and j % 3 == q % 3)[:7]
        assert sorted((round(s, 9), j) for s, j in got[q]) == [(pytest.approx(s), j) for s, j in want]


def test_cells_reach_recall(spark):
    r = np.random.default_rng(5)
    v = np.concatenate([r.normal(size=(60, 6)) + 6 * c for c in range(4)])
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, -1, x.tolist()) for i, x in enumerate(v)], "id long, group long, vector array<double>")
    q = df.where("id % 50 = 0")
    key = lambda d: {(x.s1_id, x.candidate_id) for x in d.collect()}
    exact, near = key(B.dense_top_k(q, df, 5)), key(B.cell_top_k(q, df, 5, 6, 4))
    assert len(exact & near) >= 0.9 * len(exact)


def test_word_grams(spark):
    got = spark.createDataFrame([("a bcd",), ("",), (None,)], "t string").select(B.word_grams(F.coalesce("t", F.lit(""))).alias("g")).collect()
    assert sorted(got[0].g) == sorted([" a ", " bc", "bcd", "cd ", " bcd", "bcd "]) and got[1].g == got[2].g == []


def test_tfidf_unit_and_product(spark):
    df = spark.createDataFrame([(1, "abc abc"), (2, "abc"), (3, "xyz")], "entity_id long, t string")
    w = B.tfidf(df, "t").withColumn("group", F.lit(0))
    assert all(x.n == pytest.approx(1) for x in w.groupBy("entity_id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect())
    got = B.sparse_top_k(w.where("entity_id = 1"), w.where("entity_id > 1"), 5).collect()
    assert [(r.candidate_id, round(r.sim, 9)) for r in got] == [(2, 1.0)]


def test_search_of_copies(spark, monkeypatch):
    """Copies share one search: the lists are those of a search over all pairs, and no step makes rows by the pairs of copies."""
    r = np.random.default_rng(4)
    words = ["".join(r.choice(list("abcde"), 4)) for _ in range(12)]
    texts = [" ".join(r.choice(words, 3)) for _ in range(30)]
    rows = [(i, texts[min(int(r.exponential(6)), 29)]) for i in range(300)] + [(300, ""), (301, None), (302, "  "), (7, "again"), (None, "abcd")]
    df = spark.createDataFrame(rows, "entity_id long, t string").repartition(3)
    calls = []
    monkeypatch.setattr(B, "vector_top_k", lambda q, t, *a, f=B.vector_top_k, **b: (calls.append((q.count(), t.count())), f(q, t, *a, **b, block=4))[1])
    got = {}
    for x in B.text_top_k(df, F.col("entity_id") % 50 == 0, 8).collect():
        got.setdefault(x.s1_id, []).append((x.candidate_id, x.sim))
    assert max(max(c) for c in calls) <= 33
    grams = {}
    for i, t in rows:
        for w in (t or "").split():
            w = f" {w} "
            grams.setdefault(i, []).extend(w[j : j + n] for n in (3, 4) for j in range(len(w) - n + 1))
    df_of = {g: sum(g in x for x in grams.values()) for x in grams.values() for g in x}
    vectors = {}
    for i, x in grams.items():
        v = {g: (1 + np.log(x.count(g))) * (np.log((1 + len(rows)) / (1 + df_of[g])) + 1) for g in x}
        norm = np.sqrt(sum(c * c for c in v.values()))
        vectors[i] = {g: c / norm for g, c in v.items()}
    assert set(got) == {i for i in range(0, 300, 50)}
    for i, found in got.items():
        sims = {j: round(sum(c * v.get(g, 0) for g, c in vectors[i].items()), 9) for j, v in vectors.items() if j not in (i, None)}
        best = sorted(((-s, j) for j, s in sims.items() if s >= 0.12))[:8]
        assert sorted(found, key=lambda x: (-x[1], x[0])) == [(j, pytest.approx(-s, abs=2e-9)) for s, j in best]


def test_routes(spark):
    s = "s1_id string, candidate_id string, sim double"
    a, b = spark.createDataFrame([("x", "1", 0.5), ("x", "2", 0.4)], s), spark.createDataFrame([("x", "2", 0.9)], s)
    assert {tuple(r) for r in B.dual_route(a, b).collect()} == {("x", "1", 0.5, 0.0, 1, 0), ("x", "2", 0.4, 0.9, 1, 1)}
    assert {tuple(r) for r in B.merge_routes({"n": a, "a": b}).collect()} == {("x", "1", 0.5, 0.0), ("x", "2", 0.4, 0.9)}


def test_components(spark):
    r = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)] + [(5, 5), (7, None)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_folds(spark):
    truth = spark.createDataFrame([(f"s{i}", ["x"] * (i % 8)) for i in range(400)], "s1_id string, matches array<string>")
    n = model.stratified_folds(truth, 5).groupBy("stratum", "fold").count().collect()
    for s in {r.stratum for r in n}:
        sizes = [r["count"] for r in n if r.stratum == s]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_context(spark):
    df = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.9), ("a", "z", 0.1), ("b", "x", 0.95)], "s1_id string, candidate_id string, s double")
    c = {(r.s1_id, r.candidate_id): r for r in features.context(df, "s").collect()}
    assert (c["a", "y"].cand_rank, c["a", "z"].cand_rank, c["a", "z"].n_candidates, round(c["a", "z"].gap_to_top, 6)) == (1, 3, 3, 0.8)
    m = {(r.s1_id, r.candidate_id): r for r in features.mutual(df, "s").collect()}
    assert (m["a", "x"].rank_in_cand, m["a", "y"].rank_in_cand, m["a", "x"].reverse_rank, m["a", "x"].mutual_top1, m["b", "x"].mutual_top1) == (1, 2, 2, 0, 1)


def test_learning_helpers(spark):
    lv = spark.createDataFrame([(1, 1, 1)] * 30 + [(1, 0, 0)] * 20 + [(0, 0, 0)] * 50, "name int, addr int, label int")
    w = {(r.field, r.level): r.weight for r in model.linkage_weights(lv, ["name", "addr"]).collect()}
    assert w["addr", "1"] > w["name", "1"] > 0 > w["name", "0"]
    share, mu = model.linkage_em(lv, ["name", "addr"])
    assert 0.1 < share < 0.9 and mu["addr"][0] > mu["addr"][1]
    ab = features.learned_abbreviations(spark.createDataFrame([("12 main rd", "12 main road"), ("5 rd", "5 road")], "a1 string, a2 string")).collect()
    assert [(r.short, r.long, r.n) for r in ab] == [("rd", "road", 2)]
