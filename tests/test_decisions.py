"""Golden cases of metrics, decisions and validation."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import decide, metrics, validate
from kindred.sources import tables

TRUTH = "s1_id string, matches array<string>"
PAIRS = "s1_id string, candidate_id string"
SCORED = f"{PAIRS}, score double"


def entities(spark, truth, pred):
    return metrics.per_entity(spark.createDataFrame(list(truth.items()), TRUTH), spark.createDataFrame([(k, x) for k, v in pred.items() for x in v], PAIRS))


def test_f05_cases(spark):
    truth = {"a": [], "b": [], "c": ["S2-1"], "d": ["S2-1", "S3-2"], "e": ["S2-00047", "S3-00812"], "f": ["1", "2", "3"], "g": ["1", "2", "3", "4", "5"]}
    pred = {"b": ["S2-1"], "d": ["S3-2", "S2-1"], "e": ["S2-00047", "S2-00193", "S3-00812"], "f": ["1", "2", "3", "9"], "g": ["1", "2", "3", "4"]}
    got = {r.s1_id: r.f05 for r in entities(spark, truth, pred).collect()}
    assert (got["a"], got["b"], got["c"], got["d"]) == (1, 0, 0, 1)
    assert got["e"] == pytest.approx(0.714, abs=5e-4) and got["f"] == pytest.approx(0.7895, abs=5e-5) and got["g"] == pytest.approx(0.952, abs=5e-4)


def test_macro(spark):
    e = entities(spark, {"S1-1": [], "S1-2": ["S2-1", "S3-1"], "S1-3": ["S2-2"]}, {"S1-2": ["S2-1", "S3-1"]})
    m = metrics.macro(e).first()
    assert m.macro_f05 == pytest.approx(2 / 3) and (m.singleton_count, m.singleton_f05, m.non_singleton_count) == (1, 1, 2)
    assert metrics.macro(e.limit(0)).first().macro_f05 == 0
    x = metrics.errors(e).first()
    assert (x.false_positives, x.false_negatives, x.missed) == (0, 1, 1)


def test_blocking_metrics(spark):
    truth = spark.createDataFrame([("S1-1", ["S2-1", "S2-2"]), ("S1-2", ["S3-1"]), ("S1-3", [])], TRUTH)
    m = metrics.blocking(truth, spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-99"), ("S1-2", "S3-1")], PAIRS), 100).first()
    assert m.pair_completeness == pytest.approx(2 / 3) and m.reduction_ratio == pytest.approx(0.99) and not m.gate_passed
    assert (m.mean_candidates, m.median_candidates, m.max_candidates, m.s1_with_candidates) == (1, 1, 2, 2)


def scenario(spark):
    base = {0: ["t1", "t2"], 1: ["t3"], 3: ["t4", "t5"], 5: ["t2", "t6"], 6: ["t7"], 7: ["t8", "t9"], 9: ["t10"]}
    rows = [(f"s1_{k}", t, 0.95) for k, v in base.items() for t in v]
    more = [("s1_0", "t99", 0.91, 0.89), ("s1_2", "t100", 0.95, 0.92), ("s1_3", "t5", 0.88, 0.80), ("s1_3", "t101", 0.86, 0.85)]
    return spark.createDataFrame(rows, SCORED), spark.createDataFrame(more, f"{PAIRS}, sim_name double, sim_addr double")


def test_exclusivity_and_expansion(spark):
    scored, more = scenario(spark)
    own = decide.exclusive(scored)
    got = {(r.s1_id, r.candidate_id) for r in own.collect()}
    assert ("s1_0", "t2") in got and ("s1_5", "t2") not in got and len(got) == len({c for _, c in got}) == 10
    strict = {(r.s1_id, r.candidate_id) for r in decide.expand(own, more).collect()} - got
    loose = {(r.s1_id, r.candidate_id) for r in decide.expand(own, more, loose=(0.82, 0.85, 0.55)).collect()} - got
    assert strict == {("s1_0", "t99")} and loose == {("s1_0", "t99"), ("s1_3", "t101")}
    assert {r.candidate_id for r in decide.exclusive(scored, 0.01).collect()} == {c for _, c in got} - {"t2"}


def test_thresholds(spark):
    rows = [("a", "x", 0.6), ("a", "y", 0.575), ("a", "z", 0.5749), ("b", "x", 0.5999), ("c", "p", 0.9), ("c", "q", 0.6), ("c", "r", 0.6), ("c", "s", 0.6), ("c", "t", 0.6)]
    df = spark.createDataFrame(rows, SCORED)
    pick = lambda d: sorted((r.s1_id, r.candidate_id) for r in d.collect())
    assert pick(decide.two_thresholds(df)) == [("a", "x"), ("a", "y"), *(("c", x) for x in "pqrst")]
    assert pick(decide.two_thresholds(df, runners_up=3)) == [("a", "x"), ("a", "y"), *(("c", x) for x in "pqrs")]
    assert pick(decide.two_thresholds(df, 0.58, 0.42, margin=0.7)) == [("a", "x"), ("a", "y"), ("a", "z"), ("b", "x"), ("c", "p")]
    assert pick(decide.clear_winners(df, 0.2)) == [("b", "x"), *(("c", x) for x in "pqrst")]


def test_grid_is_the_plain_loop(spark):
    r = random.Random(4)
    truth = {f"s{i}": [f"s{i}c{j}" for j in range(r.choice([0, 1, 2]))] for i in range(30)}
    scored = [(s, f"{s}c{j}", round(r.random(), 3)) for s in truth for j in range(r.choice([0, 1, 3]))]
    grid = decide.grid(range(300, 900, 100), range(100, 900, 100))
    got = {(x.t_first, x.t_rest): x.macro_f05 for x in decide.grid_search(spark.createDataFrame(scored, SCORED), spark.createDataFrame(list(truth.items()), TRUTH), grid).collect()}
    for a, b in grid:
        total = 0
        for s, true in truth.items():
            own = sorted(((-p, c) for x, c, p in scored if x == s))
            said = {c for i, (p, c) in enumerate(own) if -own[0][0] * 1000 >= a - 1e-6 and (i == 0 or -p * 1000 >= b - 1e-6)}
            tp = len(said & set(true))
            total += (not said) if not true else 1.25 * tp / (0.25 * len(true) + len(said)) if tp else 0
        assert got[a, b] == pytest.approx(total / len(truth))
    assert len(decide.grid()) == len([1 for a, b in itertools.product(range(500, 951, 25), range(400, 901, 25)) if b <= a])


def test_conflicts_and_band(spark):
    df = spark.createDataFrame([("a", "x", 0.9, "1", ""), ("a", "y", 0.75, "2", ""), ("a", "z", 0.76, "2", ""), ("a", "w", 0.5, "", "")], f"{SCORED}, house string, state string")
    assert {r.candidate_id: r.conflict_dropped for r in decide.conflict_rule(df).collect()} == {"x": 0, "y": 1, "z": 0, "w": 0}
    assert decide.band_audit(df).first().n_band == 2
    out = {r.candidate_id: r.score for r in decide.rerank(df, F.lit(1.0)).collect()}
    assert out["y"] == 0.875 and out["x"] == 0.9
    assert decide.cluster_precheck(df, 0.5).first().skip_clustering


def test_result_files(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-2", 0), ("S1-1", 1), ("S1-3", 2)], "entity_id string, row_idx int")
    pairs = spark.createDataFrame([("S1-1", "S3-1", 0.7), ("S1-1", "S2-1", 0.9), ("S1-3", 'S2-"q', 0.8)], SCORED)
    path = str(tmp_path / "out")
    tables.write_lists(s1, pairs, path, "matched_entity_ids", order="score")
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == 'source1_entity_id\tmatched_entity_ids\nS1-2\t\nS1-1\tS2-1,S3-1\nS1-3\tS2-"q\n'
    assert {(r.s1_id, r.candidate_id, r.score) for r in tables.read_results(spark, path).collect()} == {("S1-1", "S2-1", 0.95), ("S1-1", "S3-1", 0.95), ("S1-3", 'S2-"q', 0.95)}
    truth = {r.s1_id: r.matches for r in tables.read_truth(spark, path).collect()}
    assert truth == {"S1-2": [], "S1-1": ["S2-1", "S3-1"], "S1-3": ['S2-"q']}
    ids = s1.select(F.col("entity_id").alias("s1_id"))
    assert validate.passed(validate.check_file(spark, path, ("source1_entity_id", "matched_entity_ids"), ids))


@pytest.mark.parametrize(
    ("text", "check"),
    [
        ("source1_entity_id,matched_entity_ids\nS1-1\t\n", "commas, not tabs"),
        ("a\tb\nS1-1\t\n", "wrong header"),
        ("", "empty file"),
        ("{h}\nS1-1\n", "row without tab"),
        ("{h}\nS1-1\t\nS1-1\t\n", "duplicate row"),
        ("{h}\nS1-1\tS2-1,S2-1\n", "duplicate id"),
        ("{h}\nS1-1\tS1-2\n", "self match"),
        ("{h}\nS1-1\tX-2\n", "foreign prefix"),
        ("{h}\nS1-1\tS2-9\n", "unknown id"),
        ("{h}\n", "missing entity"),
        ("{h}\nS1-1\t\nS1-8\t\n", "extra entity"),
    ],
)
def test_file_problems(spark, tmp_path, text, check):
    (tmp_path / "x.tsv").write_text(text.format(h="source1_entity_id\tmatched_entity_ids"))
    got = validate.check_file(spark, str(tmp_path / "x.tsv"), ("source1_entity_id", "matched_entity_ids"), spark.createDataFrame([("S1-1",)], "s1_id string"), spark.createDataFrame([("S2-1",)], "entity_id string"))
    assert check in {r.check for r in got.where("n > 0").collect()} and not validate.passed(got)


def test_not_candidates(spark):
    s = "s1_id string, ids array<string>"
    got = validate.not_candidates(spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], s), spark.createDataFrame([("a", ["x"]), ("b", ["z"])], s)).collect()
    assert [(r.s1_id, r.extra) for r in got] == [("a", ["y"])]
