"""Stages as files: score names, shards, restarts, splits; and the coarse-to-fine search against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import decide, model
from kindred.sources import tables


@pytest.mark.parametrize("name", tables.SCORE_NAMES)
def test_score_names(spark, tmp_path, name):
    spark.createDataFrame([("a", "x", 0.5), ("b", "y", None)], f"s1_id string, candidate_id string, {name} float").write.parquet(str(tmp_path / "p"))
    got = tables.read_scored(spark, str(tmp_path / "p"))
    assert got.dtypes[2] == ("score", "double") and sorted(got.collect()) == [("a", "x", 0.5), ("b", "y", None)]


def test_score_name_order_and_lack(spark, tmp_path):
    spark.createDataFrame([("a", "x", 0.1, 0.9)], "s1_id string, candidate_id string, preds double, prob double").write.parquet(str(tmp_path / "p"))
    assert tables.read_scored(spark, str(tmp_path / "p")).first().score == 0.9
    spark.createDataFrame([("a", "x")], "s1_id string, candidate_id string").write.parquet(str(tmp_path / "q"))
    with pytest.raises(ValueError):
        tables.read_scored(spark, str(tmp_path / "q"))


def test_stops_and_goes_on(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("S1-"), "id").alias("entity_id"), (F.col("id") * 2).alias("v"))
    at = lambda i: str(tmp_path / f"shard={i}")
    for i in (0, 1):  # then the run is lost
        tables.shard(rows, "entity_id", 4, i).write.parquet(at(i))
    done = tables.assemble([spark.read.parquet(at(i)) for i in (0, 1)])
    left = tables.pending(rows, "entity_id", done)
    assert 0 < left.count() == 200 - done.count()
    for i in (2, 3):
        tables.shard(left, "entity_id", 4, i).write.parquet(at(i))
    parts = [spark.read.parquet(at(i)) for i in range(4)]
    assert sorted(tables.assemble(parts, 200).collect()) == sorted(rows.collect())
    with pytest.raises(ValueError):
        tables.assemble(parts[:3], 200)
    assert tables.pending(rows, "entity_id", rows).count() == 0


def test_splits(spark):
    pairs = spark.range(4000).select(F.concat(F.lit("S1-"), (F.col("id") % 1000).cast("string")).alias("s1_id"), F.col("id").cast("string").alias("candidate_id"), F.when(F.col("id") % 2 == 0, "US").otherwise("IN").alias("country"))
    split = model.entity_split(pairs, 0.75)
    sides = split.groupBy("s1_id").agg(F.count_distinct("is_train").alias("n"), F.bool_or("is_train").alias("t")).collect()
    assert all(r.n == 1 for r in sides) and 700 <= sum(r.t for r in sides) <= 800
    us, india = model.country_split(pairs, "US", "IN")
    assert us.count() == india.count() == 2000 and us.where("country <> 'US'").count() == 0
    rows = pairs.withColumns({"label": (F.col("candidate_id").cast("int") % 40 == 0).cast("int"), "sim_max": (F.col("candidate_id").cast("int") % 100) / 100})
    kept = model.hard_negatives(rows, 0.1)
    assert kept.where("label = 1").count() == 100 and kept.where("sim_max >= 0.5").count() == rows.where("sim_max >= 0.5").count()
    easy, all_easy = (x.where("label = 0 and sim_max < 0.5").count() for x in (kept, rows))
    assert 0.05 * all_easy < easy < 0.15 * all_easy


def _macro(truth, scored, first, rest):
    total = 0.0
    for s, true in truth.items():
        own = sorted(((-x, c) for (e, c), x in scored.items() if e == s))
        said = set()
        if own and -own[0][0] >= first:
            said = {own[0][1]} | {c for x, c in own if -x >= rest}
        hit = len(said & true)
        total += (1.0 if not said else 0.0) if not true else 1.25 * hit / (0.25 * len(true) + len(said)) if hit else 0.0
    return total / len(truth)


@pytest.mark.parametrize("seed", [1, 2])
def test_coarse_to_fine(spark, seed):
    r = random.Random(seed)
    truth = {f"s{i}": {f"c{i}-{j}" for j in range(r.choice((0, 1, 2, 3)))} for i in range(40)}
    scored = {(s, c): r.randrange(450, 1000) / 1000 for s, t in truth.items() for c in t} | {(f"s{i}", f"d{i}-{j}"): r.randrange(0, 800) / 1000 for i in range(40) for j in range(2)}
    best = (500, 500, 0.0)
    for grid in (lambda b: [(t, t) for t in range(300, 960, 20)], lambda b: [(t, t) for t in range(max(100, b - 50), min(990, b + 60), 5)], lambda b: [(b, t) for t in range(100, b, 20)]):
        for a, b in grid(best[0]):
            v = _macro(truth, {k: round(x * 1000) for k, x in scored.items()}, a, b)
            if round(v, 12) > round(best[2], 12):
                best = (a, b, v)
    rows = spark.createDataFrame([(*k, v) for k, v in scored.items()], "s1_id string, candidate_id string, score double")
    found = decide.coarse_to_fine(rows, spark.createDataFrame([(s, sorted(t)) for s, t in truth.items()], "s1_id string, matches array<string>"))
    assert found[:2] == best[:2] and found[2] == pytest.approx(best[2])


def test_coarse_to_fine_empty(spark):
    none = spark.createDataFrame([], "s1_id string, candidate_id string, score double")
    assert decide.coarse_to_fine(none, spark.createDataFrame([], "s1_id string, matches array<string>")) == (500, 500, 0.0)
    assert decide.coarse_to_fine(none, spark.createDataFrame([("a", [])], "s1_id string, matches array<string>")) == (300, 300, 1.0)
