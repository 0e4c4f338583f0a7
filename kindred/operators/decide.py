"""From scores to matches: conflict rules, exclusivity, thresholds and their search. Scored pairs are (s1_id, candidate_id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.functions.similarity import sigmoid, three_state
from kindred.sources.storage import materialize

FIRST, REST = 0.600, 0.575


def ranked(scored: DataFrame) -> DataFrame:
    """With the rank among the entity's candidates and its best score."""
    by = Window.partitionBy("s1_id")
    return scored.withColumns({"rn": F.row_number().over(by.orderBy(F.desc("score"), "candidate_id")), "top": F.max("score").over(by)})


def two_thresholds(scored: DataFrame, first: float = FIRST, rest: float = REST, margin: float | None = None, runners_up: int | None = None) -> DataFrame:
    """The best candidate if it reaches ``first``, with it all others that reach ``rest`` (and ``margin`` times the best; ``runners_up`` of them at most)."""
    good = F.col("score") >= rest
    if margin is not None:
        good &= F.col("score") >= margin * F.col("top")
    rows = ranked(scored).where((F.col("top") >= first) & ((F.col("rn") == 1) | good))
    if runners_up is not None:
        rows = rows.where(F.col("rn") <= 1 + runners_up)
    return rows.select("s1_id", "candidate_id", "score")


def single_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where(F.col("score") >= threshold)


def clear_winners(scored: DataFrame, margin: float) -> DataFrame:
    """Candidates of entities whose best beats the runner-up by ``margin`` at least; a lone candidate does."""
    by = Window.partitionBy("s1_id").orderBy(F.desc("score"), "candidate_id")
    rows = ranked(scored).withColumn("next", F.lead("score").over(by))
    lead = F.first(F.when(F.col("rn") == 1, F.col("score") - F.coalesce("next", F.lit(-1.0))), ignorenulls=True).over(Window.partitionBy("s1_id"))
    return rows.withColumn("lead", lead).where(F.col("lead") >= margin).select("s1_id", "candidate_id", "score")


def exclusive(scored: DataFrame, min_gap: float | None = None) -> DataFrame:
    """Each candidate with the entity that scores it highest, the smaller s1_id of equals; with ``min_gap``, dropped if the next claim is as close as that."""
    by = Window.partitionBy("candidate_id").orderBy(F.desc("score"), "s1_id")
    rows = scored.withColumns({"claim": F.row_number().over(by), "next": F.lead("score").over(by)}).where("claim = 1")
    if min_gap is not None:
        rows = rows.where(F.col("next").isNull() | (F.col("score") - F.col("next") >= min_gap))
    return rows.drop("claim", "next")


def expand(matches: DataFrame, candidates: DataFrame, name: float = 0.88, address: float = 0.80, loose: tuple[float, float, float] | None = None) -> DataFrame:
    """Further candidates (s1_id, candidate_id, sim_name, sim_addr) of entities that have a match already.

    Strict: both similarities reach their thresholds. loose (n, a, m): the name reaches n, or the address a with the name m.
    """
    sn, sa = F.col("sim_name"), F.col("sim_addr")
    good = (sn >= name) & (sa >= address) if loose is None else (sn >= loose[0]) | ((sa >= loose[1]) & (sn >= loose[2]))
    more = candidates.where(good).join(matches.select("s1_id").distinct(), "s1_id", "left_semi")
    more = more.join(matches.select("s1_id", "candidate_id"), ["s1_id", "candidate_id"], "left_anti")
    return matches.select("s1_id", "candidate_id", "score").unionByName(more.select("s1_id", "candidate_id", sn.cast("double").alias("score")))


def union_best(pools: list[DataFrame]) -> DataFrame:
    """All pools' pairs, each with its highest score."""
    out = pools[0]
    for p in pools[1:]:
        out = out.unionByName(p)
    return out.groupBy("s1_id", "candidate_id").agg(F.max("score").alias("score"))


def conflict_rule(scored: DataFrame, gap: float = 0.15) -> DataFrame:
    """Adds conflict_dropped: a candidate that isn't the entity's best, differs from it in a known house number or state, and scores ``gap`` less at least.

    scored: with house and state of the candidate, empty or null if unknown.
    """
    by = Window.partitionBy("s1_id").orderBy(F.desc("score"), "candidate_id")
    best = F.first(F.struct("candidate_id", "score", "house", "state")).over(by)
    rows = scored.withColumn("__best", best)
    differs = (three_state(F.col("house"), F.col("__best.house")) == -1) | (three_state(F.col("state"), F.col("__best.state")) == -1)
    # a decimal comparison: 0.9 - 0.75 is under 0.15 in binary
    far = F.round(F.col("__best.score") - F.col("score"), 9) >= gap
    drop = (F.col("candidate_id") != F.col("__best.candidate_id")) & differs & far
    return rows.withColumn("conflict_dropped", drop.cast("int")).drop("__best")


def in_band(score: Column, centre: float, margin: float) -> Column:
    return score.between(round(max(0.0, centre - margin), 9), round(min(1.0, centre + margin), 9))


def band_audit(scored: DataFrame, centre: float = 0.75, margin: float = 0.10, pairs_per_second: float = 1500, hours: float = 3) -> DataFrame:
    """Size of the ambiguous band, its share, the hours a pair scorer would take, and whether that is feasible."""
    n = F.sum(in_band(F.col("score"), centre, margin).cast("long"))
    return scored.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.coalesce(n, F.lit(0)).alias("n_band"),
        F.round(100 * n / F.count(F.lit(1)), 6).alias("pct_band"),
        F.round(n / pairs_per_second / 3600, 9).alias("est_hours"),
        (n / pairs_per_second / 3600 <= hours).alias("feasible"),
    )


def rerank(scored: DataFrame, pair_score: Column, centre: float = 0.75, margin: float = 0.10, logits: bool = False) -> DataFrame:
    """In the band the mean of score and ``pair_score`` (a probability, or a logit); reranked_by_D says where."""
    p = sigmoid(pair_score) if logits else pair_score
    band = in_band(F.col("score"), centre, margin)
    return scored.withColumns({"reranked_by_D": band.cast("int"), "score": F.when(band, 0.5 * F.col("score") + 0.5 * p).otherwise(F.col("score"))})


def cluster_precheck(scored: DataFrame, threshold: float, enough: float = 0.97) -> DataFrame:
    """Share of entities whose predicted candidates are all owned by them (owner: the best-scoring entity); clustering can be skipped at ``enough``."""
    owner = exclusive(scored).select("candidate_id", F.col("s1_id").alias("owner"))
    said = scored.where(F.col("score") >= threshold).join(owner, "candidate_id")
    each = said.groupBy("s1_id").agg(F.bool_and(F.col("owner") == F.col("s1_id")).alias("agrees"))
    share = F.avg(F.col("agrees").cast("double"))
    return each.agg(F.count(F.lit(1)).alias("n_entities"), F.round(share, 9).alias("agreement"), (share >= enough).alias("skip_clustering"))


def ensemble(tables: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """Weighted mean of the scores of several methods; a pair that a method lacks counts as 0 there."""
    weights = weights or [1.0] * len(tables)
    out = None
    for t, w in zip(tables, weights, strict=True):
        own = t.select("s1_id", "candidate_id", (F.col("score") * w).alias("score"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("s1_id", "candidate_id").agg((F.sum("score") / sum(weights)).alias("score"))


def grid(first: range = range(500, 951, 25), rest: range = range(400, 901, 25)) -> list[tuple[int, int]]:
    """Threshold pairs in thousandths with rest <= first, in order."""
    return [(a, b) for a in first for b in rest if b <= a]


def grid_search(scored: DataFrame, truth: DataFrame, pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    """(t_first, t_rest, macro_f05) of every pair of thresholds, in thousandths.

    One pass: an entity's outcome depends on where its scores stand among the thresholds, so entities are first summed by the steps in
    which their best score and counts change, and only those sums meet the grid. truth: s1_id, matches.
    """
    pairs = pairs or grid()
    spark = scored.sparkSession
    rests = sorted({b for _, b in pairs})
    milli = F.floor(F.col("score") * 1000 + 1e-9)
    long = truth.select("s1_id", F.explode("matches").alias("candidate_id")).withColumn("hit", F.lit(1))
    marked = ranked(scored).join(long, ["s1_id", "candidate_id"], "left")
    hit = F.coalesce("hit", F.lit(0))
    counts = [F.sum(((F.col("rn") == 1) | (milli >= t)).cast("int")).alias(f"n{t}") for t in rests]
    hits = [F.sum(F.when((F.col("rn") == 1) | (milli >= t), hit).otherwise(0)).alias(f"h{t}") for t in rests]
    each = marked.groupBy("s1_id").agg(F.max(milli).alias("best"), *counts, *hits)
    all_ = truth.select("s1_id", F.size("matches").alias("nt")).join(each, "s1_id", "left")
    per = F.explode(F.array(*(F.struct(F.lit(t).alias("t_rest"), F.coalesce(F.col(f"n{t}"), F.lit(0)).alias("np"), F.coalesce(F.col(f"h{t}"), F.lit(0)).alias("tp")) for t in rests)))
    rows = all_.select("nt", F.coalesce("best", F.lit(-1)).alias("best"), per.alias("x")).select("nt", "best", "x.*")
    firsts = sorted({a for a, _ in pairs})
    # the last threshold that the best score reaches; entities with the same one behave alike
    step = F.size(F.filter(F.lit(firsts), lambda t: t <= F.col("best")))
    f = F.when(F.col("nt") == 0, 0.0).when(F.col("tp") == 0, 0.0).otherwise(1.25 * F.col("tp") / (0.25 * F.col("nt") + F.col("np")))
    empty = (F.col("nt") == 0).cast("double")
    sums = rows.withColumn("step", step).groupBy("t_rest", "step").agg(F.sum(f).alias("f"), F.sum(empty).alias("e"), F.count(F.lit(1)).alias("n"))
    places = spark.createDataFrame([(a, b, firsts.index(a) + 1) for a, b in pairs], "t_first int, t_rest int, at int")
    met = F.broadcast(places).join(sums, "t_rest")  # the grid's rows only
    value = F.when(F.col("step") >= F.col("at"), F.col("f")).otherwise(F.col("e"))
    return met.groupBy("t_first", "t_rest").agg((F.sum(value) / F.sum("n")).alias("macro_f05"))


def best_thresholds(searched: DataFrame) -> DataFrame:
    """The best pair; of equals the first in the grid's order."""
    return searched.agg(F.max_by(F.struct("t_first", "t_rest", "macro_f05"), F.struct(F.round("macro_f05", 12), -F.col("t_first"), -F.col("t_rest"))).alias("x")).select("x.*")


def coarse_to_fine(scored: DataFrame, truth: DataFrame) -> tuple[int, int, float]:
    """(t_first, t_rest, macro F0.5), thresholds in thousandths: one threshold in steps of 20, then of 5 around the best, then smaller ones for the rest.

    Three searches over all entities, each of one pass; a later value replaces an earlier one only if it is better. Without entities: 500, 500, 0.
    """
    scored = materialize(scored)

    def better(pairs: list[tuple[int, int]], now: tuple[int, int, float]) -> tuple[int, int, float]:
        found = best_thresholds(grid_search(scored, truth, pairs)).first() if pairs else None
        return tuple(found) if found and round(found.macro_f05 or 0.0, 12) > round(now[2], 12) else now

    best = better([(t, t) for t in range(300, 960, 20)], (500, 500, 0.0))
    best = better([(t, t) for t in range(max(100, best[0] - 50), min(990, best[0] + 60), 5)], best)
    return better([(best[0], t) for t in range(100, best[0], 20)], best)
