"""Measures. truth: (s1_id, matches array), pred: (s1_id, candidate_id). Every mean is over the truth's entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f05(tp: Column, n_true: Column, n_pred: Column) -> Column:
    """F0.5 of one entity: 1.25 tp / (0.25 true + predicted); 1 if both are empty, else 0 without a hit."""
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when((n_true == 0) | (tp == 0), 0.0).otherwise(1.25 * tp / (0.25 * n_true + n_pred))


def per_entity(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """s1_id, n_true, n_pred, tp, f05. Entities without a prediction have an empty one; predictions of unknown entities don't count."""
    said = pred.groupBy("s1_id").agg(F.collect_set("candidate_id").alias("said"))
    rows = truth.select("s1_id", F.array_distinct("matches").alias("matches")).join(said, "s1_id", "left")
    empty = F.array().cast("array<string>")
    said_ = F.coalesce("said", empty)
    rows = rows.select("s1_id", F.size("matches").alias("n_true"), F.size(said_).alias("n_pred"), F.size(F.array_intersect("matches", said_)).alias("tp"))
    return rows.withColumn("f05", f05(F.col("tp"), F.col("n_true"), F.col("n_pred")))


def macro(entities: DataFrame) -> DataFrame:
    """Macro F0.5 with its parts: singletons (no true match) and others. No entities: 0."""
    single = F.col("n_true") == 0
    part = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("f05"))), F.lit(0.0))
    return entities.agg(
        F.coalesce(F.avg("f05"), F.lit(0.0)).alias("macro_f05"),
        F.count_if(single).alias("singleton_count"),
        part(single).alias("singleton_f05"),
        F.count_if(~single).alias("non_singleton_count"),
        part(~single).alias("non_singleton_f05"),
    )


def by_cardinality(entities: DataFrame) -> DataFrame:
    """Mean F0.5 by number of true matches: 0, 1-2, 3-5, 6-20, over 20."""
    n = F.col("n_true")
    bucket = F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 20, "6-20").otherwise("21+")
    return entities.groupBy(bucket.alias("cardinality")).agg(F.count(F.lit(1)).alias("n_entities"), F.avg("f05").alias("mean_f05"))


def precision_recall(entities: DataFrame) -> DataFrame:
    """Macro precision and recall of entities with true matches, and the share of singletons left empty."""
    some = F.col("n_true") > 0
    precision = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    return entities.agg(
        F.avg(F.when(some, precision)).alias("macro_precision"),
        F.avg(F.when(some, F.col("tp") / F.col("n_true"))).alias("macro_recall"),
        F.avg(F.when(~some, (F.col("n_pred") == 0).cast("double"))).alias("singleton_accuracy"),
    )


def errors(entities: DataFrame) -> DataFrame:
    """Counts of wrong and missed ids and of the entities they touch."""
    fp, fn = F.col("n_pred") - F.col("tp"), F.col("n_true") - F.col("tp")
    return entities.agg(
        F.sum(fp).alias("false_positives"),
        F.sum(fn).alias("false_negatives"),
        F.count_if(fp > 0).alias("entities_with_fp"),
        F.count_if(fn > 0).alias("entities_with_fn"),
        F.count_if((F.col("n_true") == 0) & (F.col("n_pred") > 0)).alias("singleton_fp"),
        F.count_if((F.col("n_true") > 0) & (F.col("n_pred") == 0)).alias("missed"),
    )


def worst(entities: DataFrame, n: int = 10) -> DataFrame:
    """The n entities with the most errors."""
    return entities.orderBy(F.desc(F.col("n_pred") + F.col("n_true") - 2 * F.col("tp")), "s1_id").limit(n)


def blocking(truth: DataFrame, pairs: DataFrame, n_targets: int) -> DataFrame:
    """Pair completeness (1 without true pairs), reduction ratio, and the distribution of candidate counts over the truth's entities."""
    counts = truth.select("s1_id").join(pairs.groupBy("s1_id").agg(F.count_distinct("candidate_id").alias("n")), "s1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    spread = counts.agg(
        F.count(F.lit(1)).alias("n_s1"), F.sum("n").alias("n_candidates"), F.count_if(F.col("n") > 0).alias("s1_with_candidates"), F.avg("n").alias("mean_candidates"),
        F.percentile("n", F.lit(0.5)).alias("median_candidates"), F.percentile("n", F.lit(0.95)).alias("p95_candidates"), F.max("n").alias("max_candidates"),
    )
    true = truth.select("s1_id", F.explode(F.array_distinct("matches")).alias("candidate_id"))
    found = true.join(pairs.select("s1_id", "candidate_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "candidate_id"], "left")
    got = found.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("found_pairs"))
    one = spread.crossJoin(got)  # one row each
    pc = F.when(F.col("true_pairs") == 0, 1.0).otherwise(F.col("found_pairs") / F.col("true_pairs"))
    whole = F.col("n_s1").cast("double") * n_targets
    return one.select("*", pc.alias("pair_completeness"), F.when(whole > 0, 1 - F.col("n_candidates") / whole).otherwise(0.0).alias("reduction_ratio"), (pc >= 0.95).alias("gate_passed"))


def score_histogram(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Pairs in half-open bins of equal width over [0, 1]; 1 falls in the last."""
    b = F.least(F.floor(F.col("score") * bins + 1e-9), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def score_distribution(scored: DataFrame) -> DataFrame:
    """Mean, median, tenth and ninetieth percentile of scores by label."""
    p = lambda q: F.percentile("score", F.lit(q))
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), p(0.5).alias("median"), p(0.1).alias("p10"), p(0.9).alias("p90"))


def log_loss(scored: DataFrame, eps: float = 1e-15) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("score")))
    return scored.agg(F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve by counts per distinct score, ties counted half."""
    from pyspark.sql.window import Window

    per = scored.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    # cumulated in two steps, so that no window holds all scores: within coarse bins, and over the bins
    per = per.withColumn("bin", F.floor(F.col("score") * 1000))
    bins = per.groupBy("bin").agg(F.sum("n").alias("bn")).withColumn("before", F.coalesce(F.sum("bn").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = per.withColumn("inside", inside).join(F.broadcast(bins), "bin")
    return rows.agg((F.sum(F.col("p") * (F.col("before") + F.col("inside") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))
