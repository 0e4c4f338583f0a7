"""Folds, boosted trees, calibration and linkage weights with Spark ML and SQL."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.operators import metrics
from kindred.sources.storage import materialize


def stratified_folds(truth: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """s1_id, stratum (0, 1-2, 3-5, 6+ matches) and fold, of almost equal size within each stratum.

    Places in a stratum come from hash buckets' counts and row numbers inside a bucket, so a stratum is never in one task.
    """
    n = F.size("matches")
    rows = truth.select("s1_id", F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 5, "3-5").otherwise("6+").alias("stratum"))
    rows = rows.withColumn("h", F.md5(F.concat_ws("|", "s1_id", F.lit(seed)))).withColumn("bucket", F.substring("h", 1, 2))
    counts = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("h", "s1_id"))
    placed = rows.withColumn("inside", inside).join(counts.withColumn("before", before), ["stratum", "bucket"])
    return placed.select("s1_id", "stratum", F.pmod(F.col("before") + F.col("inside") - 1, F.lit(k)).cast("int").alias("fold"))


def group_folds(rows: DataFrame, key: str = "s1_id", k: int = 3, seed: int = 42) -> DataFrame:
    """Adds fold by the key's hash: all pairs of an entity in one fold."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k)).cast("int"))


def entity_split(rows: DataFrame, share: float = 0.75, key: str = "s1_id", seed: int = 42) -> DataFrame:
    """Adds is_train for about ``share`` of the entities."""
    return rows.withColumn("is_train", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(share * 10_000))


def country_split(rows: DataFrame, train: str, test: str, column: str = "country") -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col(column) == train), rows.where(F.col(column) == test)


def hard_negatives(pairs: DataFrame, keep: float, hard: float = 0.5, sim: str = "sim_max", seed: int = 42) -> DataFrame:
    """All positives, all negatives at least ``hard`` similar, and a share of the easy ones."""
    easy = F.pmod(F.xxhash64("s1_id", "candidate_id", F.lit(seed)), F.lit(10_000)) < int(keep * 10_000)
    return pairs.where((F.col("label") == 1) | (F.col(sim) >= hard) | easy)


def _assembled(pairs: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(pairs.withColumns({f: F.col(f).cast("double") for f in features}))


def fit(pairs: DataFrame, features: list[str], trees: int = 40, rate: float = 0.1, depth: int = 5, balance: bool = True, validation: str | None = None, learner: str = "boosted"):
    """Boosted trees, or with learner "forest" a random forest. balance: classes weigh the same in sum. validation: a boolean column of rows that stop boosting early."""
    rows = pairs
    if balance:
        n = pairs.agg(F.avg(F.col("label").cast("double")).alias("p")).first().p or 0.0
        p = min(max(n, 1e-6), 1 - 1e-6)
        rows = pairs.withColumn("weight", F.when(F.col("label") == 1, 0.5 / p).otherwise(0.5 / (1 - p)))
    else:
        rows = pairs.withColumn("weight", F.lit(1.0))
    if learner == "forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=127, subsamplingRate=0.8, seed=42, weightCol="weight", labelCol="label", featuresCol="features", minInstancesPerNode=5).fit(_assembled(rows, features))
    gbt = GBTClassifier(maxIter=trees, stepSize=rate, maxDepth=depth, maxBins=127, subsamplingRate=0.8, seed=42, weightCol="weight", labelCol="label", featuresCol="features", minInstancesPerNode=5)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return gbt.fit(_assembled(rows, features))


def predict(model, pairs: DataFrame, features: list[str]) -> DataFrame:
    """Adds score, the probability of a match."""
    return model.transform(_assembled(pairs, features)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def predict_mean(models: list, pairs: DataFrame, features: list[str]) -> DataFrame:
    """Adds score, the mean over the models of several folds."""
    rows = _assembled(pairs, features)
    for i, m in enumerate(models):
        rows = m.transform(rows).withColumn(f"__p{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    mean = sum((F.col(f"__p{i}") for i in range(1, len(models))), F.col("__p0")) / len(models)
    return rows.withColumn("score", mean).drop("features", *(f"__p{i}" for i in range(len(models))))


def out_of_fold(pairs: DataFrame, features: list[str], k: int = 2, **options) -> tuple[DataFrame, list]:
    """Pairs (with fold, label) with the score of the model that hasn't seen their fold, and the models."""
    pairs = materialize(pairs)
    models, out = [], None
    for i in range(k):
        models.append(fit(pairs.where(F.col("fold") != i), features, **options))
        own = predict(models[-1], pairs.where(F.col("fold") == i), features)
        out = own if out is None else out.unionByName(own)
    return out, models


def compare(pairs: DataFrame, features: list[str], settings: dict[str, dict], k: int = 2) -> DataFrame:
    """(setting, auc, log_loss) out of fold for each of several settings of ``fit``. pairs: with fold and label."""
    out = None
    for name, options in settings.items():
        scored = materialize(out_of_fold(pairs, features, k, **options)[0].select("score", "label"))
        row = metrics.auc(scored).crossJoin(metrics.log_loss(scored)).select(F.lit(name).alias("setting"), "auc", "log_loss")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def importances(models: list, features: list[str]) -> list[tuple[str, float]]:
    """Mean importance over the folds, largest first."""
    n = len(models)
    return sorted(((f, sum(float(m.featureImportances[i]) for m in models) / n) for i, f in enumerate(features)), key=lambda x: (-x[1], x[0]))


def calibrate(scored: DataFrame, score: str = "score"):
    """Isotonic regression of label on score; beyond the seen scores it stays level."""
    rows = scored.select(F.col("label").cast("double").alias("label"), F.col(score).cast("double").alias("x"))
    # pooled by score first, so equal scores share one value and few rows remain
    rows = rows.groupBy("x").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="x", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(rows)


def temperature(scored: DataFrame, steps: int = 60) -> float:
    """The T that minimises log loss of sigmoid(logit(score) / T), among values from 0.1 to 10 in even ratios; one pass."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("score")))
    logit = F.log(p / (1 - p))
    values = [10 ** (2 * i / steps - 1) for i in range(steps + 1)]
    loss = lambda t: F.avg(F.log1p(F.exp(-F.when(F.col("label") == 1, logit).otherwise(-logit) / t)))
    row = scored.agg(*(loss(t).alias(f"t{i}") for i, t in enumerate(values))).first()
    return min(zip(row, values, strict=True))[1]


def linkage_weights(levels: DataFrame, fields: list[str]) -> DataFrame:
    """(field, level, m, u, weight): log2(m / u) of agreement levels among matches and others. levels: the fields and label. Counts are smoothed by one half."""
    long = levels.select("label", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("level")) for f in fields))))
    n = long.groupBy("field", "level").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    by = Window.partitionBy("field")
    m = (F.col("a") + 0.5) / (F.sum("a").over(by) + 0.5 * F.count(F.lit(1)).over(by))
    u = (F.col("b") + 0.5) / (F.sum("b").over(by) + 0.5 * F.count(F.lit(1)).over(by))
    return n.withColumns({"m": m, "u": u}).select("field", "level", "m", "u", F.log2(F.col("m") / F.col("u")).alias("weight"))


def linkage_em(patterns: DataFrame, fields: list[str], rounds: int = 20, prior: float = 0.1) -> tuple[float, dict[str, tuple[float, float]]]:
    """(share of matches, {field: (m, u)}) of 0/1 agreement fields without labels, by expectation-maximisation.

    Pairs are counted by pattern first, at most 2 ** fields rows, so the rounds run over these counts.
    """
    rows = [(r.n, [r[f] for f in fields]) for r in patterns.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).collect()]
    share, mu = prior, {f: (0.9, 0.1) for f in fields}
    total = sum(n for n, _ in rows)
    for _ in range(rounds):
        weights = []
        for n, gamma in rows:
            a, b = share, 1 - share
            for f, g in zip(fields, gamma, strict=True):
                m, u = mu[f]
                a *= m if g else 1 - m
                b *= u if g else 1 - u
            weights.append(n * a / (a + b))
        matched = sum(weights)
        share = min(max(matched / total, 1e-6), 1 - 1e-6)
        clip = lambda v: min(max(v, 1e-6), 1 - 1e-6)
        for i, f in enumerate(fields):
            m = sum(w for w, (_, g) in zip(weights, rows, strict=True) if g[i]) / max(matched, 1e-12)
            u = sum(n - w for w, (n, g) in zip(weights, rows, strict=True) if g[i]) / max(total - matched, 1e-12)
            mu[f] = (clip(m), clip(u))
    return share, mu
