"""Quality rules with cutoffs that risk control sets from labelled documents.

Each feature is a number that is higher in worse texts, and has a row of STEPS limits from lenient to strict. Cutoff j rejects a text if any feature
is at or beyond its limit j, so a text's one score is the first cutoff that rejects it, and cutoffs only get stricter. The limits are constants; labels
choose how far along the row a stratum (language) may go. Cutoff j may be used if the chance of seeing as few false rejections as seen among the stratum's
n good labelled texts, were the true rate ``risk``, is at most ``error / strata``: an exact binomial tail, P(Bin(n, risk) <= k), which is
the same as the Clopper-Pearson upper bound being at most risk. Cutoffs are tested in order and the first failure ends the row (fixed-sequence testing),
so no correction is needed within it; between strata Bonferroni's is used. Hence with probability 1 - ``error`` no stratum loses more than ``risk``
of its good texts. With risk 0.02, error 0.1 and four strata that takes 183 good labelled texts without a false rejection. Of the cutoffs allowed, the one with
the largest "bad rejected - ``worth`` * good rejected" is taken, the more lenient of equals; if none is over zero, none is taken.

The bound holds for independent draws, so copies of a text in a stratum count once. All labelled documents count, none are sampled. Strata without enough labels
get no cutoff and lose nothing but what fails the base rules. Null text has no words and fails the base rules. Where a doc_id or a text has several labels it is good
if one says so. Null labels don't count; a null stratum is a stratum of its own. Repeated rows are judged alike, each by its own text. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.texts import BLANKS, lines, text_hash, without, words
from kindred.sources.storage import materialize

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Cutoffs of a row.
STEPS = 40
#: Feature: its limits, from the most lenient to the strictest.
RANGES = {
    "symbols": (2.0, 0.05),
    "dup_lines": (1.0, 0.3),
    "repeats": (0.3, 0.15),
    "exclamations": (1.0, 0.1),
    "capitals": (0.6, 0.1),
    "word_length": (12.0, 7.0),
    "sameness": (1.0, 0.6),
}
BROADCAST_STRATA = 10_000


def _repeat_words(w: int) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """Two steps of helper columns and the number of words in windows of w words that occur twice or more."""
    one = {"__hash": F.transform("__words", lambda x: F.xxhash64(x))}
    size = F.size("__hash")
    grams = F.when(size >= w, F.transform(F.sequence(F.lit(1), size - (w - 1)), lambda i: F.xxhash64(F.slice("__hash", i, w)))).otherwise(F.array().cast("array<bigint>"))
    two = {"__grams": grams}
    return one, two, F.size(F.array_distinct("__grams")) < F.size("__grams")


def base(docs: DataFrame, stratum: str = "lang", window: int = 8) -> DataFrame:
    """doc_id, stratum, text_hash, the base counts, and the features' raw numbers of each row. A narrow pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one, two, repeated = _repeat_words(window)
    rows = docs.select(F.col("doc_id"), F.col(stratum).alias("stratum"), text.alias("__text"), words(F.col("text")).alias("__words"))
    rows = rows.withColumns({**one, "__lines": F.filter(lines(F.col("__text")), lambda x: without(x, BLANKS) != "")})
    rows = rows.withColumns(two)
    pairs = F.sort_array(F.transform("__grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("__sorted", F.when(repeated, pairs))
    twice = F.filter(
        "__sorted",
        lambda x, i: F.coalesce(x["h"] == F.get("__sorted", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("__sorted", i + 1)["h"], F.lit(False)),
    )
    rows = rows.withColumn("__at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("__at", start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n")), lambda acc: acc["n"])
    count = lambda c: c.cast("long")
    length = F.length("__text")
    return rows.select(
        "doc_id",
        "stratum",
        text_hash(F.col("__text")).alias("text_hash"),
        count(F.size("__words")).alias("n_words"),
        count(F.length(without(F.col("__text"), BLANKS))).alias("word_chars"),
        count(length - F.length(without(F.col("__text"), SYMBOLS))).alias("n_symbols"),
        count(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        count(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
        count(F.size("__lines")).alias("n_lines"),
        count(F.size(F.array_distinct("__hash"))).alias("n_kinds"),
        count(length - F.length(without(F.col("__text"), "!"))).alias("n_exclamations"),
        count(length - F.length(without(F.col("__text"), CAPITALS))).alias("n_capitals"),
    )


def _features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / n,
        "exclamations": F.col("n_exclamations") / n,
        "capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "word_length": F.col("word_chars") / n,
        "sameness": 1 - F.col("n_kinds") / n,
    }


def _step(value: Column, ends: tuple[float, float]) -> Column:
    """Number of the most lenient cutoff that rejects the value: 1 to STEPS, or one more for none."""
    high, low = ends
    return F.greatest(F.lit(1), F.least(F.lit(STEPS + 1), F.floor((high - value) / (high - low) * STEPS).cast("int") + 1))


def _log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by eight; the error is under 1e-12."""
    y = x + 8.0
    shift = F.log(x)
    for i in range(1, 8):
        shift = shift + F.log(x + float(i))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3.0)) + 1 / (1260 * F.pow(y, 5.0)) - shift


def log_binomial_tail(n: Column, k: Column, rate: Column | float) -> Column:
    """ln P(Bin(n, rate) <= k) for k < n * rate: the largest term, times one plus the products of the ratios below it.

    Below 60 standard deviations under k the terms add less than 1e-300 of the sum, so the series ends there.
    """
    rate = F.lit(rate) if isinstance(rate, float) else rate
    n, k = n.cast("double"), k.cast("double")
    term = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(rate) + (n - k) * F.log1p(-rate)
    many = F.least(k, F.ceil(60 * F.sqrt(n * rate)) + 100).cast("int")
    steps = F.when(many > 0, F.sequence(F.lit(1), F.greatest(many, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(acc: Column, j: Column) -> Column:
        t = acc["t"] * (k - j + 1) * (1 - rate) / ((n - k + j) * rate)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    return term + F.log(F.aggregate(steps, zero, add, lambda acc: acc["s"]))


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float, error: float, worth: float) -> DataFrame:
    """stratum, cut (texts whose step is at or before it are rejected). rows: as of ``base``, with ``step`` and ``base_failed``."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = rows.where("not base_failed").select("doc_id", "stratum", "text_hash", "step").join(known, "doc_id")
    drawn = drawn.groupBy("stratum", "text_hash", "step").agg(F.max("quality").alias("quality"))
    good = F.col("quality") == 1
    counts = drawn.groupBy("stratum", "step").agg(F.sum(F.when(good, 1).otherwise(0)).alias("good"), F.sum(F.when(good, 0).otherwise(1)).alias("bad"))
    # a row for each cutoff, also where no text has its step
    row = materialize(counts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("step", F.struct("good", "bad")))).alias("at"), F.sum("good").alias("n")))
    tests = max(row.count(), 1)
    seen = lambda c: F.coalesce(F.col("at")[F.col("step")][c], F.lit(0)).alias(c)
    each = row.select("stratum", "n", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step"), "at").select("stratum", "n", "step", seen("good"), seen("bad"))
    along = Window.partitionBy("stratum").orderBy("step")
    each = each.withColumns({"good": F.sum("good").over(along), "bad": F.sum("bad").over(along)})
    allowed = (F.col("good") < F.col("n") * risk) & (log_binomial_tail(F.col("n"), F.least(F.col("good"), F.col("n")), risk) <= math.log(error / tests))
    each = each.withColumn("allowed", F.min(F.when(allowed, 1).otherwise(0)).over(along))
    gain = F.col("bad") - worth * F.col("good")
    best = each.where("allowed = 1").groupBy("stratum").agg(F.max(F.struct(gain.alias("gain"), (-F.col("step")).alias("step"))).alias("best"))
    return best.where("best.gain > 0").select("stratum", (-F.col("best.step")).alias("cut"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, error: float = 0.1, worth: float = 10.0) -> DataFrame:
    """doc_id, stratum, text_hash, the base counts, base_failed and kept of each row of ``docs``."""
    rows = base(docs, stratum)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = _features()
    step = F.least(*(_step(found[f], ends) for f, ends in RANGES.items()))
    rows = materialize(rows.withColumns({"base_failed": failed, "step": step}).drop("n_lines", "n_kinds", "n_exclamations", "n_capitals"))
    cuts = materialize(cutoffs(rows, labels, risk, error, worth).withColumnRenamed("stratum", "cut_stratum"))
    if cuts.count() <= BROADCAST_STRATA:
        cuts = F.broadcast(cuts)
    joined = rows.join(cuts, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("step") <= F.col("cut"), F.lit(False))
    return joined.select("doc_id", "stratum", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
