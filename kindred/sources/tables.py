"""Readers and writers of the linkage files: tab-separated sources, ground truth, results; Parquet stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
#: Names that a score column may have, in order of preference.
SCORE_NAMES = ["prob", "score", "score_C", "preds", "probability"]


def read_source(spark: SparkSession, path: str, columns: list[str] | None = None, sample: int | None = None) -> DataFrame:
    """A source table. Quotes are characters like others. sample: that many rows of the smallest ids."""
    rows = spark.read.schema(SOURCE).csv(path, sep="\t", header=True, quote="", nullValue="nan")
    rows = rows.withColumn("source", F.substring("entity_id", 1, 2))
    if sample is not None:
        rows = rows.orderBy("entity_id").limit(sample)
    return rows.select(*columns) if columns else rows


def id_list(c):
    """Array of the ids in a comma list, blanks dropped."""
    parts = F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), ",")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, matches): an empty array for singletons."""
    rows = spark.read.schema(TRUTH).csv(path, sep="\t", header=True, quote="")
    return rows.select(F.trim("source1_entity_id").alias("s1_id"), id_list("matched_entity_ids").alias("matches"))


def read_results(spark: SparkSession, path: str, score: float = 0.95) -> DataFrame:
    """Pairs (s1_id, candidate_id, score) of an earlier result file, all with one score."""
    rows = spark.read.schema(TRUTH).csv(path, sep="\t", header=True, quote="")
    pairs = rows.select(F.trim("source1_entity_id").alias("s1_id"), F.explode(id_list("matched_entity_ids")).alias("candidate_id"))
    return pairs.where("s1_id <> ''").withColumn("score", F.lit(score))


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Scored pairs from Parquet, whichever of SCORE_NAMES the score is called."""
    rows = spark.read.parquet(path)
    name = next((c for c in SCORE_NAMES if c in rows.columns), None)
    if name is None:
        raise ValueError(f"none of {SCORE_NAMES} is in {rows.columns}")
    return rows.select("s1_id", "candidate_id", F.col(name).cast("double").alias("score"))


def semi_join_sample(s1: DataFrame, targets: DataFrame, truth: DataFrame, n: int, background: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """n entities of s1, and of the targets all their matches and ``background`` times n others; by hash order."""
    some = s1.orderBy(F.md5(F.concat_ws("|", "entity_id", F.lit(seed))), "entity_id").limit(n)
    ids = truth.join(some.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi").select(F.explode("matches").alias("entity_id")).distinct()
    true = targets.join(ids, "entity_id", "left_semi")
    rest = targets.join(ids, "entity_id", "left_anti").orderBy(F.md5(F.concat_ws("|", "entity_id", F.lit(seed))), "entity_id").limit(background * n)
    return some, true.unionByName(rest).dropDuplicates(["entity_id"])


def write_lists(entities: DataFrame, pairs: DataFrame, path: str, name: str, order: str | None = None, one_file: bool = True) -> None:
    """A result file: a row for each entity, in order of ``row_idx`` if there is one, with the comma list of its candidates.

    order: a column by which lists are sorted, largest first; ids sort them otherwise.
    """
    key = F.struct((-F.col(order)).alias("k"), "candidate_id") if order else F.struct("candidate_id")
    lists = pairs.groupBy("s1_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["candidate_id"])).alias("ids"))
    ids = entities.withColumnRenamed("entity_id", "s1_id")
    rows = ids.join(lists, "s1_id", "left")
    rows = rows.orderBy("row_idx" if "row_idx" in ids.columns else "s1_id")
    out = rows.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias(name))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").options(sep="\t", quote="", emptyValue="", nullValue="", header=True).csv(path)


def shard(rows: DataFrame, key: str, shards: int, own: int) -> DataFrame:
    """The rows whose key's hash falls in one of several shards."""
    return rows.where(F.pmod(F.xxhash64(key), F.lit(shards)) == own)


def pending(rows: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """Rows whose key an earlier run hasn't finished: what remains after a restart."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def assemble(parts: list[DataFrame], expected: int | None = None) -> DataFrame:
    """All shards by column name; with ``expected``, their rows must come to that."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} rows, not {expected}")
    return out
