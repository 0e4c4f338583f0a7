"""Linkage of files as they arrive: each batch of records is normalised, blocked against the entities, scored, and its decided matches are appended.

Batches are exactly-once by Structured Streaming's checkpoint and by an output folder for each batch that a repeated batch overwrites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.similarity import token_jaccard
from kindred.operators import blocking, decide
from kindred.operators.normalize import normalize_records
from kindred.sources.storage import ship
from kindred.sources.tables import SOURCE


def read_arrivals(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the tab-separated source files in a folder."""
    return spark.readStream.schema(SOURCE).options(sep="\t", header=True, quote="", nullValue="nan", maxFilesPerTrigger=files_per_batch).csv(path)


def match(entities: DataFrame, records: DataFrame, cap: int = 15, first: float = decide.FIRST, rest: float = decide.REST) -> DataFrame:
    """(s1_id, candidate_id, score) of raw records decided against normalised entities: equal core names, addresses by token Jaccard."""
    keyed = lambda x: x.withColumn("k", blocking.name_key(F.col("name_core")))
    targets = normalize_records(records)
    pairs = blocking.key_block(keyed(entities), keyed(targets), "k", cap).select("s1_id", "candidate_id")
    own = lambda x, i, a: x.select(F.col("entity_id").alias(i), F.col("addr_core").alias(a))
    both = pairs.join(own(entities, "s1_id", "a1"), "s1_id").join(own(targets, "candidate_id", "a2"), "candidate_id")
    scored = both.select("s1_id", "candidate_id", (0.5 + 0.5 * token_jaccard(F.col("a1"), F.col("a2"))).alias("score"))
    return decide.exclusive(decide.two_thresholds(scored, first, rest))


def start(arrivals: DataFrame, entities: DataFrame, out: str, checkpoint: str, decide_batch: Callable[[DataFrame, DataFrame], DataFrame] = match):
    """A query that handles what is there and ends; run again, it goes on with new files. Matches of batch n are in ``out``/batch=n."""
    ship(entities.sparkSession)

    def handle(batch: DataFrame, n: int) -> None:
        decide_batch(entities, batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
