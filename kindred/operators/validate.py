"""Checks of result files and of pair tables. Every check gives (check, severity, n, examples): rows that fail, five of them at most as examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources.tables import id_list

EXAMPLES = 5


def _found(rows: DataFrame, example, check: str, severity: str = "error") -> DataFrame:
    few = rows.select(example.cast("string").alias("e")).distinct().orderBy("e").limit(EXAMPLES)
    count = rows.agg(F.count(F.lit(1)).alias("n"))
    return count.crossJoin(few.agg(F.array_sort(F.collect_list("e")).alias("examples"))).select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "n", "examples")


def list_problems(lists: DataFrame) -> DataFrame:
    """Rows (s1_id, ids) with duplicate ids, a match with an entity of the first source, or an unknown prefix: s1_id and three flags."""
    return lists.select(
        "s1_id",
        (F.size("ids") != F.size(F.array_distinct("ids"))).alias("duplicate_id"),
        F.exists("ids", lambda x: x.startswith("S1-")).alias("self_match"),
        F.exists("ids", lambda x: ~x.rlike("^S[123]-")).alias("foreign_prefix"),
    )


def check_lists(lists: DataFrame, entities: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """All checks of (s1_id, ids) against the required entities (s1_id) and, if given, the known targets (entity_id)."""
    twice = lists.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    flags = list_problems(lists)
    out = [
        _found(twice, F.col("s1_id"), "duplicate row"),
        *(_found(flags.where(c), F.col("s1_id"), c.replace("_", " ")) for c in ("duplicate_id", "self_match", "foreign_prefix")),
        _found(entities.join(lists, "s1_id", "left_anti"), F.col("s1_id"), "missing entity"),
        _found(lists.join(entities, "s1_id", "left_anti"), F.col("s1_id"), "extra entity"),
    ]
    if targets is not None:
        ids = lists.select(F.explode("ids").alias("entity_id")).distinct()
        out.append(_found(ids.join(targets, "entity_id", "left_anti"), F.col("entity_id"), "unknown id"))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Entities with matches that are not among their candidates (both s1_id, ids): a warning only."""
    both = matches.join(candidates.withColumnRenamed("ids", "c"), "s1_id", "left")
    extra = F.array_except("ids", F.coalesce("c", F.array().cast("array<string>")))
    return both.select("s1_id", extra.alias("extra")).where(F.size("extra") > 0)


def check_file(spark: SparkSession, path: str, header: tuple[str, str], entities: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Checks of a tab-separated result file: its header (case and outer space don't count), its rows, its lists."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    first = lines.orderBy("at").limit(1)
    wanted = "\t".join(header).lower()
    empty = lines.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    same = F.array_join(F.transform(F.split("value", "\t"), lambda x: F.lower(F.trim(x))), "\t") == wanted
    commas = F.col("value").contains(",") & (F.array_join(F.transform(F.split("value", ","), lambda x: F.lower(F.trim(x))), "\t") == wanted)
    rest = lines.join(first.select("at"), "at", "left_anti").where("value <> ''")
    parts = F.split("value", "\t")
    lists = rest.where(F.col("value").contains("\t")).select(F.trim(parts[0]).alias("s1_id"), id_list(F.get(parts, 1)).alias("ids"))
    head = _found(empty, F.col("n"), "empty file").unionByName(_found(first.where(commas), F.col("value"), "commas, not tabs")).unionByName(_found(first.where(~same & ~commas), F.col("value"), "wrong header"))
    return head.unionByName(_found(rest.where(~F.col("value").contains("\t")), F.col("value"), "row without tab")).unionByName(check_lists(lists, entities, targets))


def passed(checks: DataFrame) -> bool:
    """Whether no error was found; warnings pass."""
    return not checks.where("severity = 'error' and n > 0").limit(1).count()
