"""URL filters: host-suffix and path-prefix expressions, met with rules by short hash prefixes.

A rule is a host and a path beginning. It fits a URL if the URL's host is the rule's or a subdomain of it, and the path starts
with the rule's path. The URL is expanded into host suffixes (of as many labels as some rule has) times path beginnings (of the lengths that rules have);
expressions meet rules on the first eight hexadecimal digits of their SHA-256 and the full digests confirm. The longest rule
wins, of equally long ones that with the longer host, then the smaller text; if rules of one text differ, block wins.

Distinct (host, path) pairs are judged once, however many rows have them. Rules are sent to all executors while their number is at most
``BROADCAST_RULES``; more are joined by a shuffle. URLs that are null or have no "://" have empty host and path; only a rule with an
empty host could fit those. Rules with a null part are ignored. Repeated pages keep their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At about 100 bytes a rule the broadcast stays under 10 MB.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first "://", A-Z lowered) and path (up to "?" or "#")."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _digests(expression: Column) -> list[Column]:
    full = F.sha2(expression, 256)
    return [F.substring(full, 1, 8).alias("prefix"), full.alias("digest")]


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages`` (page_id, url). rules: host, path, verdict."""
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict")).na.drop()
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    size = rules.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths"), F.array_sort(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("labels")).first()
    keyed = rules.select("*", *_digests(F.concat_ws("\n", "rule_host", "rule_path")))
    if size.n <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    few = F.filter(F.lit(size.labels).cast("array<int>"), lambda n: n <= F.size(labels))
    suffixes = F.transform(few, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    starts = F.filter(F.lit(size.lengths).cast("array<int>"), lambda n: n <= F.length("path"))
    expanded = (
        rows.select("host", "path").distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("start", F.explode(F.transform(starts, lambda n: F.substring(F.col("path"), F.lit(1), n))))
        .select("host", "path", *_digests(F.concat_ws("\n", "suffix", "start")))
    )
    fitting = expanded.join(keyed, "prefix").where(expanded.digest == keyed.digest)
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("a"), F.length("rule_host").alias("b"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict"))
    best = fitting.groupBy("host", "path").agg(F.max(rank).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("found"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))
