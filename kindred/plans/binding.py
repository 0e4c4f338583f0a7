"""Linkage tables from the documents table, in Spark and as DuckDB SQL.

A document's first sentence is its name, the second its address, its language its country. The entities (S1) are the first documents of
each text in sources of even number; all other documents are targets, S2 or S3 by their source's parity. Equal texts are the true matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.text import clean, tokens
from kindred.functions.similarity import jaccard
from kindred.operators import blocking, features

CLEAN_SQL = r"trim(regexp_replace(regexp_replace(replace(lower(strip_accents({0})), '&', ' and '), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
TOKENS_SQL = "list_filter(string_split({0}, ' '), lambda x: x <> '')"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """entity_id, side (S1 or target), name, address (clean), country, digest of the text."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, d, "documents").select(
        "doc_id",
        F.col("lang").alias("country"),
        (F.substring("source", 4, 10).cast("int") % 2 == 0).alias("even"),
        F.sha2(text, 256).alias("digest"),
        clean(F.split_part(text, F.lit("."), F.lit(1))).alias("name"),
        clean(F.split_part(text, F.lit("."), F.lit(2))).alias("address"),
    )
    first = docs.where("even").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("is_first"))
    side = F.when(F.col("is_first"), "S1").otherwise(F.when(F.col("even"), "S2").otherwise("S3"))
    rows = docs.join(first, "doc_id", "left").select(F.concat(side, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), side.alias("side"), "name", "address", "country", "digest")
    return rows


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, targets, truth)."""
    r = records(spark, d)
    s1, t = r.where("side = 'S1'").drop("side"), r.where("side <> 'S1'").drop("side")
    ids = t.groupBy("digest").agg(F.array_sort(F.collect_list("entity_id")).alias("m"))
    truth = s1.select(F.col("entity_id").alias("s1_id"), "digest").join(ids, "digest", "left").select("s1_id", F.coalesce("m", F.array().cast("array<string>")).alias("matches"))
    return s1, t, truth


SIDES_SQL = f"""
r0 AS (SELECT doc_id, lang AS country, CAST(substr(source, 4) AS INT) % 2 = 0 AS even, coalesce(text, '') AS text,
  {CLEAN_SQL.format("split_part(coalesce(text, ''), '.', 1)")} AS name,
  {CLEAN_SQL.format("split_part(coalesce(text, ''), '.', 2)")} AS address FROM documents),
firsts AS (SELECT min(doc_id) AS doc_id FROM r0 WHERE even GROUP BY text),
s1 AS (SELECT 'S1-' || doc_id AS entity_id, name, address, country, text FROM r0 WHERE doc_id IN (SELECT doc_id FROM firsts)),
tg AS (SELECT (CASE WHEN even THEN 'S2-' ELSE 'S3-' END) || doc_id AS entity_id, name, address, country, text FROM r0 WHERE doc_id NOT IN (SELECT doc_id FROM firsts)),
tp AS (SELECT s1.entity_id AS s1_id, tg.entity_id AS candidate_id FROM s1 JOIN tg USING (text)),
tn AS (SELECT s1.entity_id AS s1_id, count(tp.candidate_id) AS n_true FROM s1 LEFT JOIN tp ON tp.s1_id = s1.entity_id GROUP BY 1)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by the whole name, 15 targets for a name; s1_id, candidate_id."""
    s1, t, _ = sides(spark, d)
    keyed = lambda x: x.withColumn("k", blocking.name_key(F.col("name")))
    return blocking.key_block(keyed(s1), keyed(t), "k", 15).select("s1_id", "candidate_id")


def jaccard_sql(a: str, b: str) -> str:
    """Of two lists."""
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)"


PAIRS_SQL = f"""{SIDES_SQL},
ranked_tg AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY entity_id) AS r FROM tg WHERE length(name) >= 2),
pairs AS (SELECT s1.entity_id AS s1_id, c.entity_id AS candidate_id, s1.address AS a1, c.address AS a2, s1.name AS n1, c.name AS n2, c.country AS c_country
  FROM s1 JOIN ranked_tg c ON s1.name = c.name AND c.r <= 15 WHERE length(s1.name) >= 2)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with a score: half for the name, half the addresses' token Jaccard. s1_id, candidate_id, score, sim_name, sim_addr, house, state, label."""
    s1, t, truth = sides(spark, d)
    p = pairs(spark, d)
    own = lambda x, i, c: x.select(F.col("entity_id").alias(i), tokens(F.col("address")).alias(c), F.col("country").alias(f"{c}_country"))
    p = p.join(own(s1, "s1_id", "x"), "s1_id").join(own(t, "candidate_id", "y"), "candidate_id")
    sim = F.round(jaccard(F.col("x"), F.col("y")), 4)  # so that no later rounding meets a tie
    p = p.select("s1_id", "candidate_id", F.round(0.5 + 0.5 * sim, 6).alias("score"), F.lit(1.0).alias("sim_name"), sim.alias("sim_addr"), F.coalesce(F.get("y", 0), F.lit("")).alias("house"), F.col("y_country").alias("state"))
    return features.label(p, truth)


SCORED_SQL = f"""{PAIRS_SQL},
sims AS (SELECT s1_id, candidate_id, round({jaccard_sql(TOKENS_SQL.format("a1"), TOKENS_SQL.format("a2"))}, 4) AS sim_addr, split_part(a2, ' ', 1) AS house, c_country AS state FROM pairs),
scored AS (SELECT s1_id, candidate_id, round(0.5 + 0.5 * sim_addr, 6) AS score, 1.0 AS sim_name, sim_addr, sims.house, state,
  CAST(tp.s1_id IS NOT NULL AS INT) AS label FROM sims LEFT JOIN tp USING (s1_id, candidate_id))"""

#: Entities' outcomes for the pairs of a relation "pred".
ENTITIES_SQL = """
np AS (SELECT s1_id, count(DISTINCT candidate_id) AS n_pred FROM pred GROUP BY 1),
hits AS (SELECT s1_id, count(*) AS tp FROM tp JOIN (SELECT DISTINCT s1_id, candidate_id FROM pred) USING (s1_id, candidate_id) GROUP BY 1),
e0 AS (SELECT tn.s1_id, n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM tn LEFT JOIN np USING (s1_id) LEFT JOIN hits USING (s1_id)),
entities AS (SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * n_true + n_pred) END AS f05 FROM e0)"""
