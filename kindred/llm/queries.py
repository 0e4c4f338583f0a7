"""One query for each operator of this subpackage, over its whole table, and SQL where it can be said in SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontam, line_dedup, lm_score, packing, pii, quality, simhash, suffix_dedup, token_counts, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.fit_score(_table(spark, sf_dir, "documents"))


#: The key of op2's pseudonyms; a real one would come from a secret store.
PII_KEY = "kindred-demonstration-key"


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY)
    return out.select("doc_id", "text", F.size("replaced").alias("n_replaced"), F.array_join("replaced.kind", ",").alias("kinds"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("stratum", "text_hash")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed_lines")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2, size=4096)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, d=2)
    return out.select("doc_id", simhash.hexadecimal(out.fp).alias("fingerprint"), "component_id")


#: Host, path and verdict of the rules that op9 applies.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(_table(spark, sf_dir, "pages"), rules)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"), 100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


_QUERIES = (op1_lm_scoring, op2_pii_pseudonyms, op3_token_counts, op4_quality_rules, op5_line_dedup, op6_packing, op7_benchmark_decontamination, op8_simhash_near_dedup, op9_url_filters, op10_suffix_array_dedup)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_WORDS = r"list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_VALUES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "exclamations": "n_exclamations / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "sameness": "1 - n_kinds / greatest(n_words, 1)",
}
_STEP = ", ".join(f"greatest(1, least({quality.STEPS + 1}, CAST(floor(({hi} - ({_VALUES[f]})) / CAST({hi - lo!r} AS DOUBLE) * {quality.STEPS}) AS INT) + 1))" for f, (hi, lo) in quality.RANGES.items())

QUALITY_SQL = rf"""WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS x FROM documents),
u AS (SELECT *, {_WORDS} AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM u)),
d AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, sum(least(8, step)) AS n FROM (SELECT doc_id, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), p - 8) AS step FROM d) GROUP BY 1),
b AS (SELECT u.doc_id, lang, x, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(list_distinct(w)) AS n_kinds,
 length(regexp_replace(x, '[^!]', '', 'g')) AS n_exclamations, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS n_capitals FROM u LEFT JOIN c USING (doc_id)),
e AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, least({_STEP}) AS s FROM b),
q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
d1 AS (SELECT lang, x, any_value(s) AS s, max(quality) AS quality FROM e JOIN q USING (doc_id) WHERE NOT base_failed GROUP BY 1, 2),
n AS (SELECT lang, s, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality <> 1) AS bad FROM d1 GROUP BY 1, 2),
r AS (SELECT lang, sum(good) AS n FROM n GROUP BY 1),
k AS (SELECT r.lang, r.n, j.s, sum(coalesce(n.good, 0)) OVER w AS good, sum(coalesce(n.bad, 0)) OVER w AS bad FROM r CROSS JOIN (SELECT unnest(range(1, {quality.STEPS + 1})) AS s) j LEFT JOIN n ON n.lang IS NOT DISTINCT FROM r.lang AND n.s = j.s WINDOW w AS (PARTITION BY r.lang ORDER BY j.s)),
o AS (SELECT *, min(CASE WHEN good < n * 0.02 AND list_sum(list_transform(range(0, CAST(good AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02) + (n - i) * ln(0.98)))) <= 0.1 / (SELECT count(*) FROM r) THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY s) AS allowed FROM k),
cut AS (SELECT lang, s AS cut FROM o WHERE allowed = 1 AND bad - 10 * good > 0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY bad - 10 * good DESC, s) = 1),
z AS (SELECT e.*, coalesce(s <= cut, false) AS over FROM e LEFT JOIN cut ON cut.lang IS NOT DISTINCT FROM e.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT over AS kept FROM z"""

LINES_SQL = r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i - 1 AS pos, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l)),
f AS (SELECT k, min({'d': doc_id, 'a': pos}) AS f FROM w WHERE regexp_matches(k, '[^\x20\x09-\x0D]') GROUP BY 1),
c AS (SELECT DISTINCT doc_id, pos + o AS i FROM w JOIN f USING (k) CROSS JOIN (SELECT unnest([0, 1, 2]) AS o) WHERE {'d': doc_id, 'a': pos} > f),
s AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM l),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM s ANTI JOIN c USING (doc_id, i) GROUP BY 1), n AS (SELECT doc_id, count(*) AS gone FROM c GROUP BY 1)
SELECT l.doc_id, CASE WHEN gone IS NULL THEN text ELSE coalesce(kept, '') END AS text, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, coalesce(gone, 0) AS n_removed_lines FROM l LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""

URLS_SQL = f"""WITH rules(rule_host, rule_path, said) AS (VALUES {", ".join(map(str, URL_RULES))}),
r AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, x.rule AS rule, coalesce(x.said, 'allow') AS verdict FROM p LEFT JOIN LATERAL (SELECT rule_host || rule_path AS rule, said FROM rules
 WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) ORDER BY length(rule_host || rule_path) DESC LIMIT 1) x ON true"""


def oracle_sql() -> dict[str, str]:
    """The others need hashes, models or tokenizers that SQL lacks; tests hold them against brute force."""
    return {"op4_quality_rules": QUALITY_SQL, "op5_line_dedup": LINES_SQL, "op9_url_filters": URLS_SQL}
