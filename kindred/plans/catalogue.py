"""The queries of the library over the test tables, and the same in DuckDB SQL where it can be said there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.functions import text as T
from kindred.functions import vocabulary as V
from kindred.operators import blocking, components, decide, encode, features, metrics, model, validate
from kindred.plans.binding import CLEAN_SQL, ENTITIES_SQL, PAIRS_SQL, SCORED_SQL, SIDES_SQL, TOKENS_SQL, jaccard_sql, pairs, records, scored, sides, table
from kindred.sources.storage import materialize, ship

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# linkage from end to end

MACRO_SQL = """SELECT round(coalesce(avg(f05), 0), 6) AS macro_f05, count(*) FILTER (WHERE n_true = 0) AS singleton_count,
 round(coalesce(avg(f05) FILTER (WHERE n_true = 0), 0), 6) AS singleton_f05, count(*) FILTER (WHERE n_true > 0) AS non_singleton_count,
 round(coalesce(avg(f05) FILTER (WHERE n_true > 0), 0), 6) AS non_singleton_f05 FROM entities"""
SINGLE_SQL = f"WITH {SCORED_SQL}, pred AS (SELECT s1_id, candidate_id FROM scored WHERE score >= 0.75), {ENTITIES_SQL} "


def _entities(spark, d):
    return metrics.per_entity(sides(spark, d)[2], decide.single_threshold(scored(spark, d), 0.75))


@query(SINGLE_SQL + MACRO_SQL)
def er_flagship_f05(spark, d):
    """Clean, block by name, score by addresses, one threshold, macro F0.5."""
    return rounded(metrics.macro(_entities(spark, d)), "macro_f05", "singleton_f05", "non_singleton_f05")


# normalisation


@query(f"SELECT doc_id, {CLEAN_SQL.format('coalesce(text, chr(32))')} AS cleaned FROM documents")
def norm_ascii(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


_FORMS = ["'acme ' || p_name || ' inc'", "'llc ' || p_name", "p_name || ' private limited'", "p_name || ' co of ' || p_type", "p_name || ' plc group'", "p_name"]
_LEGAL_SQL = "lower(CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_FORMS)) + " END)"
_LEAD, _TRAIL, _ANY = rf"^({V.LEADING_FORMS})\s+", rf"\s+({V.TRAILING_FORMS})$", rf"^(.*)\b({V.ANY_FORMS})\b(.*?)$"


@query(rf"""WITH x AS (SELECT p_partkey, {_LEGAL_SQL} AS n FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(n, '{_LEAD}') THEN trim(regexp_replace(n, '{_LEAD}', '')) WHEN regexp_matches(n, '{_TRAIL}') THEN trim(regexp_replace(n, '{_TRAIL}', ''))
 WHEN regexp_matches(n, '{_ANY}') THEN trim(regexp_replace(regexp_replace(n, '{_ANY}', '\1 \3'), '\s+', ' ', 'g')) ELSE n END AS core,
 CASE WHEN regexp_matches(n, '{_LEAD}') THEN regexp_extract(n, '{_LEAD}', 1) WHEN regexp_matches(n, '{_TRAIL}') THEN regexp_extract(n, '{_TRAIL}', 1)
 WHEN regexp_matches(n, '{_ANY}') THEN regexp_extract(n, '{_ANY}', 2) ELSE '' END AS form,
 trim(regexp_replace(regexp_replace(n, '\b({V.ANY_FORMS})\b', '', 'g'), '\s+', ' ', 'g')) AS bare FROM x""")
def legal_strip(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.expr(_LEGAL_SQL).alias("n"))
    core, form = T.legal_form(F.col("n"))
    return x.select("p_partkey", core.alias("core"), form.alias("form"), T.drop_legal_forms(F.col("n")).alias("bare"))


_DBA_SQL = "CASE c_custkey % 4 WHEN 0 THEN c_name || ' dba Shop ' || c_mktsegment WHEN 1 THEN c_name || ' Doing Business As X' WHEN 2 THEN c_name || ' t/a Y dba Z' ELSE c_name END"


@query(rf"""WITH x AS (SELECT c_custkey, {_DBA_SQL} AS n FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(n, '(?i){V.DBA}') THEN trim(regexp_extract(n, '(?i)^(.*?){V.DBA}', 1)) ELSE n END AS primary_name,
 CASE WHEN regexp_matches(n, '(?i){V.DBA}') THEN trim(regexp_extract(n, '(?i){V.DBA}(.*)$', 2)) ELSE '' END AS trade_name FROM x""")
def dba_split(spark, d):
    x = table(spark, d, "customer").select("c_custkey", F.expr(_DBA_SQL).alias("n"))
    primary, trade = T.split_dba(F.col("n"))
    return x.select("c_custkey", primary.alias("primary_name"), trade.alias("trade_name"))


@query(rf"SELECT c_custkey, trim(regexp_replace(n, '(?is){V.DBA_AKA}.*', '')) AS name FROM (SELECT c_custkey, {_DBA_SQL} AS n FROM customer)")
def dba_drop_tail(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.drop_dba(F.expr(_DBA_SQL)).alias("name"))


_ADDRESS_SQL = """CASE c_custkey % 7 WHEN 0 THEN c_custkey || ' main st, ste 4, Charlotte, North Carolina near city mall' WHEN 1 THEN '##' || c_custkey || ' oak ave, Austin, TX'
 WHEN 2 THEN 'plot no. ' || c_custkey || 'b ring rd opp bank' WHEN 3 THEN 'block XX' || c_custkey || ' lake dr, WEST VIRGINIA' WHEN 4 THEN 'la rue ' || c_custkey || ' bd hugo'
 WHEN 5 THEN 'h no 7/' || c_custkey || ' cross ln behind temple, virginia' ELSE 'no number pkwy' END"""
_STREET_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in V.STREETS.items()) + "}"


_CODES_SQL = ", ".join(f"'{c}'" for c in V.STATES.values())


@query(rf"""SELECT c_custkey, coalesce(list_filter(regexp_extract_all(upper(a), '\b([A-Z]{{2}})\b', 1), lambda t: list_contains([{_CODES_SQL}], t))[1], '') AS state FROM (SELECT c_custkey, {_ADDRESS_SQL} AS a FROM customer)""")
def state_first_code(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.state_token(F.expr(_ADDRESS_SQL)).alias("state"))


@query(rf"""SELECT c_custkey, regexp_replace(a, '{V.REDACTED}', ' ', 'g') AS bare, contains(a, '##') OR contains(a, '***') AS redacted FROM (SELECT c_custkey, {_ADDRESS_SQL} AS a FROM customer)""")
def redaction_variants(spark, d):
    a = F.expr(_ADDRESS_SQL)
    return table(spark, d, "customer").select("c_custkey", T.redaction_all(a).alias("bare"), T.is_redacted_plain(a).alias("redacted"))


@query(rf"""WITH x AS (SELECT c_custkey, {_ADDRESS_SQL} AS a FROM customer)
SELECT c_custkey, array_to_string(list_transform({TOKENS_SQL.format(CLEAN_SQL.format("a"))}, lambda t: coalesce({_STREET_MAP}[t], t)), ' ') AS expanded FROM x""")
def street_expand(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.expand_streets(T.clean(F.expr(_ADDRESS_SQL))).alias("expanded"))


@query(rf"""WITH x AS (SELECT c_custkey, {_ADDRESS_SQL} AS a FROM customer), y AS (SELECT *, regexp_matches(a, '{V.REDACTED}') AS red,
 regexp_replace(a, '{V.REDACTED}', ' ') AS kept FROM x)
SELECT c_custkey, red AS is_redacted, kept, CASE WHEN red THEN '' ELSE lower(coalesce(nullif(regexp_extract(kept, '(?i){V.LABELLED_NUMBER}', 1), ''),
 nullif(regexp_extract(kept, '^\s*([0-9]+[a-zA-Z]?)\b', 1), ''), nullif(regexp_extract(substr(kept, 1, 35), '\b([0-9]+[a-zA-Z]?)\b', 1), ''), '')) END AS house_number FROM y""")
def house_number(spark, d):
    red, kept = T.redaction(F.col("a"))
    x = table(spark, d, "customer").select("c_custkey", F.expr(_ADDRESS_SQL).alias("a")).select("c_custkey", red.alias("is_redacted"), kept.alias("kept"))
    return x.withColumn("house_number", F.when(F.col("is_redacted"), "").otherwise(T.house_number(F.col("kept"))))


@query(rf"""WITH x AS (SELECT c_custkey, {_ADDRESS_SQL} AS a FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(a, '(?i){V.LANDMARK}') THEN trim(regexp_extract(a, '(?i)^(.*?){V.LANDMARK}', 1)) ELSE a END AS before,
 CASE WHEN regexp_matches(a, '(?i){V.LANDMARK}') THEN trim(regexp_extract(a, '(?i){V.LANDMARK}.*$', 0)) ELSE '' END AS landmark FROM x""")
def landmark_split(spark, d):
    before, mark = T.landmark(F.col("a"))
    return table(spark, d, "customer").select("c_custkey", F.expr(_ADDRESS_SQL).alias("a")).select("c_custkey", before.alias("before"), mark.alias("landmark"))


_STATES = sorted(V.STATES.items(), key=lambda x: -len(x[0]))
_CODES = ", ".join(f"'{c}'" for c in V.STATES.values())


@query(rf"""WITH x AS (SELECT c_custkey, {_ADDRESS_SQL} AS a FROM customer)
SELECT c_custkey, CASE {" ".join(rf"WHEN regexp_matches(a, '(?i)\b{n}\b') THEN '{c}'" for n, c in _STATES)}
 ELSE coalesce(list_filter(regexp_extract_all(upper(a), '\b[A-Z][A-Z]\b'), lambda t: t IN ({_CODES}))[1], '') END AS state_code,
 CASE {" ".join(rf"WHEN regexp_matches(a, '(?i)\b{n}\b') THEN regexp_replace(a, '(?i)\b{n}\b', ' {c} ', 'g')" for n, c in _STATES)} ELSE a END AS coded FROM x""")
def state_code(spark, d):
    code, changed = T.state(F.col("a"))
    return table(spark, d, "customer").select("c_custkey", F.expr(_ADDRESS_SQL).alias("a")).select("c_custkey", code.alias("state_code"), changed.alias("coded"))


@query()
def normalize_dense_records(spark, d):
    """All 13 fields of documents' sentences as names and addresses."""
    from kindred.operators.normalize import normalize_records

    ship(spark)
    return normalize_records(_raw(spark, d))


@query()
def normalize_sparse_records(spark, d):
    from kindred.operators.normalize import normalize_sparse

    return normalize_sparse(_raw(spark, d))


@query()
def normalize_exact_accents(spark, d):
    ship(spark)
    return table(spark, d, "documents").select("doc_id", T.clean(F.col("text"), exact=True).alias("cleaned"))


_SQL["normalize_exact_accents"] = _SQL["norm_ascii"]


def _raw(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(
        F.concat(F.lit("S1-"), F.col("doc_id").cast("string")).alias("entity_id"), F.split_part(text, F.lit("."), F.lit(1)).alias("business_name"),
        F.split_part(text, F.lit("."), F.lit(2)).alias("business_address"), F.col("lang").alias("country"),
    )


# similarity of strings: distinct part names that share a word


def _name_pairs(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("n")).distinct()
    words = names.select("n", F.explode(F.array_distinct(T.tokens(F.col("n")))).alias("w"))
    return words.join(words.withColumnRenamed("n", "m"), "w").where("n < m").select(F.col("n").alias("a"), F.col("m").alias("b")).distinct()


_NAME_PAIRS = """names AS (SELECT DISTINCT p_name AS n FROM part), words AS (SELECT n, unnest(list_distinct(string_split(n, ' '))) AS w FROM names),
np AS (SELECT DISTINCT x.n AS a, y.n AS b FROM words x JOIN words y USING (w) WHERE x.n < y.n)"""
_GRAM_SQL = "list_distinct(list_transform(range(1, greatest(length({0}) - {1} + 2, 1)), lambda i: substr({0}, i, {1})))"


def _measure(name: str, column: Callable, sql: str | None):
    def f(spark, d):
        ship(spark)
        return _name_pairs(spark, d).select("a", "b", F.round(column(F.col("a"), F.col("b")), 6).alias("value"))

    f.__name__ = name
    query(f"WITH {_NAME_PAIRS} SELECT a, b, round({sql}, 6) AS value FROM np" if sql else None)(f)


_A, _B = "string_split(a, ' ')", "string_split(b, ' ')"
_measure("token_jaccard", S.token_jaccard, jaccard_sql(_A, _B))
_measure("token_overlap", S.token_overlap, f"len(list_intersect({_A}, {_B})) / least(len(list_distinct({_A})), len(list_distinct({_B})))")
_measure("ngram3_jaccard", lambda a, b: S.gram_jaccard(a, b, 3), jaccard_sql(_GRAM_SQL.format("a", 3), _GRAM_SQL.format("b", 3)))
_measure("ngram4_jaccard", lambda a, b: S.gram_jaccard(a, b, 4), jaccard_sql(_GRAM_SQL.format("a", 4), _GRAM_SQL.format("b", 4)))
_measure("lev_norm", S.levenshtein_similarity, "1 - levenshtein(a, b) / greatest(length(a), length(b))")
_measure("jaro_winkler", S.jaro_winkler, "jaro_winkler_similarity(a, b)")
_measure("soundex_equal", lambda a, b: S.sounds_alike(a, b).cast("double"), None)
_measure("acronym_match", lambda a, b: S.acronym(a, b).cast("double"), "CAST(a = array_to_string(list_transform(string_split(b, ' '), lambda t: substr(t, 1, 1)), '') OR b = array_to_string(list_transform(string_split(a, ' '), lambda t: substr(t, 1, 1)), '') AS DOUBLE)")
_measure("length_ratio", S.length_ratio, "least(length(a), length(b)) / greatest(length(a), length(b))")
for _name, _f in (("fuzz_token_sort", S.token_sort_ratio), ("fuzz_token_set", S.token_set_ratio), ("fuzz_partial", S.partial_ratio), ("fuzz_wratio", S.weighted_ratio)):
    _measure(_name, _f, None)


@query(r"""WITH x AS (SELECT c_custkey, c_name || ' ' || (c_custkey % 10) || ' ' || (c_custkey % 7) AS a, 'Customer#' || lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0') || ' ' || (c_custkey % 7) || ' ' || (c_custkey % 5) AS b FROM customer)
SELECT c_custkey, len(list_intersect(list_distinct(regexp_extract_all(a, '\b(\d+)\b', 1)), list_distinct(regexp_extract_all(b, '\b(\d+)\b', 1)))) AS shared FROM x""")
def numeric_overlap(spark, d):
    k = F.col("c_custkey")
    a = F.concat_ws(" ", "c_name", (k % 10).cast("string"), (k % 7).cast("string"))
    b = F.concat_ws(" ", F.concat(F.lit("Customer#"), F.lpad((k + 1).cast("string"), 9, "0")), (k % 7).cast("string"), (k % 5).cast("string"))
    return table(spark, d, "customer").select("c_custkey", S.shared_numbers(a, b).cast("long").alias("shared"))


@query("SELECT c_custkey, CASE WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 0 WHEN a = b THEN 1 ELSE -1 END AS state FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS a, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'MACHINERY' END AS b FROM customer)")
def three_state(spark, d):
    a, b = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("MACHINERY")
    return table(spark, d, "customer").select("c_custkey", S.three_state(a, b).alias("state"))


# dense search: every fiftieth vector against all


def _vectors(spark, d, part: str = "all"):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    v = {"all": F.col("v"), "low": F.slice("v", 1, 32)}[part]
    return e.select("id", "label", S.unit(v).alias("vector"))


def _search(spark, d, k: int, same_label: bool = False, part: str = "all"):
    e = _vectors(spark, d, part).withColumn("group", F.col("label") if same_label else F.lit(-1).cast("long"))
    return blocking.dense_top_k(e.where("id % 50 = 0"), e, k)


def _search_sql(name: str, k: int, condition: str = "true", part: str = "e") -> str:
    unit = f"list_transform({part}, lambda x: x / sqrt(list_inner_product({part}, {part})))"
    return f"""{name}_v AS (SELECT vec_id, label, {unit} AS u FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
{name} AS (SELECT s1_id, candidate_id, sim FROM (SELECT q.vec_id AS s1_id, t.vec_id AS candidate_id, list_inner_product(q.u, t.u) AS sim FROM {name}_v q JOIN {name}_v t ON q.vec_id % 50 = 0 AND q.vec_id <> t.vec_id AND {condition})
 QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY sim DESC, candidate_id) <= {k})"""


@query(f"WITH {_search_sql('x', 20)} SELECT s1_id, candidate_id, round(sim, 6) AS sim FROM x")
def dense_topk(spark, d):
    return rounded(_search(spark, d, 20), "sim")


@query(f"WITH {_search_sql('x', 20, 'q.label = t.label')} SELECT s1_id, candidate_id, round(sim, 6) AS sim FROM x")
def dense_topk_country(spark, d):
    return rounded(_search(spark, d, 20, same_label=True), "sim")


@query(f"""WITH {_search_sql('n', 10)}, {_search_sql('a', 10, part='e[1:32]')}
SELECT s1_id, candidate_id, round(coalesce(n.sim, 0), 6) AS sim_name, round(coalesce(a.sim, 0), 6) AS sim_addr, CAST(n.sim IS NOT NULL AS TINYINT) AS route_name, CAST(a.sim IS NOT NULL AS TINYINT) AS route_addr
FROM n FULL JOIN a USING (s1_id, candidate_id)""")
def dual_route_union(spark, d):
    return rounded(blocking.dual_route(_search(spark, d, 10), _search(spark, d, 10, part="low")), "sim_name", "sim_addr")


@query()
def dense_cell_recall(spark, d):
    """Recall of the cell index against the exact search, ten neighbours."""
    e = _vectors(spark, d)
    found = blocking.cell_top_k(e.where("id % 50 = 0"), e, 10, n_cells=8, probes=6).select("s1_id", "candidate_id")
    exact = _search(spark, d, 10).select("s1_id", "candidate_id")
    return exact.join(found.withColumn("hit", F.lit(1)), ["s1_id", "candidate_id"], "left").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


@query()
def quantized_topk(spark, d):
    """The search over eight-bit codes."""
    e = _vectors(spark, d).withColumn("group", F.lit(-1).cast("long")).withColumn("vector", F.transform(blocking.quantize(F.col("vector")), lambda x: x.cast("double") / 127))
    return blocking.dense_top_k(e.where("id % 50 = 0"), e, 20)


@query()
def latent_topk(spark, d):
    """Names as vectors of a fitted latent semantic encoder: entities with ids divisible by 50 against all."""
    names = records(spark, d).select(F.substring_index("entity_id", "-", -1).cast("long").alias("id"), "name")
    e = materialize(encode.encode(names, "name", encode.fit_latent(names, "name"), "id").withColumn("group", F.lit(-1).cast("long")))
    return rounded(blocking.dense_top_k(e.where("id % 50 = 0"), e, 20), "sim")


# sparse search over part names and types, and the documents' whole texts: rows with ids divisible by 50 against all others


def _sparse_sql(n: str, column: str, k: int, source: str = "part", key: str = "p_partkey") -> str:
    grams = """list_concat(list_transform(string_split(t, ' '), lambda w: CASE WHEN length(w) + 2 > 3 THEN list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3)) ELSE [' ' || w || ' '] END),
 list_transform(string_split(t, ' '), lambda w: CASE WHEN length(w) + 2 >= 4 THEN list_transform(range(1, length(w)), lambda i: substr(' ' || w || ' ', i, 4)) ELSE [] END))"""
    return f"""{n}_t AS (SELECT {key} AS id, lower({column}) AS t FROM {source}), {n}_g AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(flatten({grams})) AS term FROM {n}_t WHERE t <> '') GROUP BY 1, 2),
{n}_i AS (SELECT term, ln((1 + (SELECT count(*) FROM {n}_t)) / (1 + count(*))) + 1 AS idf FROM {n}_g GROUP BY 1),
{n}_w AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM {n}_g JOIN {n}_i USING (term)),
{n}_u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {n}_w),
{n}_s AS (SELECT x.id AS s1_id, y.id AS candidate_id, sum(x.w * y.w) AS sim FROM {n}_u x JOIN {n}_u y USING (term) WHERE x.id % 50 = 0 AND x.id <> y.id GROUP BY 1, 2),
{n} AS (SELECT s1_id, candidate_id, sim FROM {n}_s WHERE round(sim, 9) >= 0.12 QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY round(sim, 9) DESC, candidate_id) <= {k})"""


def _sparse(rows: DataFrame, k: int) -> DataFrame:
    return blocking.text_top_k(rows, F.col("entity_id") % 50 == 0, k)


def _tied(spark, d, column: str, k: int):
    return _sparse(table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.lower(F.expr(column)).alias("t")), k)


@query(f"""WITH r AS (SELECT doc_id, {CLEAN_SQL.format("coalesce(text, '')")} AS t FROM documents), {_sparse_sql('x', 't', 25, 'r', 'doc_id')}
SELECT s1_id, candidate_id, round(sim, 6) AS sim FROM x""")
def tfidf_topk_sentence(spark, d):
    """All sentences of a document are its record: documents with ids divisible by 50 against all."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), T.clean(F.col("text")).alias("t"))
    return rounded(_sparse(texts, 25), "sim")


@query(f"WITH {_sparse_sql('x', 'p_name', 25)} SELECT s1_id, candidate_id, round(sim, 6) AS sim FROM x")
def tfidf_topk_name(spark, d):
    return rounded(_tied(spark, d, "p_name", 25), "sim")


@query(f"""WITH {_sparse_sql('n', 'p_name', 25)}, {_sparse_sql('a', "p_type || ' ' || p_brand", 25)}, {_sparse_sql('c', "p_name || ' ' || p_type || ' ' || p_brand", 25)},
u AS (SELECT s1_id, candidate_id, sim AS nsim, NULL AS asim, NULL AS csim FROM n UNION ALL SELECT s1_id, candidate_id, NULL, sim, NULL FROM a UNION ALL SELECT s1_id, candidate_id, NULL, NULL, sim FROM c)
SELECT s1_id, candidate_id, round(coalesce(max(nsim), 0), 6) AS nsim, round(coalesce(max(asim), 0), 6) AS asim, round(coalesce(max(csim), 0), 6) AS csim FROM u GROUP BY 1, 2""")
def tfidf_three_route(spark, d):
    routes = {"nsim": "p_name", "asim": "p_type || ' ' || p_brand", "csim": "p_name || ' ' || p_type || ' ' || p_brand"}
    return rounded(blocking.merge_routes({n: _tied(spark, d, c, 25) for n, c in routes.items()}), *routes)


# key blocking

_TOK2 = f"array_to_string({TOKENS_SQL.format('name')}[1:2], ' ')"


def _keyed(spark, d):
    s1, t, truth = sides(spark, d)
    n, a = F.col("name"), F.col("address")
    with_keys = lambda x: x.withColumns({"k1": blocking.name_key(n), "k2": blocking.two_token_key(n), "k3": blocking.number_key(n, a)})
    return with_keys(s1), with_keys(t), truth


_KEYS_SQL = rf"""{SIDES_SQL}, keyed AS (SELECT 's' AS side, * FROM s1 UNION ALL SELECT 't', * FROM tg),
k0 AS (SELECT side, entity_id, name, CASE WHEN length(name) >= 2 THEN name END AS k1, CASE WHEN len({TOKENS_SQL.format('name')}) >= 2 THEN {_TOK2} END AS k2,
 CASE WHEN regexp_matches(address, '\b\d{{5,6}}\b') AND name <> '' THEN regexp_extract(address, '\b(\d{{5,6}})\b', 1) || '|' || split_part(name, ' ', 1) END AS k3 FROM keyed)"""


def _block_sql(n: int, cap: int) -> str:
    return f"""b{n} AS (SELECT s.entity_id AS s1_id, t.entity_id AS candidate_id, {n} AS route FROM k0 s JOIN (SELECT entity_id, k{n} FROM k0 WHERE side = 't' AND k{n} IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY k{n} ORDER BY entity_id) <= {cap}) t ON s.k{n} = t.k{n} WHERE s.side = 's')"""


@query(f"WITH {_KEYS_SQL}, {_block_sql(1, 15)} SELECT s1_id, candidate_id FROM b1")
def key_block_exact(spark, d):
    s1, t, _ = _keyed(spark, d)
    return blocking.key_block(s1, t, "k1", 15).drop("o")


@query(f"WITH {_KEYS_SQL}, {_block_sql(2, 10)} SELECT s1_id, candidate_id FROM b2")
def key_block_tok2(spark, d):
    s1, t, _ = _keyed(spark, d)
    return blocking.key_block(s1, t, "k2", 10).drop("o")


@query("""WITH k AS (SELECT p_partkey AS id, (10000 + p_size) || '|' || split_part(lower(p_name), ' ', 1) AS k FROM part),
t AS (SELECT id, k FROM k WHERE id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY id) <= 5) SELECT s.id AS s1_id, t.id AS candidate_id FROM k s JOIN t USING (k) WHERE s.id % 2 = 0""")
def key_block_geo(spark, d):
    """Parts as records: their names, and an address that holds a number of five digits."""
    address = F.concat_ws(" ", F.lit("Lot"), F.col("p_size") + 10_000, "p_brand")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), blocking.number_key(F.lower("p_name"), address).alias("k3"))
    return blocking.key_block(p.where("entity_id % 2 = 0"), p.where("entity_id % 2 = 1"), "k3", 5).drop("o")


_MULTI_SQL = f"""{_KEYS_SQL}, {_block_sql(1, 15)}, {_block_sql(2, 10)}, {_block_sql(3, 5)}, u AS (SELECT s1_id, candidate_id, min(route) AS route FROM (FROM b1 UNION ALL FROM b2 UNION ALL FROM b3) GROUP BY 1, 2),
multi AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY route, candidate_id) <= 25)"""


def _multi(spark, d):
    s1, t, truth = _keyed(spark, d)
    return blocking.multi_key(s1, t, [("k1", 15), ("k2", 10), ("k3", 5)], 25)


@query(f"WITH {_MULTI_SQL} SELECT s1_id, candidate_id, route, CASE WHEN x.name = y.name THEN 1.0 ELSE 0.8 END AS sim_name, 0.5 AS sim_addr FROM multi JOIN s1 x ON x.entity_id = s1_id JOIN tg y ON y.entity_id = candidate_id")
def multikey_union_cap(spark, d):
    s1, t, _ = sides(spark, d)
    return blocking.synthetic_similarity(_multi(spark, d), s1.select("entity_id", "name").union(t.select("entity_id", "name")))


def _true_pairs(spark, d):
    s1, t, truth = sides(spark, d)
    long = truth.select("s1_id", F.explode("matches").alias("candidate_id"))
    own = lambda x, i, n: x.select(F.col("entity_id").alias(i), F.col("name").alias(f"n{n}"), F.col("address").alias(f"a{n}"))
    return long.join(own(s1, "s1_id", 1), "s1_id").join(own(t, "candidate_id", 2), "candidate_id")


@query(f"""WITH {SIDES_SQL}, p AS (SELECT {TOKENS_SQL.format('x.name')} AS n1, {TOKENS_SQL.format('y.name')} AS n2, {TOKENS_SQL.format('x.address')} AS a1, {TOKENS_SQL.format('y.address')} AS a2, x.name AS x, y.name AS y
 FROM tp JOIN s1 x ON x.entity_id = s1_id JOIN tg y ON y.entity_id = candidate_id), f AS (SELECT x = y AND x <> '' AS e, len(n1) >= 2 AND n1[1:2] = n2[1:2] AS t2, coalesce(n1[1] = n2[1], false) AS t1, len(list_intersect(n1, n2)) > 0 AS s, len(list_intersect(a1, a2)) >= 2 AS a FROM p)
SELECT count(*) AS n_pairs, round(avg(CAST(e AS DOUBLE)), 6) AS exact, round(avg(CAST(t2 AS DOUBLE)), 6) AS first_two, round(avg(CAST(t1 AS DOUBLE)), 6) AS first_one, round(avg(CAST(s AS DOUBLE)), 6) AS any_token, round(avg(CAST(s AND a AS DOUBLE)), 6) AS name_and_address FROM f""")
def block_overlap_audit(spark, d):
    return rounded(blocking.overlap_audit(_true_pairs(spark, d)), "exact", "first_two", "first_one", "any_token", "name_and_address")


@query(f"""WITH {PAIRS_SQL}, c AS (SELECT tn.s1_id, count(DISTINCT candidate_id) AS n FROM tn LEFT JOIN pairs USING (s1_id) GROUP BY 1),
a AS (SELECT count(*) AS n_s1, sum(n) AS n_candidates, count(*) FILTER (WHERE n > 0) AS s1_with_candidates, avg(n) AS mean_candidates, quantile_cont(n, 0.5) AS median_candidates, quantile_cont(n, 0.95) AS p95_candidates, max(n) AS max_candidates FROM c),
b AS (SELECT count(*) AS true_pairs, count(p.s1_id) AS found_pairs FROM tp LEFT JOIN (SELECT DISTINCT s1_id, candidate_id FROM pairs) p USING (s1_id, candidate_id))
SELECT n_s1, CAST(n_candidates AS BIGINT) AS n_candidates, s1_with_candidates, round(mean_candidates, 6) AS mean_candidates, round(median_candidates, 6) AS median_candidates, round(p95_candidates, 6) AS p95_candidates, max_candidates, true_pairs, found_pairs,
 round(CASE WHEN true_pairs = 0 THEN 1.0 ELSE found_pairs / true_pairs END, 6) AS pair_completeness, round(1 - n_candidates / (n_s1 * (SELECT count(*) FROM tg)), 6) AS reduction_ratio, (CASE WHEN true_pairs = 0 THEN 1.0 ELSE found_pairs / true_pairs END) >= 0.95 AS gate_passed FROM a, b""")
def blocking_metrics(spark, d):
    s1, t, truth = sides(spark, d)
    m = metrics.blocking(truth, pairs(spark, d), t.count())
    return rounded(m, "mean_candidates", "median_candidates", "p95_candidates", "pair_completeness", "reduction_ratio")


# features


def _dense_inputs(spark, d):
    from kindred.operators.normalize import normalize_records

    s1, t, truth = sides(spark, d)
    raw = normalize_records(_raw(spark, d)).withColumn("n", F.substring_index("entity_id", "-", -1)).drop("entity_id")
    own = lambda x: x.select("entity_id", F.substring_index("entity_id", "-", -1).alias("n")).join(raw, "n").drop("n")
    p = scored(spark, d).select("s1_id", "candidate_id", "sim_name", "sim_addr", F.lit(1).alias("route_name"), (F.col("sim_addr") > 0).cast("int").alias("route_addr"))
    return p, own(s1), own(t), truth


@query()
def features_trackc(spark, d):
    ship(spark)
    return features.dense_features(*_dense_inputs(spark, d))


@query()
def features_a(spark, d):
    from kindred.operators.normalize import normalize_sparse

    ship(spark)
    s1, t, truth = sides(spark, d)
    raw = normalize_sparse(_raw(spark, d)).withColumn("n", F.substring_index("entity_id", "-", -1)).drop("entity_id")
    own = lambda x: x.select("entity_id", F.substring_index("entity_id", "-", -1).alias("n")).join(raw, "n").drop("n")
    p = scored(spark, d).select("s1_id", "candidate_id", F.col("sim_name").alias("nsim"), F.col("sim_addr").alias("asim"), F.col("score").alias("csim"))
    return features.sparse_features(p, own(s1), own(t), truth)


@query(f"""WITH {SCORED_SQL} SELECT s1_id, candidate_id, round(max(score) OVER (PARTITION BY s1_id) - score, 6) AS gap_to_top, rank() OVER (PARTITION BY s1_id ORDER BY score DESC) AS cand_rank, count(*) OVER (PARTITION BY s1_id) AS n_candidates FROM scored""")
def ctx_rank_gap(spark, d):
    return rounded(features.context(scored(spark, d).select("s1_id", "candidate_id", "score"), "score").drop("score"), "gap_to_top")


@query(f"""WITH {SCORED_SQL}, w AS (SELECT s1_id, candidate_id, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, candidate_id) AS rank_in_cand, round(max(score) OVER (PARTITION BY s1_id) - score, 6) AS gap_to_top, count(*) OVER (PARTITION BY s1_id) AS n_cand_for_entity,
 row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, s1_id) AS reverse_rank FROM scored) SELECT *, CAST(rank_in_cand = 1 AND reverse_rank = 1 AS INT) AS mutual_top1 FROM w""")
def mutual_top1(spark, d):
    return rounded(features.mutual(scored(spark, d).select("s1_id", "candidate_id", "score"), "score").drop("score"), "gap_to_top")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_name) AS freq FROM part")
def value_freq(spark, d):
    return features.value_frequency(table(spark, d, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "freq")


@query(f"WITH {SIDES_SQL}, r AS (SELECT unnest(list_distinct({TOKENS_SQL.format('name')})) AS token FROM r0) SELECT token, count(*) AS df, round(ln((1 + (SELECT count(*) FROM r0)) / (1 + count(*))) + 1, 6) AS idf FROM r GROUP BY 1")
def token_idf(spark, d):
    from kindred.plans.binding import records

    return rounded(features.token_weights(records(spark, d), "name"), "idf")


@query(f"""WITH {SIDES_SQL}, r AS (SELECT unnest({TOKENS_SQL.format('name')}) AS token FROM r0) SELECT CASE WHEN regexp_full_match(token, '\\d{{5,6}}') THEN 'postal' WHEN regexp_full_match(token, '\\d+') THEN 'numeric' WHEN regexp_matches(token, '\\d') THEN 'alphanumeric' ELSE 'word' END AS kind, count(*) AS n FROM r GROUP BY 1""")
def token_kinds(spark, d):
    from kindred.plans.binding import records

    return records(spark, d).select(F.explode(T.tokens(F.col("name"))).alias("t")).groupBy(features.token_kind(F.col("t")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# windows and aggregates over the facts


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey) AS orders FROM orders GROUP BY 1")
def group_collect(spark, d):
    o = table(spark, d, "orders")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey")))
    return o.groupBy("o_custkey").agg(F.array_join(F.transform(rows, lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def topk_group(spark, d):
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice").withColumn("r", rank).where("r <= 3").drop("r")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def keep_first(spark, d):
    best = F.min(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey", "o_totalprice")).alias("x")
    return table(spark, d, "orders").groupBy("o_custkey").agg(best).select("o_custkey", "x.o_orderkey", "x.o_totalprice")


# models


def _training(spark, d):
    p = features.context(scored(spark, d), "score")
    return model.group_folds(p.select("s1_id", "candidate_id", "sim_addr", "gap_to_top", "cand_rank", "n_candidates", "label"), k=2)


_TRAINING_FEATURES = ["sim_addr", "gap_to_top", "cand_rank", "n_candidates"]


@query(f"""WITH {SIDES_SQL}, f AS (SELECT s1_id, CASE WHEN n_true = 0 THEN '0' WHEN n_true <= 2 THEN '1-2' WHEN n_true <= 5 THEN '3-5' ELSE '6+' END AS stratum FROM tn)
SELECT s1_id, stratum, CAST((row_number() OVER (PARTITION BY stratum ORDER BY md5(s1_id || '|42'), s1_id) - 1) % 5 AS INT) AS fold FROM f""")
def fold_assign(spark, d):
    return model.stratified_folds(sides(spark, d)[2])


@query()
def gbt_oof_summary(spark, d):
    """Out-of-fold log loss and AUC of boosted trees."""
    out, _ = model.out_of_fold(_training(spark, d), _TRAINING_FEATURES, 2, trees=10)
    out = materialize(out.select("score", "label"))
    return metrics.log_loss(out).crossJoin(metrics.auc(out))


@query()
def booster_comparison(spark, d):
    """Boosted trees of two depths and a random forest, out of fold."""
    settings = {"depth 3": {"depth": 3, "trees": 10}, "depth 5": {"depth": 5, "trees": 10}, "forest": {"learner": "forest", "trees": 10}}
    return model.compare(_training(spark, d), _TRAINING_FEATURES, settings)


@query(f"""WITH {SCORED_SQL}, g AS (SELECT score, count(*) AS w, sum(label) AS s FROM scored GROUP BY 1), c AS (SELECT score, row_number() OVER o AS i, w, s, sum(w) OVER o AS cw, sum(s) OVER o AS cs FROM g WINDOW o AS (ORDER BY score)),
b AS (SELECT x.i AS i, a.i AS a, min((e.cs - a.cs + a.s) / (e.cw - a.cw + a.w)) AS least FROM c x JOIN c a ON a.i <= x.i JOIN c e ON e.i >= x.i GROUP BY 1, 2),
v AS (SELECT i, max(least) AS v FROM b GROUP BY 1) SELECT s1_id, candidate_id, score, round(v, 6) AS calibrated FROM scored JOIN c USING (score) JOIN v USING (i)""")
def isotonic_calibrate(spark, d):
    rows = scored(spark, d).select("s1_id", "candidate_id", "score", "label")
    fitted = model.calibrate(rows)
    return rounded(fitted.transform(rows.withColumn("x", F.col("score").cast("double"))).select("s1_id", "candidate_id", "score", "calibrated"), "calibrated")


@query(f"""WITH {SCORED_SQL}, p AS (SELECT label, ln(x / (1 - x)) AS z FROM (SELECT label, greatest(0.000001::DOUBLE, least(0.999999::DOUBLE, score::DOUBLE)) AS x FROM scored)),
t AS (SELECT i, pow(10::DOUBLE, 2 * i / 60.0::DOUBLE - 1) AS t FROM (SELECT unnest(range(0, 61)) AS i)),
l AS (SELECT i, t, avg(ln(1 + exp(-(CASE WHEN label = 1 THEN z ELSE -z END) / t))) AS loss FROM p CROSS JOIN t GROUP BY 1, 2) SELECT round(t, 6) AS temperature FROM l ORDER BY loss, t LIMIT 1""")
def temperature_scaling(spark, d):
    rows = scored(spark, d).select("score", "label")
    return rounded(spark.createDataFrame([(model.temperature(rows),)], "temperature double"), "temperature")


_LEVELS = "SELECT CAST(sim_addr >= 0.5 AS INT) AS addr, CAST(house <> '' AS INT) AS house, label FROM scored"


def _levels(spark, d):
    return scored(spark, d).select((F.col("sim_addr") >= 0.5).cast("int").alias("addr"), (F.col("house") != "").cast("int").alias("house"), "label")


@query(f"""WITH {SCORED_SQL}, l AS ({_LEVELS}), g AS (SELECT 'addr' AS field, CAST(addr AS VARCHAR) AS level, label FROM l UNION ALL SELECT 'house', CAST(house AS VARCHAR), label FROM l),
n AS (SELECT field, level, sum(label) AS a, sum(1 - label) AS b FROM g GROUP BY 1, 2), p AS (SELECT field, level, (a + 0.5) / (sum(a) OVER w + 0.5 * count(*) OVER w) AS m, (b + 0.5) / (sum(b) OVER w + 0.5 * count(*) OVER w) AS u FROM n WINDOW w AS (PARTITION BY field))
SELECT field, level, round(m, 6) AS m, round(u, 6) AS u, round(log2(m / u), 6) AS weight FROM p""")
def linkage_weights(spark, d):
    return rounded(model.linkage_weights(_levels(spark, d), ["addr", "house"]), "m", "u", "weight")


@query()
def linkage_em(spark, d):
    share, mu = model.linkage_em(_levels(spark, d), ["addr", "house"])
    return spark.createDataFrame([(f, share, m, u) for f, (m, u) in mu.items()], "field string, share double, m double, u double")


# rerank, conflicts, exclusivity


@query(f"""WITH {SCORED_SQL} SELECT count(*) AS n_pairs, count(*) FILTER (WHERE score BETWEEN 0.65 AND 0.85) AS n_band, round(100.0 * count(*) FILTER (WHERE score BETWEEN 0.65 AND 0.85) / count(*), 6) AS pct_band,
 round(count(*) FILTER (WHERE score BETWEEN 0.65 AND 0.85) / 1500 / 3600, 9) AS est_hours, count(*) FILTER (WHERE score BETWEEN 0.65 AND 0.85) / 1500 / 3600 <= 3 AS feasible FROM scored""")
def band_audit(spark, d):
    return decide.band_audit(scored(spark, d))


@query(f"WITH {SCORED_SQL} SELECT s1_id, candidate_id, CAST(score BETWEEN 0.65 AND 0.85 AS INT) AS reranked_by_D, round(CASE WHEN score BETWEEN 0.65 AND 0.85 THEN 0.5 * score + 0.5 / (1 + exp(-(4 * sim_addr - 2))) ELSE score END, 6) AS score FROM scored")
def rerank_blend(spark, d):
    out = decide.rerank(scored(spark, d), 4 * F.col("sim_addr") - 2, logits=True)
    return rounded(out.select("s1_id", "candidate_id", "reranked_by_D", "score"), "score")


def _token_jaccard(left: list[str], right: list[str]) -> list[float]:
    both = [(set(a.split()), set(b.split())) for a, b in zip(left, right, strict=True)]
    return [len(a & b) / len(a | b) if a and b else 0.0 for a, b in both]


@query(f"""WITH {SCORED_SQL}, j AS (SELECT pairs.s1_id, pairs.candidate_id, {jaccard_sql(TOKENS_SQL.format("a1"), TOKENS_SQL.format("a2"))} AS p FROM pairs)
SELECT s1_id, candidate_id, CAST(score BETWEEN 0.65 AND 0.85 AS INT) AS reranked_by_D, round(CASE WHEN score BETWEEN 0.65 AND 0.85 THEN 0.5 * score + 0.5 * p ELSE score END, 6) AS score FROM scored JOIN j USING (s1_id, candidate_id)""")
def gated_rerank(spark, d):
    """A pair scorer over Arrow batches, here the Jaccard of address tokens, for the pairs in the band."""
    s1, t, _ = sides(spark, d)
    text = lambda x: x.select("entity_id", F.col("address").alias("text"))
    out = encode.gated_rerank(scored(spark, d), text(s1), text(t), _token_jaccard)
    return rounded(out.select("s1_id", "candidate_id", "reranked_by_D", "score"), "score")


_OWNER_SQL = "owner AS (SELECT candidate_id, s1_id AS owner FROM scored QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, s1_id) = 1)"


@query(f"WITH {SCORED_SQL}, {_OWNER_SQL}, e AS (SELECT s1_id, bool_and(owner = s1_id) AS agrees FROM scored JOIN owner USING (candidate_id) WHERE score >= 0.75 GROUP BY 1) SELECT count(*) AS n_entities, round(avg(CAST(agrees AS DOUBLE)), 9) AS agreement, avg(CAST(agrees AS DOUBLE)) >= 0.97 AS skip_clustering FROM e")
def cluster_precheck(spark, d):
    return decide.cluster_precheck(scored(spark, d), 0.75)


@query(f"""WITH {SCORED_SQL}, b AS (SELECT *, first_value(candidate_id) OVER w AS bc, first_value(score) OVER w AS bs, first_value(house) OVER w AS bh, first_value(state) OVER w AS bst FROM scored WINDOW w AS (PARTITION BY s1_id ORDER BY score DESC, candidate_id))
SELECT s1_id, candidate_id, CAST(candidate_id <> bc AND ((coalesce(house, '') <> '' AND coalesce(bh, '') <> '' AND house <> bh) OR (coalesce(state, '') <> '' AND coalesce(bst, '') <> '' AND state <> bst)) AND round(bs - score, 9) >= 0.15 AS INT) AS conflict_dropped FROM b""")
def conflict_rule(spark, d):
    return decide.conflict_rule(scored(spark, d)).select("s1_id", "candidate_id", "conflict_dropped")


@query(f"WITH {SCORED_SQL} SELECT s1_id, candidate_id, score FROM scored QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, s1_id) = 1")
def exclusivity(spark, d):
    return decide.exclusive(scored(spark, d).select("s1_id", "candidate_id", "score"))


@query(f"WITH {SCORED_SQL}, c AS (SELECT s1_id, candidate_id, score, row_number() OVER w AS claim, lead(score) OVER w AS nxt FROM scored WINDOW w AS (PARTITION BY candidate_id ORDER BY score DESC, s1_id)) SELECT s1_id, candidate_id, score FROM c WHERE claim = 1 AND (nxt IS NULL OR score - nxt >= 0.1)")
def exclusivity_margin(spark, d):
    return decide.exclusive(scored(spark, d).select("s1_id", "candidate_id", "score"), 0.1)


@query(f"""WITH {SCORED_SQL}, m AS (SELECT s1_id, candidate_id, score FROM scored WHERE score >= 0.95) SELECT s1_id, candidate_id, score FROM m
UNION ALL SELECT s1_id, candidate_id, CAST(sim_name AS DOUBLE) FROM scored WHERE (sim_name >= 0.88 AND sim_addr >= 0.8) AND s1_id IN (SELECT s1_id FROM m) AND (s1_id, candidate_id) NOT IN (SELECT (s1_id, candidate_id) FROM m)""")
def sibling_expand(spark, d):
    s = scored(spark, d)
    return decide.expand(decide.single_threshold(s, 0.95), s)


@query(f"""WITH {SCORED_SQL}, {_MULTI_SQL.replace(SIDES_SQL + ', ', '')} SELECT s1_id, candidate_id, max(score) AS score FROM (SELECT s1_id, candidate_id, score FROM scored UNION ALL SELECT s1_id, candidate_id, 0.7 FROM multi) GROUP BY 1, 2""")
def union_pools(spark, d):
    return decide.union_best([scored(spark, d).select("s1_id", "candidate_id", "score"), _multi(spark, d).select("s1_id", "candidate_id", F.lit(0.7).alias("score"))])


# decisions

_RANKED_SQL = f"WITH {SCORED_SQL}, rk AS (SELECT s1_id, candidate_id, score, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, candidate_id) AS rn, max(score) OVER (PARTITION BY s1_id) AS top FROM scored) SELECT s1_id, candidate_id, score FROM rk "


@query(_RANKED_SQL + "WHERE top >= 0.6 AND (rn = 1 OR score >= 0.575)")
def two_threshold(spark, d):
    return decide.two_thresholds(scored(spark, d))


@query(_RANKED_SQL + "WHERE top >= 0.58 AND (rn = 1 OR (score >= 0.42 AND score >= 0.55 * top))")
def two_threshold_margin(spark, d):
    return decide.two_thresholds(scored(spark, d), 0.58, 0.42, margin=0.55)


@query(_RANKED_SQL + "WHERE top >= 0.6 AND (rn = 1 OR score >= 0.575) AND rn <= 4")
def two_threshold_cap(spark, d):
    return decide.two_thresholds(scored(spark, d), runners_up=3)


@query(f"WITH {SCORED_SQL}, rk AS (SELECT s1_id, candidate_id, score, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, candidate_id) AS rn FROM scored), l AS (SELECT s1_id, max(score) FILTER (WHERE rn = 1) - coalesce(max(score) FILTER (WHERE rn = 2), -1.0) AS lead FROM rk GROUP BY 1) SELECT s1_id, candidate_id, score FROM rk JOIN l USING (s1_id) WHERE lead >= 0.05")
def clear_winner(spark, d):
    return decide.clear_winners(scored(spark, d), 0.05)


@query(f"WITH {SCORED_SQL} SELECT s1_id, candidate_id, round(score, 6) AS score FROM scored WHERE score >= 0.75")
def single_threshold(spark, d):
    return rounded(decide.single_threshold(scored(spark, d), 0.75).select("s1_id", "candidate_id", "score"), "score")


_COUNTRY_SQL = "CASE WHEN c_custkey % 10 = 0 THEN 'UNKNOWN' ELSE CAST(c_nationkey AS STRING) END"


@query(f"""SELECT l_orderkey, l_linenumber, c1, c2 FROM (SELECT l_orderkey, l_linenumber, {_COUNTRY_SQL} AS c1, CAST(s_nationkey AS STRING) AS c2
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey) WHERE c1 = c2 OR c1 = 'UNKNOWN'""")
def country_filter(spark, d):
    """Customers of unknown country keep their suppliers of any."""
    met = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    met = met.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return blocking.country_filter(met.select("l_orderkey", "l_linenumber", F.expr(_COUNTRY_SQL).alias("c1"), F.col("s_nationkey").cast("string").alias("c2")))


@query()
def coarse_to_fine(spark, d):
    """Thresholds in thousandths and their macro F0.5."""
    return spark.createDataFrame([decide.coarse_to_fine(scored(spark, d), sides(spark, d)[2])], "t_first int, t_rest int, macro_f05 double")


_GRID = decide.grid(range(500, 951, 50), range(500, 951, 50))
_GRID_SQL = f"""WITH {SCORED_SQL}, rk AS (SELECT s1_id, candidate_id, label, floor(score * 1000 + 1e-9) AS m, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, candidate_id) AS rn, max(floor(score * 1000 + 1e-9)) OVER (PARTITION BY s1_id) AS top FROM scored),
g AS (SELECT unnest([{", ".join(f"{{'a': {a}, 'b': {b}}}" for a, b in _GRID)}]) AS g), p AS (SELECT g.a AS a, g.b AS b, s1_id, count(*) AS n_pred, sum(label) AS tp FROM g JOIN rk ON top >= g.a AND (rn = 1 OR m >= g.b) GROUP BY 1, 2, 3),
f AS (SELECT g.a AS t_first, g.b AS t_rest, CASE WHEN n_true = 0 THEN CASE WHEN n_pred IS NULL THEN 1.0 ELSE 0.0 END WHEN coalesce(tp, 0) = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * n_true + n_pred) END AS f FROM g CROSS JOIN tn LEFT JOIN p ON p.a = g.a AND p.b = g.b AND p.s1_id = tn.s1_id)"""


@query(f"{_GRID_SQL} SELECT t_first, t_rest, round(avg(f), 6) AS macro_f05 FROM f GROUP BY 1, 2")
def grid_search(spark, d):
    return rounded(decide.grid_search(scored(spark, d), sides(spark, d)[2], _GRID), "macro_f05")


@query(f"{_GRID_SQL} SELECT t_first, t_rest, round(avg(f), 6) AS macro_f05 FROM f GROUP BY 1, 2 ORDER BY round(avg(f), 12) DESC, t_first, t_rest LIMIT 1")
def best_threshold(spark, d):
    return rounded(decide.best_thresholds(decide.grid_search(scored(spark, d), sides(spark, d)[2], _GRID)), "macro_f05")


@query(SINGLE_SQL + "SELECT s1_id, n_true, n_pred, tp, round(f05, 6) AS f05 FROM entities")
def entity_f05(spark, d):
    return rounded(_entities(spark, d), "f05")


@query(SINGLE_SQL + "SELECT CASE WHEN n_true = 0 THEN '0' WHEN n_true <= 2 THEN '1-2' WHEN n_true <= 5 THEN '3-5' WHEN n_true <= 20 THEN '6-20' ELSE '21+' END AS cardinality, count(*) AS n_entities, round(avg(f05), 6) AS mean_f05 FROM entities GROUP BY 1")
def cardinality_breakdown(spark, d):
    return rounded(metrics.by_cardinality(_entities(spark, d)), "mean_f05")


@query(SINGLE_SQL + "SELECT round(avg(CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END) FILTER (WHERE n_true > 0), 6) AS macro_precision, round(avg(tp / n_true) FILTER (WHERE n_true > 0), 6) AS macro_recall, round(avg(CAST(n_pred = 0 AS DOUBLE)) FILTER (WHERE n_true = 0), 6) AS singleton_accuracy FROM entities")
def precision_recall(spark, d):
    return rounded(metrics.precision_recall(_entities(spark, d)), "macro_precision", "macro_recall", "singleton_accuracy")


@query(SINGLE_SQL + "SELECT CAST(sum(n_pred - tp) AS BIGINT) AS false_positives, CAST(sum(n_true - tp) AS BIGINT) AS false_negatives, count(*) FILTER (WHERE n_pred > tp) AS entities_with_fp, count(*) FILTER (WHERE n_true > tp) AS entities_with_fn, count(*) FILTER (WHERE n_true = 0 AND n_pred > 0) AS singleton_fp, count(*) FILTER (WHERE n_true > 0 AND n_pred = 0) AS missed FROM entities")
def error_analysis(spark, d):
    return metrics.errors(_entities(spark, d))


@query(SINGLE_SQL + "SELECT s1_id, n_true, n_pred, tp, round(f05, 6) AS f05 FROM entities ORDER BY n_pred + n_true - 2 * tp DESC, s1_id LIMIT 10")
def worst_entities(spark, d):
    return rounded(metrics.worst(_entities(spark, d)), "f05")


@query(f"WITH {SCORED_SQL} SELECT CAST(least(floor(score * 10 + 1e-9), 9) AS INT) AS bin, count(*) AS n FROM scored GROUP BY 1")
def score_histogram(spark, d):
    return metrics.score_histogram(scored(spark, d))


@query(f"WITH {SCORED_SQL} SELECT label, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.9), 6) AS p90 FROM scored GROUP BY 1")
def score_distribution(spark, d):
    return rounded(metrics.score_distribution(scored(spark, d)), "mean", "median", "p10", "p90")


@query(f"WITH {SCORED_SQL} SELECT round(avg(-CASE WHEN label = 1 THEN ln(greatest(1e-15, least(1 - 1e-15, score))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, score))) END), 6) AS log_loss FROM scored")
def log_loss(spark, d):
    return rounded(metrics.log_loss(scored(spark, d)), "log_loss")


@query(f"WITH {SCORED_SQL}, c AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY 1), w AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM w")
def roc_auc(spark, d):
    return rounded(metrics.auc(scored(spark, d)), "auc")


@query(f"WITH {SCORED_SQL} SELECT s1_id, candidate_id, round(sum(s) / 3.0, 6) AS score FROM (SELECT s1_id, candidate_id, 2.0 * score AS s FROM scored UNION ALL SELECT s1_id, candidate_id, sim_addr FROM scored WHERE sim_addr > 0) GROUP BY 1, 2")
def score_ensemble(spark, d):
    s = scored(spark, d)
    other = s.where("sim_addr > 0").select("s1_id", "candidate_id", F.col("sim_addr").alias("score"))
    return rounded(decide.ensemble([s, other], [2.0, 1.0]), "score")


# validation


def _lists(spark, d):
    p = decide.two_thresholds(scored(spark, d))
    return p.groupBy("s1_id").agg(F.sort_array(F.collect_list("candidate_id")).alias("ids"))


@query("SELECT o_custkey AS s1_id, len(list(o_orderstatus)) <> len(list_distinct(list(o_orderstatus))) AS duplicate_id FROM orders GROUP BY 1")
def validate_lists(spark, d):
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("s1_id")).agg(F.collect_list("o_orderstatus").alias("ids"))
    return validate.list_problems(lists).select("s1_id", "duplicate_id")


@query(f"WITH {SCORED_SQL}, l AS (SELECT DISTINCT s1_id FROM scored WHERE score >= 0.6) SELECT entity_id AS s1_id FROM s1 WHERE entity_id NOT IN (SELECT s1_id FROM l)")
def missing_entities(spark, d):
    s1, _, _ = sides(spark, d)
    return s1.select(F.col("entity_id").alias("s1_id")).join(_lists(spark, d), "s1_id", "left_anti")


@query(f"WITH {SCORED_SQL}, {_MULTI_SQL.replace(SIDES_SQL + ', ', '')}, x AS (SELECT s1_id, candidate_id FROM multi WHERE (s1_id, candidate_id) NOT IN (SELECT (s1_id, candidate_id) FROM scored)) SELECT s1_id, string_agg(candidate_id, ',' ORDER BY candidate_id) AS extra FROM x GROUP BY 1")
def subset_check(spark, d):
    of = lambda p: p.groupBy("s1_id").agg(F.sort_array(F.collect_list("candidate_id")).alias("ids"))
    out = validate.not_candidates(of(_multi(spark, d)), of(scored(spark, d)))
    return out.select("s1_id", F.array_join("extra", ",").alias("extra"))


@query()
def validate_report(spark, d):
    """All list checks of the decided matches; entities without a match are reported as missing."""
    s1, t, _ = sides(spark, d)
    return validate.check_lists(materialize(_lists(spark, d)), s1.select(F.col("entity_id").alias("s1_id")), t.select("entity_id"))


# graph, sampling, further blocking


@query(f"""WITH RECURSIVE {PAIRS_SQL}, e AS (SELECT DISTINCT least(n, m) AS a, greatest(n, m) AS b FROM (SELECT CAST(substr(s1_id, 4) AS BIGINT) AS n, CAST(substr(candidate_id, 4) AS BIGINT) AS m FROM pairs)), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
c(node, root) AS (SELECT DISTINCT x, x FROM u UNION SELECT u.y, c.root FROM c JOIN u ON u.x = c.node WHERE c.root < u.y) SELECT node, min(root) AS component FROM c GROUP BY 1""")
def linked_components(spark, d):
    p = pairs(spark, d)
    n = lambda c: F.substring_index(c, "-", -1).cast("long")
    return components.connected_components(p.select(n("s1_id").alias("a"), n("candidate_id").alias("b")))


@query(f"""WITH {SIDES_SQL}, picked AS (SELECT entity_id FROM s1 ORDER BY md5(entity_id || '|42'), entity_id LIMIT 50), ids AS (SELECT DISTINCT candidate_id AS entity_id FROM tp JOIN picked ON tp.s1_id = picked.entity_id),
rest AS (SELECT entity_id FROM tg ANTI JOIN ids USING (entity_id) ORDER BY md5(entity_id || '|42'), entity_id LIMIT 250)
SELECT entity_id, 's1' AS side FROM picked UNION ALL SELECT entity_id, 'target' FROM ids UNION ALL SELECT entity_id, 'target' FROM rest""")
def semi_join_sample(spark, d):
    from kindred.sources.tables import semi_join_sample as sample

    s1, t, truth = sides(spark, d)
    some, kept = sample(s1, t, truth, 50)
    return some.select("entity_id", F.lit("s1").alias("side")).unionByName(kept.select("entity_id", F.lit("target").alias("side")))


@query()
def minhash_blocking(spark, d):
    names = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity_id"))
    return blocking.min_hash_pairs(names)


@query("""WITH r AS (SELECT p_partkey, p_brand, p_name FROM part), w AS (SELECT p_partkey AS a, unnest([lead(p_partkey, 1) OVER o, lead(p_partkey, 2) OVER o, lead(p_partkey, 3) OVER o]) AS b FROM r WINDOW o AS (PARTITION BY p_brand ORDER BY p_name, p_partkey)) SELECT a, b FROM w WHERE b IS NOT NULL""")
def sorted_neighbourhood(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("country"), F.col("p_name").alias("key"))
    return blocking.sorted_neighbourhood(rows, 3)


@query("""WITH t AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 5 = 0 THEN '__unknown__' ELSE 'n' || c_nationkey END AS c, c_custkey % 3 = 0 AS s FROM customer)
SELECT 's1' AS side, id AS entity_id, CASE WHEN c = '__unknown__' THEN '*' ELSE c END AS bucket FROM t WHERE s UNION ALL SELECT 'target', id, c FROM t WHERE NOT s AND c <> '__unknown__'
UNION ALL SELECT 'target', id, b.c FROM t, (SELECT DISTINCT c FROM t WHERE s AND c <> '__unknown__') b WHERE NOT s AND t.c = '__unknown__' UNION ALL SELECT 'target', id, '*' FROM t WHERE NOT s""")
def country_buckets(spark, d):
    c = F.when(F.col("c_nationkey") % 5 == 0, "__unknown__").otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), c.alias("country_norm"))
    return blocking.country_buckets(t.where("entity_id % 3 = 0"), t.where("entity_id % 3 <> 0"))
