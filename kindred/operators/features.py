"""Features of candidate pairs, for the dense track (19) and the sparse track (38).

What depends on one record is made once for each record, before the pair joins; only comparisons are made for each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.functions import similarity as S
from kindred.functions.text import tokens
from kindred.sources.storage import ship

DENSE = [
    "name_sim", "addr_sim", "route_name", "route_addr", "route_both", "jw_sim", "name_jaccard", "name_exact", "name_len_diff", "first_token_eq",
    "house_match", "state_match", "addr_jaccard", "is_source2", "sim_product", "sim_max", "gap_to_top", "cand_rank", "n_candidates",
]
SPARSE = [
    "nsim", "asim", "csim", "max_sim",
    "name_jaccard_tok", "name_overlap", "name_jac3", "name_jac4",
    "addr_jaccard_tok", "addr_overlap", "addr_jac3", "addr_num_overlap",
    "dba_trade_jaccard",
    "name_exact", "name_len_diff", "name_len_ratio", "name_tok_diff", "name_first_tok",
    "addr_missing", "addr_len_ratio",
    "country_match", "country_mismatch", "src_is_s2", "name_x_addr",
    "name_wratio", "name_tsort", "name_tset", "name_partial", "name_lev_norm", "addr_tsort", "addr_tset",
    "rank_in_cand", "gap_to_top", "n_cand_for_entity", "reverse_rank", "mutual_top1",
    "name_freq_s1", "addr_freq_s1",
]


def _sides(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs with the two records as structs x and y."""
    of = lambda rows, i, n: rows.select(F.col("entity_id").alias(i), F.struct("*").alias(n))
    return pairs.join(of(s1, "s1_id", "x"), "s1_id").join(of(targets, "candidate_id", "y"), "candidate_id")


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds label: 1 where the candidate is among the entity's true matches."""
    true = truth.select("s1_id", F.explode(F.array_distinct("matches")).alias("candidate_id")).withColumn("__hit", F.lit(1))
    return pairs.join(true, ["s1_id", "candidate_id"], "left").withColumn("label", F.coalesce("__hit", F.lit(0))).drop("__hit")


def context(pairs: DataFrame, sim: str) -> DataFrame:
    """gap_to_top, cand_rank (equals share a rank) and n_candidates of each pair among its entity's, by one sort."""
    by = Window.partitionBy("s1_id")
    return pairs.withColumns(
        {
            "gap_to_top": F.max(sim).over(by) - F.col(sim),
            "cand_rank": F.rank().over(by.orderBy(F.desc(sim))),
            "n_candidates": F.count(F.lit(1)).over(by),
        }
    )


def mutual(pairs: DataFrame, sim: str) -> DataFrame:
    """rank_in_cand, gap_to_top, n_cand_for_entity, reverse_rank and mutual_top1; ranks are row numbers with ties by id."""
    by = Window.partitionBy("s1_id")
    rows = pairs.withColumns(
        {
            "rank_in_cand": F.row_number().over(by.orderBy(F.desc(sim), "candidate_id")),
            "gap_to_top": F.max(sim).over(by) - F.col(sim),
            "n_cand_for_entity": F.count(F.lit(1)).over(by),
            "reverse_rank": F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc(sim), "s1_id")),
        }
    )
    return rows.withColumn("mutual_top1", ((F.col("rank_in_cand") == 1) & (F.col("reverse_rank") == 1)).cast("int"))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def dense_features(pairs: DataFrame, s1: DataFrame, targets: DataFrame, truth: DataFrame | None = None, jaro_winkler: bool = True) -> DataFrame:
    """The DENSE columns of pairs (s1_id, candidate_id, sim_name, sim_addr, route_name, route_addr) and, with a truth, label.

    Records as of ``normalize_records``. Without ``jaro_winkler`` that column is left out and all runs in the JVM.
    """
    ship(pairs.sparkSession)
    own = lambda rows: rows.select("entity_id", F.col("name_core").alias("name"), "house_number", "state_code", tokens(F.col("name_core")).alias("nt"), tokens(F.col("addr_core")).alias("at"))
    p = _sides(pairs, own(s1), own(targets))
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    both = (x("name") != "") & (y("name") != "")
    columns = {
        "name_sim": F.col("sim_name"),
        "addr_sim": F.col("sim_addr"),
        "route_both": F.col("route_name").bitwiseAND(F.col("route_addr")),
        "jw_sim": F.when(both, S.jaro_winkler(x("name"), y("name"))).otherwise(0.0) if jaro_winkler else None,
        "name_jaccard": S.jaccard(x("nt"), y("nt")),
        "name_exact": _flag(both & (x("name") == y("name"))),
        "name_len_diff": F.abs(F.length(x("name")) - F.length(y("name"))),
        "first_token_eq": _flag(F.get(x("nt"), 0) == F.get(y("nt"), 0)),
        "house_match": S.three_state(x("house_number"), y("house_number")),
        "state_match": S.three_state(x("state_code"), y("state_code")),
        "addr_jaccard": S.jaccard(x("at"), y("at")),
        "is_source2": F.col("candidate_id").startswith("S2-").cast("int"),
        "sim_product": F.col("sim_name") * F.col("sim_addr"),
        "sim_max": F.greatest("sim_name", "sim_addr"),
    }
    rows = context(p.withColumns({k: c for k, c in columns.items() if c is not None}), "sim_max")
    names = [c for c in DENSE if c != "jw_sim" or jaro_winkler]
    if truth is not None:
        rows, names = label(rows, truth), [*names, "label"]
    return rows.select("s1_id", "candidate_id", *names)


def sparse_features(pairs: DataFrame, s1: DataFrame, targets: DataFrame, truth: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """The SPARSE columns of pairs (s1_id, candidate_id, nsim, asim, csim). Records as of ``normalize_sparse``; without ``fuzzy`` no Arrow functions."""
    ship(pairs.sparkSession)

    def own(rows: DataFrame) -> DataFrame:
        n, a = F.col("name_core"), F.col("addr_norm")
        return rows.select(
            "entity_id", "name_full", "country", n.alias("name"), a.alias("addr"), F.array_distinct(tokens(n)).alias("nt"), F.array_distinct(tokens(a)).alias("at"),
            tokens(F.col("name_trade")).alias("tt"), S.grams(n, 3).alias("n3"), S.grams(n, 4).alias("n4"), S.grams(a, 3).alias("a3"), S.numbers(a).alias("num"),
        )

    freq = lambda c, to: s1.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias(to))
    left = own(s1).join(freq("name_core", "name_freq"), F.col("name") == F.col("v")).drop("v").join(freq("addr_norm", "addr_freq"), F.col("addr") == F.col("v")).drop("v")
    p = _sides(pairs, left, own(targets))
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    columns = {
        "max_sim": F.greatest("nsim", "asim", "csim"),
        "name_jaccard_tok": S.jaccard(x("nt"), y("nt")),
        "name_overlap": S.overlap(x("nt"), y("nt")),
        "name_jac3": S.jaccard(x("n3"), y("n3")),
        "name_jac4": S.jaccard(x("n4"), y("n4")),
        "addr_jaccard_tok": S.jaccard(x("at"), y("at")),
        "addr_overlap": S.overlap(x("at"), y("at")),
        "addr_jac3": S.jaccard(x("a3"), y("a3")),
        "addr_num_overlap": F.size(F.array_intersect(x("num"), y("num"))),
        "dba_trade_jaccard": F.greatest(S.jaccard(x("nt"), y("nt")), S.jaccard(x("tt"), y("nt")), S.jaccard(x("nt"), y("tt"))),
        "name_exact": _flag((x("name_full") == y("name_full")) & (x("name_full") != "")),
        "name_len_diff": F.abs(F.length(x("name")) - F.length(y("name"))),
        "name_len_ratio": S.length_ratio(x("name"), y("name")),
        "name_tok_diff": F.abs(F.size(x("nt")) - F.size(y("nt"))),
        "name_first_tok": _flag(F.get(x("nt"), 0) == F.get(y("nt"), 0)),
        "addr_missing": _flag((x("addr") == "") | (y("addr") == "")),
        "addr_len_ratio": S.length_ratio(x("addr"), y("addr")),
        "country_match": _flag((x("country") == y("country")) & (x("country") != "")),
        "country_mismatch": _flag((x("country") != y("country")) & (x("country") != "") & (y("country") != "")),
        "src_is_s2": F.col("candidate_id").startswith("S2-").cast("int"),
        "name_x_addr": F.col("nsim") * F.col("asim"),
        "name_lev_norm": S.levenshtein_similarity(x("name"), y("name")),
        "name_freq_s1": x("name_freq"),
        "addr_freq_s1": x("addr_freq"),
    }
    names = SPARSE
    if fuzzy:
        columns |= {
            "name_wratio": S.weighted_ratio(x("name"), y("name")), "name_tsort": S.token_sort_ratio(x("name"), y("name")), "name_tset": S.token_set_ratio(x("name"), y("name")),
            "name_partial": S.partial_ratio(x("name"), y("name")), "addr_tsort": S.token_sort_ratio(x("addr"), y("addr")), "addr_tset": S.token_set_ratio(x("addr"), y("addr")),
        }
    else:
        names = [c for c in SPARSE if c not in ("name_wratio", "name_tsort", "name_tset", "name_partial", "addr_tsort", "addr_tset")]
    rows = mutual(p.withColumns(columns), "max_sim")
    if truth is not None:
        rows, names = label(rows, truth), [*names, "label"]
    return rows.select("s1_id", "candidate_id", *names)


def value_frequency(rows: DataFrame, column: str) -> DataFrame:
    """Each row with the number of rows that share its value; counted before the join."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("freq"))
    return rows.join(counts, rows[column].eqNullSafe(counts[column])).drop(counts[column])


def token_weights(records: DataFrame, column: str) -> DataFrame:
    """(token, df, idf): ln((1 + N) / (1 + df)) + 1."""
    n = records.count()
    df = records.select(F.explode(F.array_distinct(tokens(F.col(column)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def token_kind(token: Column) -> Column:
    """numeric, postal (five or six digits), alphanumeric, or word."""
    return F.when(token.rlike(r"^\d{5,6}$"), "postal").when(token.rlike(r"^\d+$"), "numeric").when(token.rlike(r"\d"), "alphanumeric").otherwise("word")


def learned_abbreviations(true_pairs: DataFrame, at_least: int = 2) -> DataFrame:
    """(short, long, n): token pairs at one place in true pairs (a1, a2) where one begins with the other's first letter and is its subsequence."""
    zipped = true_pairs.select(F.explode(F.arrays_zip(tokens(F.col("a1")).alias("s"), tokens(F.col("a2")).alias("t"))).alias("z")).select("z.s", "z.t").where("s <> t")
    short, long = F.when(F.length("s") <= F.length("t"), F.col("s")).otherwise(F.col("t")), F.when(F.length("s") <= F.length("t"), F.col("t")).otherwise(F.col("s"))
    pattern = F.concat(F.lit("^"), F.regexp_replace(short, "(.)", "$1.*"))
    rows = zipped.select(short.alias("short"), long.alias("long"), pattern.alias("p")).where("short rlike '^[a-z]+$' and long rlike p")
    return rows.groupBy("short", "long").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
