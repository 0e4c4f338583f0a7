"""Normalised records from raw ones (entity_id, business_name, business_address, country)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as T

RECORD = [
    "entity_id", "name_raw", "name_core", "name_translit", "name_dba", "legal_suffix", "addr_raw",
    "addr_core", "house_number", "is_house_redacted", "state_code", "landmark", "country",
]


def normalize_records(raw: DataFrame, exact_accents: bool = False) -> DataFrame:
    """The 13 string columns of a dense-track record. Null or blank fields give empty strings; a missing country is UNKNOWN.

    ``exact_accents`` strips accents by the full decomposition in Arrow batches instead of the JVM's table.
    """
    c = F.col
    clean = lambda x: T.clean(x, exact_accents)
    rows = raw.select(
        F.trim(T.text("entity_id")).alias("entity_id"),
        F.trim(T.text("business_name")).alias("name_raw"),
        F.trim(T.text("business_address")).alias("addr_raw"),
        T.country(c("country")).alias("country"),
    )
    rows = rows.withColumns({"name_translit": T.transliterate(c("name_raw")), "__addr": T.transliterate(c("addr_raw"))})
    primary, trade = T.split_dba(c("name_translit"))
    rows = rows.withColumns({"__primary": clean(primary), "__trade": clean(trade)})
    core, suffix = T.legal_form(c("__primary"))
    redacted, kept = T.redaction(c("__addr"))
    rows = rows.withColumns({"name_core": core, "legal_suffix": suffix, "name_dba": T.legal_form(c("__trade"))[0], "__red": redacted, "__addr": kept})
    before, mark = T.landmark(c("__addr"))
    rows = rows.withColumns({"house_number": F.when(c("__red"), "").otherwise(T.house_number(c("__addr"))), "__before": before, "__mark": mark})
    code, named = T.state(c("__before"))
    rows = rows.withColumns({"state_code": code, "__named": named})
    return rows.withColumns(
        {
            "addr_core": T.expand_streets(clean(c("__named"))),
            "landmark": clean(c("__mark")),
            "is_house_redacted": F.when(c("__red"), "1").otherwise("0"),
        }
    ).select(*RECORD)


def normalize_sparse(raw: DataFrame) -> DataFrame:
    """The 8 string columns of a sparse-track record: full, core and trade name, address, both joined, country."""
    c = F.col
    base = lambda x: F.trim(F.lower(T.strip_accents(T.transliterate_plain(x))))
    plain = lambda x: T.squeeze(F.regexp_replace(F.replace(x, F.lit("&"), F.lit(" and ")), r"[^a-z0-9\s]", " "))
    rows = raw.select(
        T.text("entity_id").alias("entity_id"),
        plain(base(c("business_name"))).alias("name_full"),
        plain(T.unmask_digits(base(c("business_address")))).alias("__addr"),
        T.text("country").alias("country"),
    )
    primary, trade = T.split_dba_word(c("name_full"))
    rows = rows.withColumns({"__primary": primary, "__trade": trade})
    from kindred.functions.vocabulary import STATES, STREET_TOKENS

    names = {code.lower(): name for name, code in STATES.items()} | STREET_TOKENS
    rows = rows.withColumns(
        {
            "name_core": T.drop_form_tokens(c("__primary")),
            "name_trade": T.drop_form_tokens(c("__trade"), keep_something=False),
            "addr_norm": T.expand_tokens(c("__addr"), names),
            "country_norm": T.country(F.lower(c("country")), "__unknown__"),
        }
    )
    return rows.withColumn("combined", F.trim(F.concat_ws(" ", "name_core", "addr_norm"))).select(
        "entity_id", "name_full", "name_core", "name_trade", "addr_norm", "combined", "country", "country_norm"
    )
