"""Normalisation of names and addresses as column expressions.

Null text counts as empty throughout. Everything runs in the JVM; only the exact accent stripper is an Arrow function.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kindred.functions import vocabulary as V


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def tokens(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# accents


@cache
def _accents() -> tuple[str, str, str]:
    """Characters of the Latin, Greek and Cyrillic blocks that decompose to one other character; what they become; combining marks."""
    source, target = [], []
    for i in [*range(0xA0, 0x530), *range(0x1E00, 0x2000)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != chr(i):
            source.append(chr(i))
            target.append(plain)
    marks = "".join(chr(i) for i in range(0x300, 0x370) if unicodedata.combining(chr(i)))
    return "".join(source), "".join(target), marks


def strip_accents(c: Column) -> Column:
    """Accents off by compatibility decomposition, for characters that become one character."""
    source, target, marks = _accents()
    return F.translate(c, source + marks, target)


@F.pandas_udf(StringType())
def strip_accents_exact(s: pd.Series) -> pd.Series:
    """Full compatibility decomposition without combining marks, ligatures and fractions included."""
    return s.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))


def clean(c: Column, exact: bool = False) -> Column:
    """Lower case without accents; ``&`` as "and"; anything but letters, digits, underscores and spaces as a space."""
    # what is of ASCII has no accents; its letters are as many as its bytes
    plain = F.lower(strip_accents_exact(text(c)) if exact else F.when(F.octet_length(text(c)) == F.length(text(c)), text(c)).otherwise(strip_accents(text(c))))
    return F.trim(F.regexp_replace(F.replace(plain, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}_]+", " "))


def clean_ascii(c: Column) -> Column:
    """The variant that turns all but ASCII letters and digits into spaces, decomposed marks too: a space after each accented letter."""
    source, target, marks = _accents()
    own = {a: b for a, b in zip(source, target, strict=True) if b.isascii() and b.isalnum()}
    marked = F.regexp_replace(text(c), f"([{''.join(own)}])", "$1 ")
    return squeeze(F.lower(F.regexp_replace(F.translate(marked, "".join(own), "".join(own.values())), r"[^a-zA-Z0-9\s]", " ")))


# scripts


def transliterate(c: Column) -> Column:
    """Devanagari words in Latin script: known words by the dictionary, else by letters, "a" after a consonant before a letter of its own."""
    consonant, letter = "".join(V.CONSONANTS), "".join([*V.CONSONANTS, *V.VOWELS])
    signs = literal_map(V.CONSONANTS | V.VOWELS | V.VOWEL_SIGNS | V.OTHER_SIGNS)
    words = literal_map(V.DEVANAGARI_WORDS)

    def word(w: Column) -> Column:
        sounded = F.regexp_replace(w, f"([{consonant}])(?=[{letter}])", "$1a")
        spelled = F.array_join(F.transform(F.split(sounded, ""), lambda x: F.coalesce(F.element_at(signs, x), x)), "")
        return F.coalesce(F.element_at(words, F.regexp_replace(w, r"^[.,\-–/()]+|[.,\-–/()]+$", "")), spelled)

    known = text(c)
    for source, target in V.KANNADA_WORDS.items():
        known = F.replace(known, F.lit(source), F.lit(target))
    return F.when(text(c).rlike(r"[ऀ-ॿ]"), F.array_join(F.transform(tokens(known), word), " ")).otherwise(text(c))


def transliterate_plain(c: Column) -> Column:
    """Letter for letter, where a letter beyond ASCII occurs."""
    signs = literal_map({x: V.CONSONANTS[x] for x in V.PLAIN_CONSONANTS} | V.PLAIN_SIGNS)
    spelled = F.array_join(F.transform(F.split(text(c), ""), lambda x: F.coalesce(F.element_at(signs, x), x)), "")
    return F.when(text(c).rlike(r"[\p{L}&&[^\x00-\x7F]]"), spelled).otherwise(text(c))


# names


def _before_after(c: Column, pattern: str) -> tuple[Column, Column]:
    """Text before and after the first match; (text, "") without one."""
    both = F.split(c, f"(?i){pattern}", 2)
    return F.trim(both[0]), F.coalesce(F.trim(F.get(both, 1)), F.lit(""))


def split_dba(c: Column) -> tuple[Column, Column]:
    """(primary, trade name) around the first "doing business as" marker; a name without one stays as it is."""
    found = text(c).rlike(f"(?i){V.DBA}")
    primary, trade = _before_after(text(c), V.DBA)
    return F.when(found, primary).otherwise(text(c)), F.when(found, trade).otherwise("")


def drop_dba(c: Column) -> Column:
    """The variant that drops the tail, "aka" included."""
    return F.trim(F.regexp_replace(text(c), f"(?is){V.DBA_AKA}.*", ""))


def split_dba_word(c: Column) -> tuple[Column, Column]:
    """The variant for cleaned names: the word dba only."""
    parts = F.split(c, r"\bdba\b")
    return F.trim(parts[0]), F.coalesce(F.trim(F.get(parts, 1)), F.lit(""))


def legal_form(cleaned: Column) -> tuple[Column, Column]:
    """(core, form) of a cleaned name: one leading form, else one trailing, else the last anywhere."""
    lead, trail, anywhere = f"^({V.LEADING_FORMS})\\s+", f"\\s+({V.TRAILING_FORMS})$", f"^(.*)\\b({V.ANY_FORMS})\\b(.*?)$"
    core = (
        F.when(cleaned.rlike(lead), F.trim(F.regexp_replace(cleaned, lead, "")))
        .when(cleaned.rlike(trail), F.trim(F.regexp_replace(cleaned, trail, "")))
        .when(cleaned.rlike(anywhere), squeeze(F.regexp_replace(cleaned, anywhere, "$1 $3")))
        .otherwise(cleaned)
    )
    form = (
        F.when(cleaned.rlike(lead), F.regexp_extract(cleaned, lead, 1))
        .when(cleaned.rlike(trail), F.regexp_extract(cleaned, trail, 1))
        .when(cleaned.rlike(anywhere), F.regexp_extract(cleaned, anywhere, 2))
        .otherwise("")
    )
    return core, form


def drop_legal_forms(cleaned: Column) -> Column:
    """The variant that removes every form."""
    return squeeze(F.regexp_replace(cleaned, f"\\b({V.ANY_FORMS})\\b", ""))


def drop_form_tokens(cleaned: Column, keep_something: bool = True) -> Column:
    """The variant by tokens; a name of forms only stays as it is if ``keep_something``."""
    rest = F.filter(tokens(cleaned), lambda t: ~t.isin(V.FORM_TOKENS))
    joined = F.array_join(rest, " ")
    return F.when(F.size(rest) == 0, cleaned).otherwise(joined) if keep_something else joined


# addresses


def redaction(c: Column) -> tuple[Column, Column]:
    """(is redacted, text without the first redacted number): "##8", "***4", "XX12"."""
    at = F.regexp_instr(c, F.lit(V.REDACTED))
    hit = F.regexp_extract(c, V.REDACTED, 1)
    cut = F.concat(F.substring(c, F.lit(1), at - 1), F.lit(" "), F.substring(c, at + F.length(hit), F.length(c)))
    return at > 0, F.when(at > 0, cut).otherwise(c)


def redaction_all(c: Column) -> Column:
    return F.regexp_replace(c, V.REDACTED, " ")


def is_redacted_plain(c: Column) -> Column:
    return c.contains("##") | c.contains("***")


def unmask_digits(c: Column) -> Column:
    """The variant that keeps the digits after the marks."""
    return F.regexp_replace(c, r"#+(\d)", "$1")


def house_number(c: Column) -> Column:
    """Labelled, else leading, else the first in the first 35 characters; lower case."""
    first = lambda s, p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
    return F.lower(
        F.coalesce(
            first(c, f"(?i){V.LABELLED_NUMBER}"),
            first(c, r"^\s*([0-9]+[a-zA-Z]?)\b"),
            first(F.substring(c, 1, 35), r"\b([0-9]+[a-zA-Z]?)\b"),
            F.lit(""),
        )
    )


def house_number_plain(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\b(\d{1,6}[A-Za-z]?)\b", 1))


def landmark(c: Column) -> tuple[Column, Column]:
    """(address before the first cue, landmark from the cue on)."""
    at = F.regexp_instr(c, F.lit(f"(?i){V.LANDMARK}"))
    return F.when(at > 0, F.trim(F.substring(c, F.lit(1), at - 1))).otherwise(c), F.when(at > 0, F.trim(F.substring(c, at, F.length(c)))).otherwise("")


def _by_length() -> list[tuple[str, str]]:
    return sorted(V.STATES.items(), key=lambda x: -len(x[0]))


def state_token(c: Column) -> Column:
    """The first two-letter word that is a state's code."""
    return F.coalesce(F.get(F.filter(F.regexp_extract_all(F.upper(c), F.lit(r"\b([A-Z]{2})\b"), 1), lambda t: t.isin(*V.STATES.values())), 0), F.lit(""))


def state(c: Column) -> tuple[Column, Column]:
    """(code, text with the full name as its code): the longest state name in the text, else the first code."""
    code = changed = None
    for name, short in _by_length():
        hit = c.rlike(f"(?i)\\b{name}\\b")
        replaced = F.regexp_replace(c, f"(?i)\\b{name}\\b", f" {short} ")
        code = F.when(hit, short) if code is None else code.when(hit, short)
        changed = F.when(hit, replaced) if changed is None else changed.when(hit, replaced)
    return code.otherwise(state_token(c)), changed.otherwise(c)


def expand_tokens(cleaned: Column, values: dict[str, str]) -> Column:
    """Each word by its full form where the table has one."""
    table = literal_map(values)
    return F.array_join(F.transform(tokens(cleaned), lambda t: F.coalesce(F.element_at(table, t), t)), " ")


def expand_streets(cleaned: Column) -> Column:
    return expand_tokens(cleaned, V.STREETS)


def country(c: Column, missing: str = "UNKNOWN") -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(missing))
