"""Similarities of strings, token sets and vectors. Set measures and Levenshtein are column expressions, the rest Arrow functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kindred.functions.text import tokens


def _over(shared: Column, whole: Column) -> Column:
    return F.when(whole > 0, shared / whole).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if one is empty."""
    shared, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / both).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared over the smaller set; 0 if one is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return _over(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(tokens(a), tokens(b))


def token_overlap(a: Column, b: Column) -> Column:
    return overlap(tokens(a), tokens(b))


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams, without padding."""
    made = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))
    return F.when(F.length(c) >= n, made).otherwise(F.array().cast("array<string>"))


def gram_jaccard(a: Column, b: Column, n: int) -> Column:
    return jaccard(grams(a, n), grams(b, n))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(\d+)\b"), 1))


def shared_numbers(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(numbers(a), numbers(b)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def three_state(a: Column, b: Column) -> Column:
    """1 equal, -1 different, 0 if one is missing."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when((a == "") | (b == ""), 0).when(a == b, 1).otherwise(-1)


def length_ratio(a: Column, b: Column) -> Column:
    return _over(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector over its length, in double; a zero vector stays."""
    norm = F.sqrt(inner_product(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def idf_overlap(a: Column, b: Column, weights: Column) -> Column:
    """Weight of shared tokens over that of the lighter side. weights: map of token to weight; unknown tokens weigh nothing."""
    total = lambda s: F.aggregate(F.array_distinct(s), F.lit(0.0), lambda n, t: n + F.coalesce(F.element_at(weights, t), F.lit(0.0)))
    return _over(total(F.array_intersect(a, b)), F.least(total(a), total(b)))


def acronym(a: Column, b: Column) -> Column:
    """Whether one side is the initials of the other."""
    initials = lambda s: F.array_join(F.transform(tokens(s), lambda t: F.substring(t, 1, 1)), "")
    return ((F.size(tokens(b)) > 1) & (a == initials(b))) | ((F.size(tokens(a)) > 1) & (b == initials(a)))


def sounds_alike(a: Column, b: Column) -> Column:
    return F.soundex(a) == F.soundex(b)


# plain functions behind the Arrow ones


def jaro_winkler_of(a: str, b: str) -> float:
    """1 if equal, 0 if one is empty; the prefix counts where Jaro's measure is over 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        free.setdefault(y, []).append(j)
    pairs: list[tuple[str, int]] = []
    for i, x in enumerate(a):
        at = free.get(x)
        if at:
            while at and at[0] < i - reach:
                at.pop(0)
            if at and at[0] <= i + reach:
                pairs.append((x, at.pop(0)))
    m = len(pairs)
    if not m:
        return 0.0
    other = [b[j] for j in sorted(j for _, j in pairs)]
    swaps = sum(x != y for (x, _), y in zip(pairs, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence: rows of the table as bits of one integer."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@lru_cache(1 << 16)
def ratio_of(a: str, b: str) -> float:
    return 1.0 if not a and not b else 2 * _common(a, b) / (len(a) + len(b))


def token_sort_of(a: str, b: str) -> float:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_of(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and (not left or not right):
        return 1.0
    both = [f"{shared} {s}".strip() for s in (left, right)]
    tries = [ratio_of(*both)]
    if shared:
        tries += [ratio_of(shared, s) for s in both]
    return max(tries)


@lru_cache(1 << 16)
def partial_of(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer; stretches at the ends may be shorter."""
    if not a or not b:
        return float(a == b)
    short, long = sorted((a, b), key=len)
    if short in long:
        return 1.0
    n = len(short)

    def best(s: str, t: str) -> float:
        return max(ratio_of(s, t[max(0, i) : i + n]) for i in range(1 - n, len(t)))

    return max(best(short, long), best(long, short)) if len(a) == len(b) else best(short, long)


def weighted_of(a: str, b: str) -> float:
    """The best of the ratios, weighted by how much the lengths differ."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    end = ratio_of(a, b)
    if lengths < 1.5:
        return max(end, 0.95 * max(token_sort_of(a, b), token_set_of(a, b)))
    scale = 0.9 if lengths < 8 else 0.6
    x, y = set(a.split()), set(b.split())
    if x & y:
        parts = 1.0
    else:
        parts = max(partial_of(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_of(" ".join(sorted(x - y)), " ".join(sorted(y - x))))
    return max(end, scale * partial_of(a, b), 0.95 * scale * parts)


def _arrow(f: Callable[[str, str], float]):
    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    batch.__name__ = f.__name__.removesuffix("_of")
    return F.pandas_udf(batch, DoubleType())


jaro_winkler = _arrow(jaro_winkler_of)
ratio = _arrow(ratio_of)
token_sort_ratio = _arrow(token_sort_of)
token_set_ratio = _arrow(token_set_of)
partial_ratio = _arrow(partial_of)
weighted_ratio = _arrow(weighted_of)

ARROW = {
    "jaro_winkler": jaro_winkler,
    "fuzz_ratio": ratio,
    "token_sort_ratio": token_sort_ratio,
    "token_set_ratio": token_set_ratio,
    "partial_ratio": partial_ratio,
    "weighted_ratio": weighted_ratio,
}


def register(spark) -> None:
    """Makes the Arrow functions callable from SQL by these names."""
    for name, f in ARROW.items():
        spark.udf.register(name, f)
