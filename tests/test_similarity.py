import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import similarity as S

WORDS = st.text("ab c", max_size=12)


@given(WORDS, WORDS)
@settings(max_examples=200, deadline=None)
def test_ratios_are_symmetric_and_bounded(a, b):
    for f in (S.jaro_winkler_of, S.ratio_of, S.token_sort_of, S.token_set_of, S.partial_of, S.weighted_of):
        assert 0 <= f(a, b) <= 1 and f(a, b) == pytest.approx(f(b, a), abs=1e-12) or f is S.jaro_winkler_of
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    assert S._common(a, b) == n[-1][-1]


def test_known_values():
    assert S.jaro_winkler_of("martha", "marhta") == pytest.approx(0.96111, abs=1e-5)
    assert S.jaro_winkler_of("abcdefgh", "a1234567") == pytest.approx(0.41667, abs=1e-5)
    assert S.token_sort_of("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 1
    assert S.token_set_of("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1
    assert S.partial_of("this is a test", "this is a test!") == 1
    # no preprocessor: "test!!!" is another word than "test"
    assert S.weighted_of("this is a test", "this is a new test!!!") == pytest.approx(0.855)
    assert S.weighted_of("this is a test", "this is a new test") == pytest.approx(0.95)
    assert S.weighted_of("", "x") == 0 and S.ratio_of("", "") == 1


def test_columns(spark):
    df = spark.createDataFrame([("a b c", "b c d"), ("", "x"), ("ab", "ab"), ("no 12 34", "34 no")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(S.token_jaccard(a, b), S.token_overlap(a, b), S.gram_jaccard(a, b, 3), S.levenshtein_similarity(a, b), S.shared_numbers(a, b), S.three_state(a, b), S.jaro_winkler(a, b)).collect()
    assert tuple(rows[0])[:2] == (0.5, pytest.approx(2 / 3))
    assert tuple(rows[1]) == (0, 0, 0, 0, 0, 0, 0)
    assert tuple(rows[2]) == (1, 1, 0, 1, 0, 1, 1)
    assert rows[3][4] == 1


def test_sql_names(spark):
    S.register(spark)
    assert spark.sql("SELECT jaro_winkler('martha', 'marhta') AS x").first().x == pytest.approx(0.96111, abs=1e-5)


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "v array<double>, z array<double>").select(S.unit(F.col("v")), S.unit(F.col("z")), S.inner_product(F.col("v"), F.col("v"))).first()
    assert list(r) == [[0.6, 0.8], [0.0, 0.0], 25.0]


def test_idf_and_acronym(spark):
    w = F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(1.0))
    df = spark.createDataFrame([(["a", "b"], ["a", "z"], "ibm", "international business machines")], "x array<string>, y array<string>, s string, t string")
    assert tuple(df.select(S.idf_overlap(F.col("x"), F.col("y"), w), S.acronym(F.col("s"), F.col("t"))).first()) == (1.0, True)
