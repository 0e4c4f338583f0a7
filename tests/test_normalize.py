"""Golden cases of the normalisers."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.operators.normalize import RECORD, normalize_records, normalize_sparse

RAW = "entity_id string, business_name string, business_address string, country string"
ROWS = [
    ("1", "राम मार्केटिंग प्राइवेट लिमिटेड", "दिल्ली", "IN"),
    ("2", "Ectolumdrex dba X+ Madison Inc", "1795 Westchester Drive, High Point, North Carolina", "US"),
    ("3", "Summit Inc", "GREENSBORO, NC, 19 1/2 STARDUST TRAIL", "US"),
    ("4", "LLC Moncada Learning Center", "##8 Willow Oak Lane, Charlotte, NC", None),
    ("5", "<< Team Ecole", "175 Boulevard du Président Franklin Roosevelt, Bordeaux, Nouvelle-Aquitaine", "France"),
    ("6", None, "5780 Fawn Ct, Fort Worth, Texas", " "),
    ("7", "TA Motors", "road ##8 XX12 xx12", "US"),
    ("8", "", "", "US"),
    ("9", "x", "1795 Westchester Drive, High Point, NC near sbi", "US"),
]


@pytest.fixture(scope="module")
def dense(spark):
    return {r.entity_id: r for r in normalize_records(spark.createDataFrame(ROWS, RAW)).collect()}


def test_columns(dense):
    assert list(dense["1"].asDict()) == RECORD
    assert all(v is not None for r in dense.values() for v in r)


def test_scripts(dense):
    assert dense["1"].name_translit == "ram marketing private limited"
    assert dense["1"].name_core == "ram marketing" and dense["1"].legal_suffix == "private limited"
    assert dense["1"].addr_core == "delhi"


def test_names(dense):
    assert (dense["2"].name_core, dense["2"].name_dba) == ("ectolumdrex", "x madison")
    assert (dense["3"].name_core, dense["3"].legal_suffix) == ("summit", "inc")
    assert (dense["4"].name_core, dense["4"].legal_suffix) == ("moncada learning center", "llc")
    assert dense["5"].name_core == "team ecole"
    assert dense["7"].name_core == "" and dense["7"].name_dba == "motors"


def test_addresses(dense):
    assert dense["2"].state_code == "NC" and dense["2"].addr_core.endswith("nc") and dense["2"].house_number == "1795"
    assert dense["3"].state_code == "NC"
    assert dense["6"].state_code == "TX" and dense["6"].country == "UNKNOWN"
    assert (dense["4"].is_house_redacted, dense["4"].house_number) == ("1", "")
    assert (dense["9"].is_house_redacted, dense["9"].house_number, dense["9"].landmark) == ("0", "1795", "near sbi")
    assert "president" in dense["5"].addr_core and dense["5"].house_number == "175" and dense["5"].country == "France"
    assert dense["7"].is_house_redacted == "1" and dense["7"].addr_core == "road 8 xx12"


def test_sparse(spark):
    rows = {r.entity_id: r for r in normalize_sparse(spark.createDataFrame(ROWS, RAW)).collect()}
    assert rows["2"].name_trade == "x madison" and rows["2"].name_core == "ectolumdrex"
    assert rows["4"].addr_norm == "8 willow oak lane charlotte north carolina" and rows["4"].country_norm == "__unknown__"
    assert rows["8"].combined == ""


def test_accents(spark):
    words = ["école", "Ñandú", "ﬁle ½", "Ωμέγα", None, "ｆｕｌｌ"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.strip_accents_exact("w").alias("e"), T.strip_accents(F.col("w")).alias("j")).collect()
    for r in rows:
        plain = None if r.w is None else "".join(c for c in unicodedata.normalize("NFKD", r.w) if not unicodedata.combining(c))
        assert r.e == plain
    assert rows[0].j == "ecole" and rows[1].j == "Nandu"


def test_variants(spark):
    df = spark.createDataFrame([("acme inc ltd", "Café & Co aka Bar", "12 rd 12b")], "a string, b string, c string")
    r = df.select(
        T.drop_legal_forms(F.col("a")).alias("a1"), T.drop_form_tokens(F.col("a")).alias("a2"), T.drop_form_tokens(F.lit("inc ltd")).alias("a3"),
        T.drop_dba(F.col("b")).alias("b1"), T.clean_ascii(F.col("b")).alias("b2"), T.house_number_plain(F.col("c")).alias("c1"), T.is_redacted_plain(F.lit("##8")).alias("d"),
    ).first()
    assert (r.a1, r.a2, r.a3) == ("acme", "acme", "inc ltd")
    assert (r.b1, r.b2, r.c1, r.d) == ("Café & Co", "cafe co aka bar", "12", True)
