"""Every query of the library against DuckDB on the smallest tables, and the trained ones for sense."""

import math
import random
from pathlib import Path

import duckdb
import pytest

from kindred.operators import metrics, model
from kindred.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else repr(round(float(v), 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols and got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_models_learn(spark):
    r = random.Random(5)
    rows = [(f"s{i}", f"c{i}", r.random(), r.random()) for i in range(600)]
    rows = [(*x, int(x[2] + 0.1 * x[3] > 0.6)) for x in rows]
    pairs = model.group_folds(spark.createDataFrame(rows, "s1_id string, candidate_id string, x double, y double, label int"), k=2)
    out, models = model.out_of_fold(pairs, ["x", "y"], 2, trees=5)
    assert metrics.auc(out).first().auc > 0.95 and model.importances(models, ["x", "y"])[0][0] == "x"
    assert model.predict_mean(models, pairs, ["x", "y"]).where("score > 0.5").count() > 100
    calibrated = catalogue.queries()["isotonic_calibrate"](spark, DATA).orderBy("score").collect()
    assert all(a.calibrated <= b.calibrated + 1e-9 for a, b in zip(calibrated, calibrated[1:], strict=False))
    assert catalogue.queries()["dense_cell_recall"](spark, DATA).first().recall >= 0.9


def test_entry():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("small", [False, True])
def test_search_of_whole_documents(spark, tmp_path, monkeypatch, small):
    """Documents alike after their first sentence find each other, by any of the ways that weights and products are made."""
    from kindred.operators import blocking

    if small:  # no grams sent, many blocks
        monkeypatch.setattr(blocking, "SENT_GRAMS", 10)
    for name, value in {"SENT_ENTRIES": 100, "TEXT_AT_ONCE": 50}.items():
        monkeypatch.setattr(blocking, name, value)
    r = random.Random(6)
    words = ["".join(r.choice("abcdeé𐐨") for _ in range(r.randint(1, 6))) for _ in range(60)]
    text = lambda: ". ".join(" ".join(r.choice(words) for _ in range(4)) for _ in range(r.randint(1, 5)))
    tail = ". the tail of both documents is of the same words. and so on"
    rows = [(0, "alpha beta" + tail), (1, "gamma delta" + tail), (2, "alpha beta. nothing else is here, 12345 xyzzy"), (3, None), (50, ". ."), (51, "")]
    rows += [(i, text()) for i in range(100, 340)] + [(340, rows[0][1]), (350, rows[0][1]), (150, "twice this id. alpha"), (None, text()), (None, "gamma delta" + tail)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(*x, "en", "src1") for x in rows], "doc_id long, text string, lang string, source string").repartition(3).write.parquet(path)
    got = sorted((x.s1_id, x.candidate_id, x.sim) for x in catalogue.queries()["tfidf_topk_sentence"](spark, str(tmp_path)).collect())
    best = [c for _, c, _ in sorted((x for x in got if x[0] == 0), key=lambda x: (-x[2], x[1]))]
    assert best[:3] == [340, 350, 1] and {x[0] for x in got} == {0, 100, 150, 200, 250, 300, 350}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert got == [(a, b, pytest.approx(s, abs=1.1e-6)) for a, b, s in sorted(duck.execute(catalogue.oracle_sql()["tfidf_topk_sentence"]).fetchall())]
