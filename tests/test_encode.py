"""Encoders and pair scorers."""

import random

import numpy as np
from pyspark.sql import functions as F

from kindred.operators import blocking, decide, encode


def test_latent_finds_edited_names(spark):
    r = random.Random(1)
    names = [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(3)) for _ in range(120)]
    edited = [n[: (at := r.randrange(len(n)))] + "x" + n[at + 1 :] for n in names]
    rows = [*enumerate(names), *((1000 + i, n) for i, n in enumerate(edited)), (5000, None), (5001, "")]
    df = spark.createDataFrame(rows, "id long, name string").repartition(3)
    fitted = encode.fit_latent(df, "name")
    vectors = encode.encode(df, "name", fitted, "id")
    got = {x.id: np.array(x.vector) for x in vectors.collect()}
    assert len(got) == len(rows) and all(len(v) == encode.WIDTH for v in got.values())
    assert not got[5000].any() and not got[5001].any() and abs(np.linalg.norm(got[3]) - 1) < 1e-9
    # the same as the leading singular vectors of the weighted matrix
    x = encode.unit_rows(encode.counted([n for _, n in rows]) * fitted.idf)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(abs(fitted.axes[:, 0]), abs(axes[0]), atol=1e-6)
    e = vectors.withColumn("group", F.lit(-1).cast("long"))
    best = blocking.dense_top_k(e.where("id < 1000"), e.where("id between 1000 and 2000"), 1).collect()
    assert sum(x.candidate_id == 1000 + x.s1_id for x in best) >= 110
    assert encode.encode(df.limit(0), "name", fitted, "id").count() == 0


def test_gated_rerank(spark):
    rows = [("a", "x", 0.7), ("a", "y", 0.9), ("b", "x", 0.66), ("c", "z", 0.8)]
    scored = spark.createDataFrame(rows, "s1_id string, candidate_id string, score double")
    left = spark.createDataFrame([("a", "one"), ("b", None)], "entity_id string, text string")
    right = spark.createDataFrame([("x", "one"), ("y", "two"), ("z", "")], "entity_id string, text string")
    out = encode.gated_rerank(scored, left, right, lambda a, b: [float(x == y) for x, y in zip(a, b, strict=True)]).collect()
    got = {(x.s1_id, x.candidate_id): (x.reranked_by_D, round(x.score, 6)) for x in out}
    assert got == {("a", "x"): (1, 0.85), ("a", "y"): (0, 0.9), ("b", "x"): (1, 0.33), ("c", "z"): (1, 0.9)}
    assert decide.rerank(scored, F.lit(1.0)).count() == 4
