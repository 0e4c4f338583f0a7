"""The pipeline's stages on small tables."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    text = lambda n: " ".join(r.sample(words, n))
    leak = " ".join(r.sample(words, 20))
    clean = {i: text(60) for i in range(20)}
    rows = dict(clean)
    rows[30] = clean[3]
    rows[31] = "too short"
    rows[32] = None
    rows[33] = text(30) + " " + leak + " " + text(30)
    rows[34] = "\n".join([text(10), text(10), text(10), text(30)])
    rows[35] = rows[34].rsplit("\n", 1)[0] + "\n" + text(40)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in clean], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out/{k}")
        docs = spark.read.parquet(f"{tmp_path}/out/{k}")
        kept[name] = {x.doc_id: x for x in docs.collect()}
        if name != names[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(kept["quality_rules"]) == set(rows) - {31, 32}
    assert kept["line_dedup"][35].text == rows[35].split("\n")[-1] and kept["line_dedup"][35].n_chars == len(kept["line_dedup"][35].text)
    assert set(kept["simhash_near_dedup"]) == set(rows) - {30, 31, 32}
    assert set(kept["benchmark_decontamination"]) == set(rows) - {30, 31, 32, 33}
    assert set(kept["packing"]) == set(kept["benchmark_decontamination"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["packing"])


def test_edited_copies(spark):
    """Copies at a shingle similarity of 0.8 to 0.95 go; one just under 0.8 stays. By brute force over all pairs."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    texts = {}
    for i in range(120):
        texts[i] = " ".join(word() for _ in range(r.choice([30, 80, 300])))
        w = texts[i].split()
        for _ in range(max(1, round(len(w) * r.uniform(0.004, 0.025)))):
            w[r.randrange(len(w))] = word()
        texts[1000 + i] = " ".join(w)
    base = [word() for _ in range(200)]
    for i in range(150):  # a large group: more pairs than the first round gives
        texts[2000 + i] = " ".join([*base[: r.randrange(160, 201)], word()])
    sets = {i: grams(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    levels = []
    for i in texts:
        for j in texts:
            if i < j and len(both := sets[i] & sets[j]):
                similarity = len(both) / len(sets[i] | sets[j])
                if i < 1000 and similarity >= 0.8:
                    levels.append(similarity)
                if similarity >= 0.8:
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    assert sum(x < 0.85 for x in levels) >= 10 and sum(0.85 <= x < 0.95 for x in levels) >= 10 and len(levels) < 115
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], schema).repartition(3)
    assert {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()} == {find(i) for i in texts}


def test_refused_near_copies():
    """Of a large group of near copies that are mostly not alike enough, meetings give no more than twice the pairs that are, and lose none."""
    import numpy as np

    from kindred.llm import similar_texts as T

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    base, texts = [word() for _ in range(150)], []
    for _ in range(300):
        w = list(base)
        for _ in range(r.randrange(1, 14)):
            w[r.randrange(150)] = word()
        texts.append(" ".join(w))
    sets = [np.unique(T.shingle_hashes(t, 5)) for t in texts]
    pairs = {(i, j) for i in range(300) for j in range(i) if (k := len(np.intersect1d(sets[i], sets[j]))) * 1000 >= (len(sets[i]) + len(sets[j]) - k) * 800}
    fp = np.stack([T._sketch(s)[0] for s in sets])
    table = np.bitwise_count(fp[:, None] ^ fp[None, : T.PIVOTS]).sum(2).astype(np.uint8)
    bins = np.stack([np.frombuffer(T._bins(s), np.uint8) for s in sets])
    n, ids, start = np.array([len(s) for s in sets]), np.arange(300), np.zeros(300, np.int64)
    x, y, held = T._meet(start, ids, n, ids, fp, table, bins, np.ones(300, bool), 800, 10**6)
    found = {(max(p), min(p)) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert 20 < len(pairs) and found >= pairs and len(found) < 2 * len(pairs) < 9_000 and not len(held)
    x, y, held = T._meet(start, ids, n, ids, fp, table, bins, np.ones(300, bool), 800, 1)
    assert list(held) == [0] and np.bincount(x).max() == 1


def test_rounds_of_near_copies(spark, monkeypatch):
    """A large group of near copies is connected under a few keys before it meets under the others: a text gives few pairs over all rounds, and the group stays whole."""
    from kindred.llm import similar_texts as T

    r, write, rows = random.Random(9), T.materialize, []
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))

    def counted(df):
        out = write(df)
        rows.extend([out.count()] if out.columns == ["a", "b", "key"] else [])
        return out

    monkeypatch.setattr(T, "materialize", counted)
    base, texts = [word() for _ in range(150)], []
    for _ in range(300):
        w = list(base)
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(150)] = word()
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = T.near_duplicates(df).collect()
    assert len(out) == 300 and {x.component_id for x in out} == {0}
    assert sum(rows) < 60 * 300


def test_pivot_table(spark):
    """The written table's distances to reference fingerprints, recomputed; a hash class of over 255 makes no claim."""
    import numpy as np

    from kindred.llm import similar_texts as T

    fp = np.random.default_rng(1).integers(0, 2**64, (30, T.WORDS), dtype=np.uint64)
    rows = [(i, 0 if i == 29 else 5, bytearray(f.tobytes()), []) for i, f in enumerate(fp)]
    got = T.pivot_table(spark.createDataFrame(rows, "id long, n int, fp binary, keys array<long>")).collect()
    distances = np.array([np.bitwise_count(fp ^ f).sum(1) for f in fp]).clip(max=255)
    seen = np.array([list(x.pivots) for x in sorted(got, key=lambda x: x.id)])
    assert seen.shape == (30, T.PIVOTS) and all(any((c == d).all() for d in distances[:29]) for c in seen.T)
    assert T._bins(np.arange(300, dtype=np.uint64)) is None and sum(T._bins(np.arange(200, dtype=np.uint64))) == 200


def test_simhash_keys():
    """Keys are places and values of the SimHash's own bits, the most decided of each half word; pairs at a similarity of 0.8 meet and are within the limits."""
    import numpy as np

    from kindred.llm import similar_texts as T

    r = np.random.default_rng(6)
    for n, far in ((5, T.FAR_SMALL), (20, T.FAR_SMALL), (45, T.FAR_SMALL), (180, T.FAR), (1800, T.FAR)):
        same = []
        for _ in range(60):
            a = r.integers(0, 2**64, n, dtype=np.uint64)
            (f, k), (g, m) = T._sketch(a), T._sketch(a[: n * 4 // 5])
            same.append(k == m)
            assert same[-1].any() and np.bitwise_count(f ^ g).sum() <= far
            code = k.astype(np.int64)
            assert list(code >> 12) == list(range(T.KEYS))
            bits = np.unpackbits(f.view(np.uint8), bitorder="little").reshape(-1, 2, 32)
            for half, low in ((0, 6), (1, 0)):
                c = code[: T.WORDS] >> low & 63
                assert list(bits[np.arange(T.WORDS), half, c >> 1]) == list(c & 1)
        assert np.mean(same) > 0.21
    a, b = (T._sketch(r.integers(0, 2**64, 200, dtype=np.uint64))[1] for _ in "ab")
    assert (a == b).sum() <= 2


def test_rows_without_own_ids(spark, tmp_path):
    """Null and shared ids, repeated rows and an extra column: each row is judged for itself, and no clean text is lost."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    text = lambda n=60: " ".join(r.sample(words, n))
    leak, clean = " ".join(r.sample(words, 20)), [text() for _ in range(8)]
    rows = [(None, clean[0]), (None, clean[1]), (None, clean[2]), (5, clean[3]), (5, clean[4]), (5, "bad"), (None, "bad"), (None, None), (5, None)]
    rows += [(None, text() + " " + leak), (5, text() + " " + leak), (6, clean[5]), (6, clean[5]), (None, clean[6]), (9, clean[6]), (None, clean[7]), (None, clean[7] + " x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_hash string"
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own") for i, t in rows], schema)
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, words[0])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out/{k}")
        docs = spark.read.parquet(f"{tmp_path}/out/{k}")
        assert docs.columns == df.columns
    got = [(x.doc_id, x.text) for x in docs.collect()]
    assert len(got) == len(set(got)) == 8
    assert set(got) - {(None, clean[7]), (None, clean[7] + " x")} == {(None, clean[0]), (None, clean[1]), (None, clean[2]), (5, clean[3]), (5, clean[4]), (6, clean[5]), (9, clean[6])}
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_queries_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
