"""Texts to vectors, and pairs of texts to scores, by functions over Arrow batches; a latent semantic encoder that is fitted here.

An encoder is any function from a list of texts to a matrix with a row for each, a pair scorer any function from two lists to a value for each pair;
both run in the executors' Python workers, so they must pickle. Null counts as the empty text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.decide import in_band, rerank
from kindred.sources.storage import materialize, ship

FEATURES, WIDTH = 1024, 64
#: Rows that an encoder is fitted on at most; all rows are encoded.
SAMPLE = 100_000
BLOCK = 512


def grams(text: str) -> Counter:
    """Numbers of the features of a text: hashed character 3- and 4-grams inside words with a space at either end."""
    out: Counter = Counter()
    for word in text.split():
        padded = f" {word} "
        for n in (3, 4):
            out.update(crc32(padded[i : i + n].encode("utf-8", "surrogatepass")) % FEATURES for i in range(max(1, len(padded) - n + 1)))
    return out


def counted(texts: list[str | None]) -> np.ndarray:
    """A row of 1 + ln(number) for each text, zero where a feature is absent."""
    out = np.zeros((len(texts), FEATURES))
    for row, t in zip(out, texts, strict=True):
        for i, n in grams(t or "").items():
            row[i] = 1 + np.log(n)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Latent:
    """TF-IDF of hashed character grams, projected on its leading right singular vectors; rows of length one, empty texts zero."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray):
        self.idf, self.axes = idf, axes

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return unit_rows(unit_rows(counted(texts) * self.idf) @ self.axes)


def _sums(weigh: Callable[[np.ndarray], np.ndarray]):
    """One row for each task: the sum of ``weigh`` over its blocks, and its number of rows."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for b in it:
            texts = b.column(0).to_pylist()
            for i in range(0, len(texts), BLOCK):
                total = total + weigh(counted(texts[i : i + BLOCK]))
            n += len(texts)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.asarray(total).tobytes()], pa.binary())], ["n", "total"])

    return batches


def fit_latent(records: DataFrame, column: str, width: int = WIDTH, sample: int = SAMPLE) -> Latent:
    """The encoder for a column, fitted on at most ``sample`` of its texts (by hash order). Eight tasks send a matrix of FEATURES x FEATURES each."""
    ship(records.sparkSession)
    some = materialize(records.select(F.col(column).alias("t")).orderBy(F.xxhash64("t"), "t").limit(sample).repartition(8))

    def summed(weigh, shape: tuple[int, ...]) -> tuple[int, np.ndarray]:
        got = sorted((r.n, bytes(r.total)) for r in some.mapInArrow(_sums(weigh), "n long, total binary").collect())
        return sum(n for n, _ in got), sum((np.frombuffer(x).reshape(shape) for _, x in got), np.zeros(shape))

    n, seen = summed(lambda x: (x > 0).sum(0).astype(float), (FEATURES,))
    idf = np.log((1 + n) / (1 + seen)) + 1

    def products(x: np.ndarray) -> np.ndarray:
        x = unit_rows(x * idf)
        return x.T @ x

    _, square = summed(products, (FEATURES, FEATURES))
    _, vectors = np.linalg.eigh(square)
    axes = vectors[:, ::-1][:, :width]
    return Latent(idf, axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1))


def encode(records: DataFrame, column: str, encoder: Callable[[list[str | None]], np.ndarray], key: str = "entity_id") -> DataFrame:
    """key and vector (array<double>) of each row."""
    ship(records.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(1).to_pylist()
            rows = [r for i in range(0, len(texts), BLOCK) for r in np.asarray(encoder(texts[i : i + BLOCK]), np.float64)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], [key, "vector"])

    kind = dict(records.dtypes)[key]
    return records.select(key, column).mapInArrow(batches, f"`{key}` {kind}, vector array<double>")


def gated_rerank(scored: DataFrame, left: DataFrame, right: DataFrame, scorer: Callable[[list[str], list[str]], np.ndarray], centre: float = 0.75, margin: float = 0.10, logits: bool = False) -> DataFrame:
    """``scored`` with the scores in the band blended with a pair scorer's, and reranked_by_D. left, right: entity_id, text of either side.

    Only pairs in the band get their texts and meet the scorer; an entity that has no text counts as an empty one.
    """
    ship(scored.sparkSession)
    side = lambda t, i, c: t.select(F.col("entity_id").alias(i), F.col("text").alias(c))
    pairs = scored.where(in_band(F.col("score"), centre, margin)).select("s1_id", "candidate_id")
    pairs = pairs.join(side(left, "s1_id", "a"), "s1_id", "left").join(side(right, "candidate_id", "b"), "candidate_id", "left")
    texts = pairs.select("s1_id", "candidate_id", F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            said = np.asarray(scorer(b.column(2).to_pylist(), b.column(3).to_pylist()), np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said)], ["s1_id", "candidate_id", "pair_score"])

    kinds = dict(scored.dtypes)
    said = texts.mapInArrow(batches, f"s1_id {kinds['s1_id']}, candidate_id {kinds['candidate_id']}, pair_score double")
    return rerank(scored.join(said, ["s1_id", "candidate_id"], "left"), F.col("pair_score"), centre, margin, logits).drop("pair_score")
