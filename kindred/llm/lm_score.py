"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

A word is a run of word characters or one other mark, lower-cased, known by its 64-bit hash. Words of the corpus are counted, all of them; the table of counts stays
distributed and grows with the corpus. The VOCABULARY most frequent words (ties by hash) are tokens of
their own, the others share VOCABULARY / 8 tokens by their hash. For each place the network sees the tokens of WINDOW places on either side, not the place itself: their vectors,
each scaled by a vector of its offset, are added up, and tanh of that gives a softmax over CLASSES classes and a softmax over the tokens in the class, both learned. A word of a
shared token has the token's probability times its share by the counts, (n + 1/2) / (N + (kinds + 1) / 2), where the last half is for words never seen. So the
probabilities of all words sum to one in each context. A document's score is the sum of ln p(word | both sides) over all its places.

Training: each of ROUNDS rounds takes the documents with one remainder of a hash, all places of each; so in ROUNDS rounds every place of the corpus was predicted once.
Documents are dealt by a hash into shards of about SHARD words, whatever the cluster; each shard runs Adagrad from the common parameters in the order of a hash,
and the results are averaged with the number of updates of each row as weight (iterative parameter mixing), in groups of MIXED. So results depend on the
corpus, not on partitions, up to rounding. What the driver holds and sends is one set of parameters and 9/8 VOCABULARY tokens.

Null, empty and word-less texts have no places: n_tokens 0, score 0 and a null mean. Repeated rows get equal scores; each row gives a row. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.storage import discard, materialize, ship

#: Tokens of their own.
VOCABULARY = 4096
CLASSES, WINDOW, WIDTH = 32, 2, 16
ROUNDS, RATE, SHARD, MIXED = 2, 0.1, 4_000_000, 64
#: Places of one step, between these by the size of the corpus.
BATCH = (256, 16_384)
WORD = re.compile(r"\w+|[^\w\s]")
#: Words whose hash a worker remembers.
KNOWN = 300_000
#: Bytes of texts, words or ids that a worker takes and gives at once.
AT_ONCE = 1 << 20
OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]


class _Hashes(dict):
    """Hashes of words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < KNOWN:
            self[word] = h
        return h


_hashes = _Hashes()


def read(text: str | None) -> np.ndarray:
    """The hashes of a text's words."""
    words = WORD.findall((text or "").lower())
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)).view(np.int64)


def _slices(it: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows next to each other with about AT_ONCE bytes in a column, a row at least: what is made of them is held by both Python and the JVM."""
    for b in it:
        ends = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)]
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + AT_ONCE, side="right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def tokenise(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id and words (eight bytes for each) of each row, written once for all passes."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([read(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["doc_id", "words"])

    ship(docs.sparkSession)
    words = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, "doc_id long, words binary")
    return materialize(words.select(F.monotonically_increasing_id().alias("row"), "doc_id", "words"))


class Tokens:
    """Ids: 0 outside of a text, then tokens by falling frequency, so that a class is a range of ids."""

    def __init__(self, top: list[tuple[int, int]], shared: int, rest: dict[int, tuple[int, int]], total: int, counts: DataFrame | None = None):
        """top: (word, count) of the tokens of their own; shared: number of the others; rest: (count, kinds) of them."""
        self.counts, self.total, self.shared = counts, total, shared
        words, n = (np.array([x[i] for x in top], np.int64) for i in (0, 1))
        others, kinds = (np.array([rest.get(b, (0, 0))[i] for b in range(shared)], np.int64) for i in (0, 1))
        self.denominator = np.log(others + (kinds + 1) / 2)
        count = np.r_[n, others] + 0.5  # every token keeps some probability
        order = np.argsort(-count, kind="stable")
        ids = np.empty(len(order), np.int64)
        ids[order] = np.arange(1, len(order) + 1)
        sort = np.argsort(words, kind="stable")
        self.words, self.ids, self.other_ids = words[sort], ids[: len(words)][sort], ids[len(words) :]
        self.size = 1 + len(order)
        count = np.r_[0.0, count[order]]
        mass = np.cumsum(np.sqrt(count[1:]))
        group = np.minimum((mass - 1e-9) / mass[-1] * CLASSES, CLASSES - 1).astype(np.int64)
        #: First id of each class, and the end.
        self.edges = 1 + np.searchsorted(group, np.arange(CLASSES + 1))
        self.group = np.r_[0, group].astype(np.int32)
        in_class = np.bincount(self.group[1:], count[1:], CLASSES)
        self.class_bias = np.log((in_class + 1e-9) / in_class.sum()).astype(np.float32)
        with np.errstate(divide="ignore"):
            self.member_bias = np.where(count > 0, np.log(count), 0).astype(np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None}

    @property
    def batch(self) -> int:
        return min(BATCH[1], max(BATCH[0], self.total // 1024))

    def encode(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and the words that share tokens."""
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            own = self.words[at] == words
            out = self.ids[at]
        else:
            own, out = np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        rest = words[~own]
        out[~own] = self.other_ids[self.bucket(rest)]
        return out.astype(np.uint16), rest

    def bucket(self, words: np.ndarray) -> np.ndarray:
        return (words.view(np.uint64) % np.uint64(self.shared)).astype(np.int64)


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _hashes.clear()  # texts have been read
    held, size = [], 0

    def given() -> pa.RecordBatch:
        words = np.concatenate(held)
        words.sort()  # in place, as np.unique takes four times the words
        first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(words[first]), pa.array(np.diff(np.r_[first, len(words)]))], ["word", "n"])

    for b in it:
        for x in b.column(0):
            held.append(np.frombuffer(x.as_buffer(), np.int64))
            size += len(held[-1])
            if size >= 1 << 21:
                yield given()
                held, size = [], 0
    if size:
        yield given()


def vocabulary(words: DataFrame) -> Tokens:
    """The tokens of tokenised documents, from the counts of all their words."""
    ship(words.sparkSession)
    counts = materialize(words.select("words").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    shared = VOCABULARY // 8
    top = [(r.word, r.n) for r in counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]
    least = top[-1] if top else (0, 0)
    others = counts.where((F.col("n") < least[1]) | ((F.col("n") == least[1]) & (F.col("word") > least[0])))
    # an unsigned remainder of the 64-bit hash: the high bit is worth 2**63
    bucket = F.pmod(F.col("word").bitwiseAND(2**63 - 1) % shared + F.when(F.col("word") < 0, 2**63 % shared).otherwise(0), F.lit(shared))
    rest = {r.b: (r.n, r.kinds) for r in others.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()}
    return Tokens(top, shared, rest, total, counts)


def encode(words: DataFrame, tokens: Tokens) -> DataFrame:
    """row, doc_id, ids (two bytes for each token), share (ln of what shared tokens are divided by, negative), and the words that share tokens with their numbers; written."""
    sent = words.sparkSession.sparkContext.broadcast(tokens)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tokens = sent.value
        for b in _slices(it, 2):
            ids, share, rare, many = [], [], [], []
            for x in b.column(2):
                i, rest = t.encode(np.frombuffer(x.as_buffer(), np.int64))
                ids.append(i.tobytes())
                share.append(-float(t.denominator[t.bucket(rest)].sum()))
                w, n = np.unique(rest, return_counts=True)
                rare.append(w)
                many.append(n.astype(np.int32))
            columns = [b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(share, pa.float64()), pa.array(rare, pa.list_(pa.int64())), pa.array(many, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "ids", "share", "rare", "many"])

    return materialize(words.mapInArrow(batches, "row long, doc_id long, ids binary, share double, rare array<long>, many array<int>"))


class Network:
    """Parameters: token vectors, a scale for each offset, class weights and biases, member vectors and biases."""

    def __init__(self, tokens: Tokens, arrays: list[np.ndarray] | None = None):
        self.tokens = tokens
        if arrays is None:
            rng = np.random.default_rng(1)
            draw = lambda mean, *shape: rng.normal(mean, 0.1, shape).astype(np.float32)
            arrays = [draw(0, tokens.size, WIDTH), draw(1, len(OFFSETS), WIDTH), draw(0, WIDTH, CLASSES), tokens.class_bias.copy(), draw(0, tokens.size, WIDTH), tokens.member_bias.copy()]
        self.arrays = arrays

    def _hidden(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of all ids, and hidden values of all but the first and last WINDOW of them."""
        e = self.arrays[0].take(ids, 0)
        n = len(ids) - 2 * WINDOW
        x = e[WINDOW + OFFSETS[0] :][:n] * self.arrays[1][0]
        for o, scale in zip(OFFSETS[1:], self.arrays[1][1:], strict=True):
            x += e[WINDOW + o :][:n] * scale
        return e, np.tanh(x, out=x)

    def _classes(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """Targets in the order of their classes, and for each class its range in that order and its range of ids."""
        group = self.tokens.group[target]
        ends = np.cumsum(np.bincount(group, minlength=CLASSES)).tolist()
        edges = self.tokens.edges.tolist()
        ranges = [(lo, hi, edges[g], edges[g + 1]) for g, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if hi > lo]
        return np.argsort(group, kind="stable"), ranges

    def _exp(self, hidden: np.ndarray, weights: np.ndarray, bias: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, their exponentials and the sums of these for each row; the largest logit is taken off if it may be too large."""
        logits = hidden @ weights
        logits += bias
        if not safe:
            logits -= logits.max(1, keepdims=True)
        powers = np.exp(logits)
        return logits, powers, powers @ np.ones(powers.shape[1], powers.dtype)

    def _safe(self) -> bool:
        """Whether no logit can pass 80: hidden values are within 1."""
        _, _, weights, bias, members, member_bias = self.arrays
        return max(np.abs(weights).sum(0).max() + np.abs(bias).max(), np.abs(members).sum(1).max() + np.abs(member_bias).max()) < 80

    def log_p(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """ln p of the tokens at the places. ids: padded with WINDOW zeros on either side; at: places in it."""
        _, _, weights, bias, members, member_bias = self.arrays
        safe = self._safe()
        target = ids[at].astype(np.int64)
        order, ranges = self._classes(target)
        target = target[order]
        hidden = self._hidden(ids)[1][(at - WINDOW)[order]]
        logits, _, sums = self._exp(hidden, weights, bias, safe)
        got = logits[np.arange(len(at)), self.tokens.group[target]] - np.log(sums)
        for lo, hi, a, b in ranges:
            if b - a > 1:
                inside, _, sums = self._exp(hidden[lo:hi], members[a:b].T, member_bias[a:b], safe)
                got[lo:hi] += inside[np.arange(hi - lo), target[lo:hi] - a] - np.log(sums)
        out = np.empty_like(got)
        out[order] = got
        return out

    def gradients(self, ids: np.ndarray, at: np.ndarray) -> list[tuple]:
        """Of the mean of -ln p: (number of the array, rows, values)."""
        vectors, scales, weights, bias, members, member_bias = self.arrays
        safe = self._safe()
        target = ids[at].astype(np.int64)
        order, ranges = self._classes(target)
        target, place = target[order], (at - WINDOW)[order]
        e, everywhere = self._hidden(ids)
        hidden = everywhere[place]
        n = len(at)
        _, d, sums = self._exp(hidden, weights, bias, safe)
        d *= (1 / (n * sums))[:, None]
        d[np.arange(n), self.tokens.group[target]] -= 1 / n
        out = [(2, slice(None), hidden.T @ d), (3, slice(None), np.ones(n, d.dtype) @ d)]
        back = d @ weights.T
        for lo, hi, a, b in ranges:
            if b - a > 1:
                h = hidden[lo:hi]
                _, inside, sums = self._exp(h, members[a:b].T, member_bias[a:b], safe)
                inside *= (1 / (n * sums))[:, None]
                inside[np.arange(hi - lo), target[lo:hi] - a] -= 1 / n
                out += [(4, slice(a, b), inside.T @ h), (5, slice(a, b), np.ones(hi - lo, d.dtype) @ inside)]
                back[lo:hi] += inside @ members[a:b]
        back *= 1 - hidden * hidden
        full = np.zeros_like(everywhere)
        full[place] = back
        k = len(full)
        by_place, by_offset = np.zeros_like(e), np.empty_like(scales)
        for i, o in enumerate(OFFSETS):
            by_place[WINDOW + o :][:k] += full * scales[i]
            by_offset[i] = np.einsum("ij,ij->j", full, e[WINDOW + o :][:k])
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
        return [*out, (0, ids[order[first]].astype(np.int64), np.add.reduceat(by_place[order], first, axis=0)), (1, slice(None), by_offset)]


class Trainer:
    """Adagrad from given parameters, with the number of updates of each row."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate = Network(net.tokens, [a.copy() for a in net.arrays]), rate
        self.squares = [np.full(a.shape, 1e-8, np.float32) for a in net.arrays]
        self.updates = [np.zeros(len(a), np.float32) for a in net.arrays]

    def step(self, ids: np.ndarray, at: np.ndarray) -> None:
        for k, rows, g in self.net.gradients(ids, at):
            a, s = self.net.arrays[k], self.squares[k]
            square = s[rows] + g * g
            s[rows] = square
            np.sqrt(square, out=square)
            np.divide(g, square, out=square)
            square *= self.rate
            a[rows] -= square
            self.updates[k][rows] += 1


def _joined(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another with WINDOW zeros around each; where each begins, and its size."""
    pad = np.zeros(WINDOW, np.uint16)
    size = np.array([len(x) for x in held])
    begin = np.cumsum(np.r_[0, size[:-1] + WINDOW]) + WINDOW
    return np.concatenate([pad, *(y for x in held for y in (x, pad))]), begin, size


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _steps(texts: list[np.ndarray], batch: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of joined texts with about ``batch`` places each: ids and places in them."""
    ids, begin, size = _joined(texts)
    at = _places(begin, size)
    for lo in range(0, len(at), batch):
        own = at[lo : lo + batch]
        yield ids[own[0] - WINDOW : own[-1] + WINDOW + 1], own - own[0] + WINDOW


def _parts(texts: list[np.ndarray], size: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """Texts next to each other of about ``size`` places together."""
    held, n = [], 0
    for x in texts:
        held.append(x)
        n += len(x)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _train(sent, rate: float):
    """Reads (shard, ids) in the order of the shards; gives (part, node, sum, weight) for each shard and array."""

    def given(shard: int, trainer: Trainer) -> Iterator[pa.RecordBatch]:
        for k, (a, u) in enumerate(zip(trainer.net.arrays, trainer.updates, strict=True)):
            if u.any():  # rows times their weight, and the weights
                wide = (a.reshape(len(a), -1) * u[:, None]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([shard], pa.int64()), pa.array([wide.tobytes()]), pa.array([u.tobytes()])], ["part", "node", "sum", "weight"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = sent.value
        size = net.tokens.batch
        shard, trainer, texts, n = None, None, [], 0

        def learn() -> None:
            for ids, at in _steps(texts, size):
                trainer.step(ids, at)

        for b in it:
            for now, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if now != shard:
                    if texts:
                        learn()
                    if trainer is not None:
                        yield from given(shard, trainer)
                    shard, trainer, texts, n = now, Trainer(net, rate), [], 0
                texts.append(np.frombuffer(x.as_buffer(), np.uint16))
                n += len(texts[-1])
                if n >= 8 * size:
                    learn()
                    texts, n = [], 0
        if texts:
            learn()
        if trainer is not None:
            yield from given(shard, trainer)

    return batches


def _mix(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The sum of what up to MIXED shards (or groups of them) sent for one array, in a fixed order."""
    rows = sorted(zip(table["node"].to_pylist(), table["sum"], table["weight"], strict=True), key=lambda r: r[0])
    total, weight = (sum(np.frombuffer(r[i].as_buffer(), np.float32).astype(np.float64) for r in rows) for i in (1, 2))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([key[1].as_py()], pa.int64()), "sum": [total.astype(np.float32).tobytes()], "weight": [weight.astype(np.float32).tobytes()]})


def train(encoded: DataFrame, tokens: Tokens, rounds: int = ROUNDS, share: int = ROUNDS, shard: int = SHARD) -> Network:
    """The network for encoded documents; a round trains on one in ``share`` of them, another one in each of ``share`` rounds."""
    context = encoded.sparkSession.sparkContext
    ship(encoded.sparkSession)
    net, kind = Network(tokens), "part int, node long, sum binary, weight binary"
    shards = max(1, -(-tokens.total // (share * shard)))
    hashed = encoded.where(F.length("ids") > 0).select("ids", F.xxhash64("doc_id", "ids").alias("h"))
    hashed = hashed.select("ids", F.pmod("h", F.lit(share)).alias("turn"), F.pmod(F.shiftrightunsigned("h", 16), F.lit(shards)).alias("shard"), "h")
    for r in range(rounds):
        sent = context.broadcast(net)
        own = hashed.where(F.col("turn") == r % share).repartition("shard").sortWithinPartitions("shard", "h")
        nodes = own.select("shard", "ids").mapInArrow(_train(sent, RATE / (1 + r)), kind)
        left = shards
        while True:
            nodes = nodes.withColumn("upper", F.floor(F.col("node") / MIXED)).groupBy("part", "upper").applyInArrow(_mix, kind)
            left = -(-left // MIXED)
            if left == 1:
                break
        arrays = [a.copy() for a in net.arrays]
        for m in nodes.collect():  # one row for each array
            a = arrays[m.part]
            weight = np.frombuffer(bytes(m.weight), np.float32)
            values = np.frombuffer(bytes(m.sum), np.float32).reshape(len(a), -1)
            hit = weight > 0
            a.reshape(len(a), -1)[hit] = values[hit] / weight[hit, None]
        net = Network(tokens, arrays)
        sent.unpersist()
    return net


def score(encoded: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_tokens, score (sum of ln p) and mean_score of each encoded row."""
    sent = encoded.sparkSession.sparkContext.broadcast(net)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = sent.value
        for b in _slices(it, 2):
            texts = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(2)]
            log_p = [net.log_p(ids, at).astype(np.float64) for some in _parts(texts) for ids, at in _steps(some, 1 << 14)]
            ends = np.r_[0.0, np.cumsum(np.concatenate([np.empty(0), *log_p]))]
            size = np.array([len(x) for x in texts], np.int64)
            last = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array(ends[last] - ends[last - size])], ["row", "doc_id", "n_tokens", "known"])

    known = encoded.select("row", "doc_id", "ids").mapInArrow(batches, "row long, doc_id long, n_tokens long, known double")
    rare = encoded.select("row", F.inline(F.arrays_zip("rare", "many"))).withColumnRenamed("rare", "word")
    met = rare.join(net.tokens.counts, "word", "left").groupBy("row").agg(F.sum(F.col("many") * F.log(F.coalesce("n", F.lit(0)) + 0.5)).alias("shares"))
    base = encoded.select("row", "share")
    total = F.col("known") + F.col("share") + F.coalesce("shares", F.lit(0.0))
    out = known.join(base.join(met, "row", "left"), "row").select("doc_id", "n_tokens", total.alias("score"))
    return out.withColumn("mean_score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")))


def fit_score(docs: DataFrame) -> DataFrame:
    """The scores of documents under the network that is trained on them."""
    words = tokenise(docs)
    tokens = vocabulary(words)
    encoded = encode(words, tokens)
    discard(words)
    return score(encoded, train(encoded, tokens))
