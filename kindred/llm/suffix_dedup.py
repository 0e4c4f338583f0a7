"""Removal of repeated byte strings by a depth-limited most-significant-digit radix sort of suffixes.

Suffixes are told apart by their first ``length`` bytes only; suffixes that agree on them form one group,
and a group is exactly the set of places where one ``length``-byte string stands. The sort runs in passes, each over a longer
digit, and every pass drops what can't repeat, so that few suffixes reach the last one:

1. The first digit of a suffix is its anchor: the ``GRAM``-byte string with the smallest hash in the suffix's first
   ``length`` bytes (leftmost of equals). Equal strings have equal anchors at equal distances. Neighbouring suffixes
   share their anchor, so a run of them with one anchor is one row. Groups of one row end here.
2. The second digit is the whole stretch that the run's suffixes cover. In a group of equal stretches all but the first
   repeat, suffix by suffix; only the first goes on, and only if other stretches have the same anchor.
3. The runs left are cut into CLASSES by the anchor's distance from the suffix. The digit is now the string that all suffixes of a class have in
   common, and equal stretches of a class are treated as in the second pass.
4. For suffixes of the classes left the digit is the full string. All but the first of a group repeat.

Digits are compared by 64-bit polynomial hashes, always two of them that are independent (anchor and stretch, common string and string).
Rows of a digit are sorted by Spark and read as a stream, so a group is never gathered, however many rows it has. Before the shuffle
rows are combined: of rows of one part of a task that agree, all but the first are known to repeat. They don't go to their
group's task but are dealt by their place (with a negative number, as a mark), so text that repeats itself makes no hot task.

"Earlier" is by (doc_id, start). Null text is empty. A null doc_id comes before all others. A row is known by its doc_id and a tag, which is a
hash of the text where doc_ids are null or name several texts, and else 0 (ids share tags by buckets, so what is sent for it is bounded). So texts under
one doc_id are documents of their own, each earlier or later than the others by its tag, and no span of one is cut from another. Rows that repeat
both doc_id and text have equal results; none of them is earlier than the other. Every row gives one row. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.sources.storage import materialize, release, ship

GRAM = 36
#: Parts of a run in the third pass.
CLASSES = 4
#: A row's n holds the number of its suffixes in the low bits, and in pass 1 the anchor's distance from the first above them.
LOW = 15
#: Bytes that are hashed at once; longer texts are read in overlapping parts.
PART = 1 << 19
#: Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
NULL_ID = -(2**63)
#: Buckets of doc_ids that share whether tags are needed.
BUCKETS = 1 << 16

ROW = ["anchor", "digit", "id", "tag", "start", "n"]

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if n not in _powers:
        size = 1 << (n - 1).bit_length()
        if size not in _powers:
            up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return _powers[size]
    return _powers[n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Hashes:
    """Hashes of any stretches of a byte array."""

    def __init__(self, data: np.ndarray):
        up, down = _power(len(data) + 1)
        self.up = up
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))

    def all(self, n: int) -> np.ndarray:
        """Of every stretch of n bytes."""
        k = len(self.sums) - n
        return _mix((self.sums[n:] - self.sums[:k]) * self.up[:k] + np.uint64(n))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _runs(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one anchor: anchor hash, stretch hash, first suffix, n (number and distance of the anchor). valid: suffixes that count."""
    h = _Hashes(data)
    grams = h.all(GRAM)
    low = np.uint64((1 << 20) - 1)
    anchor = (_sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1) & low).astype(np.int64)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(anchor)])
    first, count = first[valid[first]], count[valid[first]]
    return grams[anchor[first]].view(np.int64), h.of(first, first + count - 1 + length).view(np.int64), first, count | ((anchor[first] - first) << LOW)


def _combined(rows: list[np.ndarray]) -> pa.RecordBatch:
    """(anchor, digit, id, tag, start, n) with n negative (and no digits) for rows that agree with an earlier one here."""
    anchor, digit, ids, tag, start, n = rows
    both = anchor.view(np.uint64) * np.uint64(BASE) ^ digit.view(np.uint64)
    order = np.lexsort((start, tag, ids, both))
    a, d, i, t, s = anchor[order], digit[order], ids[order], tag[order], start[order]
    same = np.r_[False, (a[1:] == a[:-1]) & (d[1:] == d[:-1])] if len(a) else np.empty(0, bool)
    first = np.flatnonzero(~same)
    lead = np.repeat(first, np.diff(np.r_[first, len(a)]))
    known = order[same & ((i != i[lead]) | (t != t[lead]) | (s != s[lead]))]
    anchor, digit, n = anchor.copy(), digit.copy(), n.astype(np.int32)
    anchor[known] = digit[known] = 0
    n[known] *= -1
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, digit, ids, tag, start, n)], ROW)


def _anchors(length: int, part_bytes: int):
    def parts(b: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[int], list[bytes]]]:
        """Texts, or overlapping parts of long ones, of about part_bytes bytes together: ids, tags, places in the text, bytes."""
        held, total = ([], [], [], []), 0
        for i, tag, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            t = t.as_buffer()
            for start in range(0, max(len(t) - length + 1, 0), part_bytes):
                part = t[start : start + part_bytes + length - 1]
                for x, v in zip(held, (i, tag, start, part), strict=True):
                    x.append(v)
                total += len(part)
                if total >= part_bytes:
                    yield held
                    held, total = ([], [], [], []), 0
        if total:
            yield held

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for ids, tags, at, data in parts(b):
                sizes = np.array([len(x) for x in data])
                ends = np.cumsum(sizes)
                joined = np.frombuffer(b"".join(data), np.uint8)
                inside = np.ones(len(joined) + 1, bool)
                for e in ends:
                    inside[e - length + 1 : e] = False
                anchor, stretch, first, count = _runs(joined, inside[: len(joined) - length + 1], length)
                which = np.searchsorted(ends, first, side="right")
                start = first - (ends - sizes)[which] + np.array(at)[which]
                yield _combined([anchor, stretch, np.array(ids, np.int64)[which], np.array(tags, np.int64)[which], start, count])

    return batches


def _later(again: bool):
    """Reads (anchor, digit, id, tag, start, n) in this order. Gives kind 0: runs that an earlier row has too; if ``again``, kind 1: first rows
    of their digit in a group with several digits."""
    schema = pa.schema([("kind", pa.int8()), ("anchor", pa.int64()), ("id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])

    def out(kind: int, rows: list[np.ndarray], pick: np.ndarray) -> pa.RecordBatch:
        k = np.full(len(pick), kind, np.int8)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k, rows[0][pick] * kind, *(x[pick] for x in rows[2:]))], schema=schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last first row seen, and whether it is given out
        given = False
        for b in it:
            if not b.num_rows:
                continue
            rows = [b.column(i).to_numpy() for i in range(6)]
            known = rows[5] < 0
            if known.any():
                rows[5] = np.abs(rows[5])
                yield out(0, rows, np.flatnonzero(known))
                rows = [x[~known] for x in rows]
                if not len(rows[0]):
                    continue
            if held is not None:
                rows = [np.concatenate(p) for p in zip(held, rows, strict=True)]
            a, digit = rows[0], rows[1]
            same = (a[1:] == a[:-1]) & (digit[1:] == digit[:-1])
            first = np.flatnonzero(np.r_[True, ~same])
            lead = np.repeat(first, np.diff(np.r_[first, len(a)]))
            later = np.flatnonzero((rows[2] != rows[2][lead]) | (rows[3] != rows[3][lead]) | (rows[4] != rows[4][lead]))
            if len(later):
                yield out(0, rows, later)
            if again:
                joined = np.r_[False, a[first][1:] == a[first][:-1]]
                several = joined | np.r_[joined[1:], False]
                fresh = several.copy()
                fresh[0] &= not given
                if fresh.any():
                    yield out(1, rows, first[fresh])
                given = bool(several[-1]) or (given and len(first) == 1)
            held = [x[first[-1] : first[-1] + 1] for x in rows]

    return batches


def _suffixes(h: _Hashes, anchor: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> list[np.ndarray]:
    """A row for each suffix of the rows: anchor, hash of its string, start, n."""
    n = n & ((1 << LOW) - 1)
    at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return [np.repeat(anchor, n), h.of(at, at + length).view(np.int64), at, np.ones(len(at), np.int64)]


def _classes(h: _Hashes, anchor: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> list[np.ndarray]:
    """A row for each class of suffixes of the rows: hash of what they have in common, of their stretch, first suffix, number."""
    width = -(-(length - GRAM + 1) // CLASSES)
    far, n = n >> LOW, n & ((1 << LOW) - 1)
    place, near = start + far, far - n + 1  # the anchor's, and its distance from the last suffix
    count = far // width - near // width + 1
    which = np.repeat(np.arange(len(n)), count)
    c = near[which] // width + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum((c + 1) * width - 1, length - GRAM)  # the largest distance in the class
    common = h.of(place[which] - c * width, place[which] - last + length) + c.astype(np.uint64)
    high, low = np.minimum(far[which], last), np.maximum(near[which], c * width)
    first = place[which] - high
    return [common.view(np.int64), h.of(first, place[which] - low + length).view(np.int64), first, high - low + 1]


def _within(rows_of, length: int, part_bytes: int):
    """Reads (id, tag, text, rows); gives what ``rows_of`` makes of them."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        total = 0
        for b in it:
            for i, tag, t, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                data = np.frombuffer(t.as_buffer(), np.uint8)
                anchor, start, n = (x.to_numpy() for x in runs.values.flatten())
                order = np.argsort(start, kind="stable")
                anchor, start, n = anchor[order], start[order], n[order].astype(np.int64)
                for lo in range(0, len(data), part_bytes):  # rows that begin here; a stretch is shorter than two strings
                    pick = (start >= lo) & (start < lo + part_bytes)
                    if not pick.any():
                        continue
                    got = rows_of(_Hashes(data[lo : lo + part_bytes + 2 * length]), anchor[pick], start[pick] - lo, n[pick], length)
                    k = len(got[0])
                    held.append([got[0], got[1], np.full(k, i), np.full(k, tag), got[2] + lo, got[3]])
                    total += k
                    if total >= part_bytes:
                        yield _combined([np.concatenate(x) for x in zip(*held, strict=True)])
                        held, total = [], 0
        if held:
            yield _combined([np.concatenate(x) for x in zip(*held, strict=True)])

    return batches


def _cut(length: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[list] = [[], [], [], []]
            for t, runs in zip(b.column(2), b.column(3), strict=True):
                data, spans = t.as_buffer(), []
                if runs.is_valid and len(runs.values):
                    start, n = (x.to_numpy() for x in runs.values.flatten())
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], np.maximum.accumulate((start + n - 1 + length)[order])
                    new = np.r_[True, start[1:] > end[:-1]]
                    at = np.flatnonzero(new)
                    spans = list(zip(start[at].tolist(), end[np.r_[at[1:], len(end)] - 1].tolist(), strict=True))
                digest, last = hashlib.sha256(), 0
                view = memoryview(data)
                for s, e in spans:
                    digest.update(view[last:s])
                    last = e
                digest.update(view[last:])
                for x, v in zip(out, (len(view), spans, sum(e - s for s, e in spans), digest.hexdigest()), strict=True):
                    x.append(v)
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out[0], pa.int64()), pa.array([[{"start": s, "end": e} for s, e in x] for x in out[1]], spans_type), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())],
                ["id", "tag", "n_bytes", "spans", "n_removed", "kept_sha256"],
            )

    return batches


def repeated_spans(docs: DataFrame, length: int = 100, part_bytes: int = PART) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end in bytes: the maximal removed runs), n_removed and kept_sha256 of each row.

    ``length``: bytes of a string that may not repeat, over GRAM. ``part_bytes``: hashed at once.
    """
    if not GRAM < length < 1 << LOW:
        raise ValueError(f"length must be over {GRAM} and under {1 << LOW}")
    spark = docs.sparkSession
    ship(spark)
    rows = "anchor long, digit long, id long, tag long, start long, n int"
    found = "kind byte, anchor long, id long, tag long, start long, n int"
    text = _tagged(docs)
    key = ["id", "tag"]

    def later(made: DataFrame, again: bool, *by: str) -> DataFrame:
        """What repeats, and what goes on, among rows that are dealt by ``by``."""
        deal = F.when(F.col("n") > 0, F.xxhash64(*by)).otherwise(F.xxhash64(*key, "start"))
        return made.repartition(deal).sortWithinPartitions("anchor", "digit", *key, "start").mapInArrow(_later(again), found)

    def within(rest: DataFrame, rows_of) -> DataFrame:
        """Rows of the texts that have some left."""
        left = rest.where("kind = 1").groupBy(*key).agg(F.collect_list(F.struct("anchor", "start", "n")).alias("runs"))
        return text.join(left, key).select(*key, "text", "runs").mapInArrow(_within(rows_of, length, part_bytes), rows)

    runs = materialize(later(text.select(*key, "text").mapInArrow(_anchors(length, part_bytes), rows), True, "anchor"))
    release(spark)  # the first exchange is the largest
    # these aren't written: in one plan with the cut below, all read one exchange of the texts
    classes = later(within(runs, _classes), True, "anchor")
    strings = later(within(classes, _suffixes), False, "anchor", "digit")
    removed = [x.where("kind = 0").select(*key, "start", F.col("n").bitwiseAND((1 << LOW) - 1).alias("n")) for x in (runs, classes, strings)]
    spans = removed[0].union(removed[1]).union(removed[2]).groupBy(*key).agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    cut = text.join(spans, key, "left").select(*key, "text", "runs")
    out = cut.mapInArrow(_cut(length), "id long, tag long, n_bytes long, spans array<struct<start:long,end:long>>, n_removed long, kept_sha256 string")
    return out.select(F.when(~_nameless(), F.col("id")).alias("doc_id"), "n_bytes", "spans", "n_removed", "kept_sha256")


def _nameless() -> Column:
    return (F.col("id") == NULL_ID) & (F.col("tag").bitwiseAND(1) == 1)


def _tagged(docs: DataFrame) -> DataFrame:
    """text (bytes) and the key (id, tag) of each row; tags are odd where doc_id is null, and else even."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
    hashed = rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
    several = hashed.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high")
    odd = materialize(several.select(bucket.alias("odd")).distinct())  # BUCKETS rows at most
    marked = rows.join(F.broadcast(odd), bucket == F.col("odd"), "left")
    own = F.xxhash64("text")
    tag = F.when(F.col("doc_id").isNull(), own.bitwiseOR(F.lit(1).cast("long"))).when(F.col("odd").isNotNull(), own.bitwiseAND(F.lit(-2).cast("long"))).otherwise(F.lit(0).cast("long"))
    return marked.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), tag.alias("tag"), "text")
