"""Packing of token sequences by minimum bin slack.

Each document's ids are cut into pieces of at most ``size``: full ones and a rest. Only the number of pieces of each
length matters for the plan, at most ``size`` numbers however many documents there are. For each window the plan
takes the longest piece left and the multiset of other lengths that comes closest to the capacity: reachable sums are
bits of one integer, a length that is there c times is folded in by shifted copies of 1, 2, 4, ... pieces, and
stepping back through the bitsets gives the counts. A window's multiset is used as often as the numbers allow.

The pieces then find their places by their rank among pieces of their length. Ranks come from counts of (length, bucket)
and row numbers inside a bucket, so that a length that a third of all pieces have is dealt over all buckets.

Null text is empty: a document of the end id only. Rows that repeat a doc_id are documents of their own: each row's pieces are placed.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.sources.storage import materialize, ship

#: Encoded words kept in a worker.
CACHE = 1_000_000
#: Rows that a rank bucket should have, and the fewest buckets.
BUCKET_ROWS, BUCKETS = 50_000, 256


class Encoder:
    """Ids of whole texts. The tokenizer drops white space and never joins words over it, so a word's ids are kept.

    Nor does it join a letter and a mark, so marks at the end of a word are a word of their own; and case doesn't count. New words of letters are
    one unit of the tokenizer each: they are encoded together, one space between them, and each ends with a word-end token. All other words are encoded one by one.
    """

    #: Letters of one unit. All stay letters under the tokenizer's normaliser.
    PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    #: ASCII marks after such a letter, up to white space or the end; not the apostrophe, which may begin a unit with letters.
    MARKS = re.compile("[!-&(-/:-@[-`{-~](?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff].)[!-&(-/:-@[-`{-~]*(?![^ \t\n])")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.words: dict[str, bytes] = {}
        added = {x for t in self.tokenizer.get_added_tokens_decoder().values() for x in (t.content, t.content.lower())}
        #: Tokens that are found in texts as they stand, and what could become one by its case.
        self.added = re.compile("|".join(map(re.escape, sorted(added))) or "(?!)")

    def _units(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words of one unit."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends[ids])
        if len(last) == len(units) and last[-1] == len(ids) - 1:
            data, at = ids.tobytes(), (4 * (last + 1)).tolist()
            return zip(units, map(data.__getitem__, map(slice, [0, *at[:-1]], at)), strict=True)
        got = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        return ((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(units, got, strict=True))

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        plain = list(filter(self.PLAIN.fullmatch, words))
        low = list(map(str.lower, plain))
        units, out = list(set(low)), {}
        for i in range(0, len(units), 5_000):
            out.update(self._units(units[i : i + 5_000]))
        out = dict(zip(plain, map(out.__getitem__, low), strict=True))
        other = list(set(words).difference(plain)) if len(plain) < len(words) else []
        for i in range(0, len(other), 5_000):
            got = self.tokenizer.encode_batch_fast(other[i : i + 5_000], add_special_tokens=False)
            out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(other[i : i + 5_000], got, strict=True))
        return out

    def _split(self, text: str) -> list[str]:
        """Words, with marks at their end as words, in lower case if that is sure to be the tokenizer's."""
        # Python's split also cuts at four control characters that the tokenizer doesn't take for white space
        if _CONTROLS.search(text):
            return [w for w in re.split("[ \t\n]", text) if w]
        low = text if _WIDE.search(text) else text.lower()
        return (text if self.added.search(low) else self.MARKS.sub(r" \g<0>", low)).split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = list(map(self._split, texts))
        known = self.words
        new = list(set(chain.from_iterable(split)).difference(known))
        room = max(0, CACHE - len(known))
        known.update(self._encode(new))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in new[room:]:
            del known[w]
        return out


_CONTROLS = re.compile("[\x1c-\x1f]")
_WIDE = re.compile("[^\x00-\xff]")
_encoders: dict[str, Encoder] = {}


def _pieces(path: str, end: int, size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    last = np.array([end], "<u4").tobytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        for b in it:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                rows: list[tuple] = []
                for i, ids in zip(part.column(0).to_pylist(), _encoders[path].encode(part.column(1).to_pylist()), strict=True):
                    data = ids + last
                    n = len(data) // 4
                    rows.extend((i, s, min(size, n - s), zlib.crc32(data[4 * s : 4 * (s + size)]), n) for s in range(0, n, size))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return batches


def fullest(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """The multiset, as (length, times), whose sum is the largest that is at most ``room``; lengths come in falling order."""
    full, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # the sums reachable before, the length, pieces folded in
    for length, count in zip(lengths, counts, strict=True):
        left, k = min(count, room // length), 1
        while left:
            k = min(k, left)
            steps.append((reach, length, k))
            reach |= (reach << (k * length)) & full
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    took: dict[int, int] = {}
    for before, length, k in reversed(steps):
        if not before >> total & 1:
            took[length] = took.get(length, 0) + k
            total -= k * length
    return list(took.items())


def plan(numbers: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, pieces)]) for each kind of window. numbers: of pieces, by length."""
    left = dict(sorted(((x, n) for x, n in numbers.items() if n), reverse=True))
    out = []
    while left:
        longest = next(iter(left))
        left[longest] -= 1
        rest = [(x, n) for x, n in left.items() if n and x <= size - longest]
        took = dict(fullest([x for x, _ in rest], [n for _, n in rest], size - longest))
        left[longest] += 1
        took[longest] = took.get(longest, 0) + 1
        times = min(left[x] // k for x, k in took.items())
        for x, k in took.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
        out.append((times, sorted(took.items(), reverse=True)))
    return out


def _places(windows: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length: rows of first rank, first sequence, pieces of this length in a window, offset of the first."""
    out: dict[int, list] = {}
    given: dict[int, int] = {}
    sequence = 0
    for times, took in windows:
        offset = 0
        for length, k in took:
            rank = given.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, k, offset))
            given[length] = rank + times * k
            offset += k * length
        sequence += times
    return {x: np.array(rows, np.int64).T for x, rows in out.items()}


def _place(places: dict[int, np.ndarray], names: list[str]):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            values, at = np.unique(length[order], return_index=True)
            for x, rows in zip(values.tolist(), np.split(order, at[1:]), strict=True):
                first, base, k, begin = places[x]
                i = np.searchsorted(first, rank[rows], side="right") - 1
                inside = rank[rows] - first[i]
                sequence[rows] = base[i] + inside // k[i]
                offset[rows] = begin[i] + inside % k[i] * x
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return batches


def pack(docs: DataFrame, tokenizer: str, end: int = 2, size: int = 4096) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece of the rows' ids."""
    ship(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = materialize(text.mapInArrow(_pieces(tokenizer, end, size), columns))
    numbers = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    places = _places(plan(numbers, size))
    buckets = max(BUCKETS, sum(numbers.values()) // BUCKET_ROWS)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(before.select("length", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = dealt.withColumn("inside", inside).join(before, ["length", "bucket"]).select(*names, (F.col("before") + F.col("inside") - 1).alias("rank"))
    return ranked.mapInArrow(_place(places, names), f"{columns}, sequence_id long, offset long")
