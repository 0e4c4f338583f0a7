"""Benchmark decontamination by q-gram lemma filtering.

Text and items are compared after lowering case and writing each run of white space as one space. An item of m characters is in a
text if some stretch of the text is within ``budget`` edits of it (k = floor(rate * m)). By the q-gram lemma such a stretch shares at
least m - q + 1 - k * q of the item's q-grams, on diagonals (text place minus item place) that differ by at most 2k. Diagonals are cut in
bands of width 4k + 4 that overlap by 2k + 1, so one band holds them all; bands with fewer hits are discarded, and a banded
alignment verifies the rest exactly.

Hits are counted in slices of ``SLICE``, in the order of the text, and an item that was found without edits needs no more hits in that text, so texts and items
that repeat a q-gram over and over take bounded memory.

Items are sent to the executors in blocks of at most ``BLOCK_CHARS`` characters; a larger benchmark takes more passes over the texts, so what is
sent has a fixed bound. Items under ``MIN_CHARS`` characters share too few q-grams for the lemma; they are found as whole words without edits (Aho and Corasick's automaton),
and item_chars lets callers weigh such evidence. Empty and null items match nothing; equal items all match, each by its item_id, which may be null. Null texts hold nothing.
Each (row, item) gives one result row, for the closest stretch (the first of equals); rows that repeat a doc_id give a row each, told apart by text_hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.texts import text_hash
from kindred.sources.storage import ship

Q, RATE, MIN_CHARS = 10, 0.06, 30
BLOCK_CHARS = 4_000_000
#: Pairs of a text place and an item place that are counted at once.
SLICE = 4_000_000
#: Text characters that are looked up at once.
PART = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(Q):
        h *= BASE
        h += codes[i : i + n].astype(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Index:
    """The q-grams of a block of items, and the short items themselves."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        short = [(i, t) for i, t in items if len(t) < MIN_CHARS]
        long = [(i, t) for i, t in items if len(t) >= MIN_CHARS]
        self.short: dict[str, list[int]] = {}
        for i, t in short:
            self.short.setdefault(t, []).append(i)
        self.automaton = None
        self.ids = [i for i, _ in long]
        self.codes = [_codes(t) for _, t in long]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.budget = (rate * self.size).astype(np.int64)
        self.width = 4 * self.budget + 4
        self.step = self.width - 2 * self.budget - 1
        self.need = np.maximum(1, self.size - Q + 1 - self.budget * Q)
        grams = [_grams(c) for c in self.codes] or [np.empty(0, np.uint64)]
        h = np.concatenate(grams)
        item = np.repeat(np.arange(len(long)), [len(g) for g in grams[: len(long)]])
        at = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(h, kind="stable")
        self.hash, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.item, self.at = item[order], at[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hash >> np.uint64(42)).astype(np.int64)] = True

    def find_short(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, start, end, characters) of the first place of each short item that stands in a normal text as whole words."""
        if not self.short:
            return
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for t in self.short:
                self.automaton.add_word(t, t)
            self.automaton.make_automaton()
        seen = set()
        for last, t in self.automaton.iter(text):
            start, end = last + 1 - len(t), last + 1
            if t not in seen and (start == 0 or text[start - 1] == " ") and (end == len(text) or text[end] == " "):
                seen.add(t)
                for i in self.short[t]:
                    yield i, start, end, len(t)

    def find(self, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of the closest stretches. codes: normal texts one after another; starts: where they begin."""
        h = _grams(codes)
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        slot = np.searchsorted(self.hash, h[maybe])
        slot[slot == len(self.hash)] = 0
        hit = self.hash[slot] == h[maybe]
        place, slot = maybe[hit], slot[hit]
        if not len(place):
            return []
        ends = np.r_[starts[1:], len(codes)]
        bands = int((ends - starts).max() + self.size.max()) // int(self.step.min()) + 2
        items = len(self.ids)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        known, counted = np.empty(0, np.int64), np.empty(0, np.int64)  # bands and their hits so far
        exact = np.empty(0, np.int64)  # pairs that need no more
        total = np.cumsum(self.count[slot])
        cut = [0, *np.flatnonzero(np.diff(total // SLICE) > 0) + 1, len(place)]
        for lo, hi in zip(cut, cut[1:], strict=False):
            for keys in self._bands(place[lo:hi], slot[lo:hi], starts, bands, exact):
                values, after = np.unique(keys, return_counts=True)
                before = np.zeros(len(values), np.int64)
                if len(known):  # a later slice
                    values, index = np.unique(np.r_[known, values], return_inverse=True)
                    before = np.bincount(index[: len(known)], counted, len(values)).astype(np.int64)
                    after = before + np.bincount(index[len(known) :], after, len(values)).astype(np.int64)
                need = self.need[values // bands % items]
                fresh = values[(after >= need) & (before < need)]
                known, counted = values, after
                for text, item, band in zip((fresh // bands // items).tolist(), (fresh // bands % items).tolist(), (fresh % bands).tolist(), strict=True):
                    k = int(self.budget[item])
                    low = band * int(self.step[item]) - int(self.size[item])
                    got = closest(self.codes[item], codes[starts[text] : ends[text]], low - k, low + int(self.width[item]) - 1 + k, k)
                    if got and ((text, item) not in best or (got[2], got[0]) < (best[text, item][2], best[text, item][0])):
                        best[text, item] = got
            if hi < len(place):
                exact = np.array(sorted(t * items + i for (t, i), x in best.items() if not x[2]), np.int64)
        return [(t, i, *x) for (t, i), x in sorted(best.items())]

    def _bands(self, place: np.ndarray, slot: np.ndarray, starts: np.ndarray, bands: int, exact: np.ndarray) -> Iterator[np.ndarray]:
        """The bands that hits lie in, as numbers (text * items + item) * bands + band, without those of ``exact`` pairs."""
        n = self.count[slot]
        text = np.searchsorted(starts, place, side="right") - 1
        entry = np.repeat(self.first[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, text, place = self.item[entry], np.repeat(text, n), np.repeat(place, n)
        pair = text * len(self.ids) + item
        if len(exact):
            left = ~np.isin(pair, exact)
            item, text, place, pair, entry = item[left], text[left], place[left], pair[left], entry[left]
        # diagonals from 0: the text place grows by the item's length
        diagonal = place - starts[text] - self.at[entry] + self.size[item]
        band = diagonal // self.step[item]
        lower = (band > 0) & (diagonal - (band - 1) * self.step[item] < self.width[item])
        yield np.r_[pair * bands + band, pair[lower] * bands + band[lower] - 1]


def closest(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the stretch of text that is closest to the item among alignments on the diagonals low to high; None if over budget.

    Rows are item characters, columns diagonals; the stretch may begin anywhere in the band.
    """
    d = np.arange(low, high + 1)
    far = np.int64(1 << 30)
    cost = np.where((d >= 0) & (d <= len(text)), 0, far)
    begin = d.copy()  # where the alignment in a cell began
    w = np.arange(len(d))
    pad = np.full(1, far)
    for i, c in enumerate(item):
        at = d + i  # text place that a diagonal step reads
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(len(d), bool)
        same[inside] = text[at[inside]] == c
        move = np.where(inside, cost + ~same, far)
        skip = np.r_[cost[1:], pad] + 1  # the item's character has no counterpart
        new, came = np.where(skip < move, skip, move), np.where(skip < move, np.r_[begin[1:], 0], begin)
        new = np.where((at + 1 >= 0) & (at + 1 <= len(text)), new, far)
        # text characters without counterpart: along the row
        run = np.minimum.accumulate(new - w)
        source = np.maximum.accumulate(np.where(new - w == run, w, 0))
        cost, begin = np.minimum(run + w, far), came[source]
        if cost.min() > budget:
            return None
    best = int(np.argmin(cost))
    if cost[best] > budget:
        return None
    return int(begin[best]), int(d[best] + len(item)), int(cost[best])


def _matches(index: Index):
    def flush(keys: list[tuple], texts: list[np.ndarray], rows: list[tuple]) -> pa.RecordBatch | None:
        gap = np.zeros(Q, np.uint32)  # no q-gram of an item spans two texts: items hold no zero here
        starts = np.cumsum([0, *(len(t) + Q for t in texts[:-1])])
        joined = np.concatenate([x for t in texts for x in (t, gap)])
        found = index.find(joined, starts) if index.ids else []
        rows = rows + [(*keys[t], index.ids[i], s, e, k, len(index.codes[i])) for t, i, s, e, k in found]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], FIELDS) if rows else None

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, texts, rows, total = [], [], [], 0
            for key, t in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2), strict=True):
                text = normal(t.as_py())
                rows += [(*key, i, s, e, 0, n) for i, s, e, n in index.find_short(text)]
                keys.append(key)
                texts.append(_codes(text))
                total += len(texts[-1])
                if total >= PART:
                    if out := flush(keys, texts, rows):
                        yield out
                    keys, texts, rows, total = [], [], [], 0
            if texts and (out := flush(keys, texts, rows)):
                yield out

    return batches


FIELDS = ["doc_id", "text_hash", "item_id", "start", "end", "edits", "item_chars"]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, text_hash, item_id, start, end (characters of the normal text), edits, item_chars: items found in rows of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text")).where("text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text")).alias("n")).first().n or 0) // BLOCK_CHARS))
    rows = docs.select(F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("text_hash"), F.col("text")).where("text is not null")
    schema = ", ".join(f"{c} long" for c in FIELDS)
    out = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        got = [(r.item_id, n) for r in own.distinct().collect() if (n := normal(r.text))]  # about BLOCK_CHARS characters
        if not got:
            continue
        sent = spark.sparkContext.broadcast(Index(sorted(got, key=lambda x: (x[0] is None, x[0] or 0, x[1])), rate))
        found = rows.mapInArrow(_lazy(sent), schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def _lazy(sent):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _matches(sent.value)(it)

    return batches
