"""SimHash near-duplicates, found with tables of distances to reference fingerprints.

A fingerprint bit is set where over half of a text's word shingles have it set in their XXH64.
Equal fingerprints collapse first. For each one left a table holds its Hamming distances to the reference fingerprints (pivots); it is
computed and written once, and its rows travel with the fingerprints. By the triangle inequality a pair whose distances to one pivot differ by more
than ``d`` is further apart than d. Distances to pivots of random bits lie close together, so alone they would compare a share of all pairs that
doesn't shrink; as a supplement, a pair within d of 64 bits agrees on ``m - d`` of any ``m`` blocks of bits (pigeonhole), so the table is read in parts
that agree on so many blocks, and these meetings are complete. Each is sorted by the first coordinate, so a fingerprint is compared with a window of
it only; the largest coordinate difference discards most pairs left, and the survivors are verified by counting bits.

No meeting emits its pairs: it emits one link from each member to the smallest one it is connected to there.
Meetings of over ``cap`` members are not gathered. By the same pigeonhole over other blocks their members meet again in
finer meetings, which are as complete, and so on: each level fixes more bits, and after LEVELS only some thousands of different fingerprints
can share all fixed bits, so the last level needs no cap.

Null and word-less texts have fingerprint zero, which links like any other. Repeated rows of a doc_id stay rows
of the result; a null doc_id takes part as an unnamed document, and is a component's name only if no other is in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.components import connected_components
from kindred.sources.storage import materialize, ship

#: Reference fingerprints: words of a fixed generator.
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 24, dtype=np.uint64, endpoint=False)
#: Blocks for each distance. More blocks: longer keys and more of them.
BLOCKS = {0: 2, 1: 3, 2: 5, 3: 6, 4: 7, 5: 8, 6: 9}
CAP = 4096
LEVELS = 4


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a text: A-Z lowered, words between ASCII white space; shorter texts are one shingle."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), np.uint64)


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint of one text."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    counts, n = np.zeros(64, np.int64), 0
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        n += len(part)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fp (long, the 64 bits) of each row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(batches, "doc_id long, fp long")


def _masks(d: int, level: int) -> list[int]:
    """Bits of each choice of m - d blocks. Blocks are neighbouring bits at level 0, and bits at other strides beyond."""
    m = BLOCKS[d]
    order = [i * (1, 23, 41, 11, 53)[level] % 64 for i in range(64)]
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [sum(1 << b for b in order[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, m - d)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def pivot_table(fps: DataFrame) -> DataFrame:
    """fp and pivots (a byte for each reference fingerprint: the distance to it) of the distinct fingerprints ``fps``, written."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            table = np.bitwise_count(b.column(0).to_numpy().view(np.uint64)[:, None] ^ PIVOTS[None, :])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in table], pa.binary())], ["fp", "pivots"])

    ship(fps.sparkSession)
    return materialize(fps.select("fp").mapInArrow(batches, "fp long, pivots binary"))


def _meet(fp: np.ndarray, table: np.ndarray, start: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest connected member), by index, of runs of ``fp`` with their pivot distances; start: of its run, for each member."""
    order = np.lexsort((table[:, 0], start))
    fp, start = fp[order], start[order]
    first, rest = table[order, 0].astype(np.int64), table[order, 1:].astype(np.int8)
    left, right = [], []
    alive = np.arange(len(fp))
    for shift in range(1, len(fp)):
        alive = alive[alive + shift < len(fp)]
        alive = alive[(start[alive] == start[alive + shift]) & (first[alive + shift] - first[alive] <= d)]
        if not len(alive):
            break
        near = alive[np.abs(rest[alive] - rest[alive + shift]).max(1) <= d]
        near = near[np.bitwise_count(fp[near] ^ fp[near + shift]) <= d]
        left.append(near)
        right.append(near + shift)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(fp))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return order[moved], order[label[moved]]


def _links(d: int, cap: int | None):
    """Reads (k, key, fp, pivots) in the order of (k, key). Gives links (a, b), and for members of meetings over ``cap`` (a, meeting, pivots)."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("meeting", pa.int64()), ("pivots", pa.binary())])

    def over(k: np.ndarray, key: np.ndarray, fp: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        name = (k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (key.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(name.view(np.int64)), pa.array([r.tobytes() for r in table], pa.binary())], schema=kind)

    def work(k: np.ndarray, key: np.ndarray, fp: np.ndarray, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[at, len(fp)])
        start, size = np.repeat(at, size), np.repeat(size, size)
        large = size > cap if cap else np.zeros(len(fp), bool)
        small = (size > 1) & ~large
        if small.any():
            f = fp[small]
            x, y = _meet(f.view(np.uint64), table[small], start[small], d)
            yield pa.RecordBatch.from_arrays([pa.array(f[x]), pa.array(f[y]), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.binary())], schema=kind)
        if large.any():
            yield over(k[large], key[large], fp[large], table[large])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        passing = None  # the key of a meeting that is known to be over the cap; its rows pass through
        for b in it:
            cols = [*(b.column(i).to_numpy() for i in range(3)), np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, len(PIVOTS))]
            if kept is not None:
                cols, kept = [np.concatenate(p) for p in zip(kept, cols, strict=True)], None
            if passing is not None:
                rest = np.flatnonzero((cols[0] != passing[0]) | (cols[1] != passing[1]))
                n = rest[0] if len(rest) else len(cols[0])
                if n:
                    yield over(*(x[:n] for x in cols))
                cols = [x[n:] for x in cols]
            if not len(cols[0]):
                continue
            passing = None
            k, key, fp, table = cols
            last = np.flatnonzero((k != k[-1]) | (key != key[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from work(k[:cut], key[:cut], fp[:cut], table[:cut])
            tail = [x[cut:] for x in cols]
            if cap and len(fp) - cut > cap:
                passing = (k[-1], key[-1])
                yield over(*tail)
            else:
                kept = tail
        if kept is not None and len(kept[2]):
            yield from work(*kept)

    return batches


def links(fps: DataFrame, d: int, cap: int = CAP) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fps`` (fp) that connect all pairs within ``d`` bits."""
    members, out = pivot_table(fps).select("fp", F.lit(0).cast("long").alias("meeting"), "pivots"), None
    for level in range(LEVELS + 1):
        keys = [F.struct(F.xxhash64("meeting", F.lit(i)).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(_masks(d, level))]
        met = members.select("fp", "pivots", F.inline(F.array(*keys))).select("k", "key", "fp", "pivots").repartition("k", "key").sortWithinPartitions("k", "key")
        found = materialize(met.mapInArrow(_links(d, cap if level < LEVELS else None), "a long, b long, meeting long, pivots binary"))
        own = found.where("b is not null").select("a", "b")
        out = own if out is None else out.union(own)
        members = found.where("meeting is not null").select(F.col("a").alias("fp"), "meeting", "pivots")
        if not members.limit(1).count():
            break
    return out.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, d: int = 2, cap: int = CAP) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of the component) of each row of ``docs``."""
    rows = materialize(fingerprints(docs, shingle))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = connected_components(links(distinct.select("fp"), d, cap))
    named = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = materialize(named)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = materialize(named.join(materialize(least), "root").select("fp", "component_id"))
    return rows.join(names, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp):
    """16 lowercase hexadecimal digits of a long column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
