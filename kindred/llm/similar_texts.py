"""Texts whose sets of word shingles have a Jaccard similarity of at least a threshold, by SimHashes with a table of pivot distances and a check of the sets.

A SimHash is taken of KEYS words of 64 bits: in each bit place a shingle's hash counts for one or zero, and the majority is the bit. The first WORDS words are the fingerprint.
A pair at 0.8 differs in about 15 % of the bits, too many for keys of whole blocks of bits. So of each half of a word only its most decided bit (place and value, the
first of equal ones) is a key's part, and texts that agree in both halves of a word meet. By calculation, and in a simulation of the counts, a pair at 0.8 agrees in a half with a chance of
0.48 or more, so it misses all meetings in 3 of a million cases (1 - 0.48**2 to the power of KEYS); unlike texts meet under a key in one of some 4,000.
For each text's fingerprint a table holds its Hamming distances to PIVOTS reference fingerprints, those of texts of the input; it is computed and written once,
and its rows travel with the fingerprints. (A large group of near copies is likely to have a reference, which spreads its members.) A meeting's members are sorted by the
coordinate that spreads them most; by the triangle inequality only a window can be within FAR bits, and the largest coordinate difference discards more. Pairs whose set
sizes rule the threshold out, or that are further apart than FAR bits, go (FAR_SMALL bits if a set has under SMALL shingles; either is 4.4 standard deviations beyond
the mean at 0.8). What is left is confirmed by the sets of 64-bit hashes themselves.

A group of n copies has n**2 pairs, but n - 1 confirmed ones connect it, and it meets under many keys. So the first round has the first EARLY keys only, and a member gives its
first few pairs of a meeting. After those are confirmed or refused, all texts meet under the other keys, and the members of pairs held back meet again under the same
keys; pairs between texts that are connected already aren't given. Members of pairs held back there meet again and give more, until none is held back: all pairs that meet are decided.
From the second round on, members of pairs held back bring the number of their hashes in each of BINS classes. Two sets share at most the sum of the lesser numbers, so a
pair whose sum is too small for the threshold is refused in its meeting, without error; in a group of near copies few others are left.

Equal sets are one text from the start. Null and word-less texts are equal. Every row gives a row; a null doc_id takes part and is a component's name only
if no other is in it. Of each component one (doc_id, text) is its ``first``: the smallest doc_id, nulls last, and of texts that share it the one with the smallest hash.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.simhash import shingle_hashes
from kindred.llm.texts import text_hash
from kindred.operators.components import connected_components
from kindred.sources.storage import materialize, ship

KEYS, WORDS = 48, 4
#: The keys of the first round.
EARLY = 8
FAR, FAR_SMALL, SMALL = 64, 76, 64
PIVOTS, BINS = 24, 256
#: So many members of a meeting after a full one are looked at for pairs held back; of a larger meeting all members meet again.
LOOK = 4096
_MIX = np.random.default_rng(80).integers(0, 2**64, KEYS, dtype=np.uint64) | np.uint64(1)


def _sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint (WORDS words) and the keys of a set that isn't empty."""
    ones = np.zeros(64 * KEYS, np.int64)
    for i in range(0, len(hashes), 255):  # so many ones fit in a byte
        h = hashes[i : i + 255, None]
        x = (h ^ (h >> np.uint64(31))) * _MIX
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    lead = 2 * ones - len(hashes)
    halves = np.abs(lead).reshape(-1, 32).argmax(1)
    code = 2 * halves + (lead.reshape(-1, 32)[np.arange(2 * KEYS), halves] > 0)
    keys = (np.arange(KEYS) << 12) + (code[::2] << 6) + code[1::2]
    return np.packbits(lead[: 64 * WORDS] > 0, bitorder="little").view(np.uint64), keys.view(np.uint64)


def _name(hashes: np.ndarray) -> int:
    """A set's name: a hash of its sorted hashes."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def _bins(hashes: np.ndarray) -> bytes | None:
    """How many hashes each class has, a byte for each; null if one doesn't fit."""
    counts = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _pivots(references: np.ndarray):
    """Adds the table's row: the distance to each reference, at most 255."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            fp = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint64).reshape(-1, 1, WORDS)
            table = np.bitwise_count(fp ^ references[None]).sum(2, dtype=np.int64).clip(max=255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in table], pa.binary())], [*b.schema.names, "pivots"])

    return batches


def pivot_table(distinct: DataFrame) -> DataFrame:
    """id, n, fp, keys and pivots of the different sets, written. The references are the fingerprints of the PIVOTS texts with the smallest hashes of their names; fewer texts: repeated."""
    some = distinct.where("n > 0").select("id", "fp").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    references = np.frombuffer(b"".join(bytes(r.fp) for r in some) or bytes(8 * WORDS), np.uint64).reshape(-1, WORDS)
    table = distinct.select("id", "n", "fp", "keys").mapInArrow(_pivots(np.resize(references, (PIVOTS, WORDS))), "id long, n int, fp binary, keys array<long>, pivots binary")
    return materialize(table)


def _possible(bins: np.ndarray, whole: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Whether sets a and b (indices) can have a similarity of ``least`` thousandths, by their numbers of each class."""
    out = np.ones(len(a), bool)
    for lo in range(0, len(a), 10_000):
        x, y = a[lo : lo + 10_000], b[lo : lo + 10_000]
        both = np.minimum(bins[x], bins[y]).sum(1, dtype=np.int64)
        out[lo : lo + 10_000] = (both * 1000 >= (n[x] + n[y] - both) * least) | ~(whole[x] & whole[y])
    return out


def _sketches(shingle: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            names, sizes, fps, keys = [], [], [], []
            for t in b.column(2):
                h = np.unique(shingle_hashes(t.as_py(), shingle))
                fp, key = _sketch(h) if len(h) else (np.zeros(WORDS, np.uint64), np.empty(0, np.uint64))
                names.append(_name(h))
                sizes.append(len(h))
                fps.append(fp.tobytes())
                keys.append(key.view(np.int64))
            columns = [b.column(0), b.column(1), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "id", "n", "fp", "keys"])

    return batches


def _sets(shingle: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in b.column(0)]
            names, values = pa.array([_name(h) for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([names, values, pa.array(map(_bins, sets), pa.binary())], ["id", "s", "bins"])

    return batches


def _spread(table: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each row of the pivot table the coordinate that varies most in its meeting."""
    at, which = np.unique(start, return_inverse=True)
    values = table.astype(np.float64)
    n = np.diff(np.r_[at, len(start)])[:, None]
    mean = np.add.reduceat(values, at) / n
    varies = np.add.reduceat(values * values, at) / n - mean * mean
    return table[np.arange(len(start)), varies.argmax(1)[which]].astype(np.int64)


def _meet(start: np.ndarray, ids: np.ndarray, n: np.ndarray, root: np.ndarray, fp: np.ndarray, table: np.ndarray, bins: np.ndarray | None, whole: np.ndarray | None, least: int, most: int, late: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (indices) of meetings that may be alike and have different roots, the first ``most`` of each member; and the start of meetings that have more.
    start: index of the meeting's first row; bins: not in the first round; late: set to true for the members of pairs held back."""
    pivot = _spread(table, start)
    order = np.lexsort((ids, pivot, start))
    start, n, root, fp, pivot, table = start[order], n[order].astype(np.int64), root[order], fp[order], pivot[order], table[order].astype(np.int16)
    if bins is not None:
        bins, whole = bins[order], whole[order]
    given, left, right = np.zeros(len(ids), np.int64), [], []
    held = np.zeros(len(ids), bool)
    far = np.where(n < SMALL, FAR_SMALL, FAR)
    # a window ends by the member's own limit, or by the largest one that a partner can have
    reach = np.where(n * least < SMALL * 1000, FAR_SMALL, FAR)
    alive = np.arange(len(ids))
    for shift in range(1, len(ids)):
        alive = alive[alive + shift < len(ids)]
        alive = alive[start[alive] == start[alive + shift]]
        alive = alive[pivot[alive + shift] - pivot[alive] <= reach[alive]]
        if not len(alive):
            break
        a, b = n[alive], n[alive + shift]
        can = (root[alive] != root[alive + shift]) & (np.minimum(a, b) * 1000 >= np.maximum(a, b) * least)
        near = alive[can]
        limit = np.maximum(far[near], far[near + shift])
        close = np.abs(table[near] - table[near + shift]).max(1, initial=0) <= limit
        near, limit = near[close], limit[close]
        near = near[np.bitwise_count(fp[near] ^ fp[near + shift]).sum(1, dtype=np.int64) <= limit]
        if bins is not None and len(near):
            near = near[_possible(bins, whole, n, near, near + shift, least)]
        full = given[near] >= most
        if full.any():
            held[near[full]] = held[near[full] + shift] = True
            near = near[~full]
        if shift >= LOOK:
            over = given[alive] >= most
            if over.any():
                held |= np.isin(start, start[alive[over]])
                alive = alive[~over]
        given[near] += 1
        left.append(near)
        right.append(near + shift)
    if late is not None:
        late[order[held]] = True
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.unique(start[held])
    return order[np.concatenate(left)], order[np.concatenate(right)], np.unique(start[held])


def _candidates(least: int, most: int):
    """Reads (key, id, n, row: fp and pivots), from the second round on also root and bins (may be null), in the order of key. Gives pairs (a, b), and (a, null, key) for each member of a pair held back."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])

    def bytes_of(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)

    def work(t: pa.Table) -> pa.RecordBatch:
        key = t.column(0).to_numpy()
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[at, len(key)])
        many = np.flatnonzero(np.repeat(size, size) > 1)
        if not len(many):
            return pa.RecordBatch.from_arrays([pa.nulls(0, pa.int64())] * 3, schema=schema)
        start = np.searchsorted(many, np.repeat(at, size)[many])
        t = t.take(pa.array(many))
        ids, n = t.column(1).to_numpy(), t.column(2).to_numpy()
        root, bins, whole = ids, None, None
        if t.num_columns > 4:
            root = t.column(4).to_numpy()
            whole = t.column(5).is_valid().to_numpy()
            bins = bytes_of(t.column(5).fill_null(bytes(BINS)), np.uint8, BINS)
        row = bytes_of(t.column(3), np.uint8, 8 * WORDS + PIVOTS)
        late = np.zeros(len(ids), bool)
        x, y, _ = _meet(start, ids, n, root, np.ascontiguousarray(row[:, : 8 * WORDS]).view(np.uint64), row[:, 8 * WORDS :], bins, whole, least, most, late)
        a, b = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
        rows, late = np.unique(np.stack([a, b], 1), axis=0), np.flatnonzero(late)
        ends = pa.concat_arrays([pa.array(rows[:, 1]), pa.nulls(len(late), pa.int64())])
        keys = pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(key[many][late])])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([rows[:, 0], ids[late]])), ends, keys], schema=schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in it:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            last = np.flatnonzero(key != key[-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            if not cut and held and held[-1].column(0)[-1].as_py() != key[0]:
                yield work(pa.Table.from_batches(held))
                held = []
            if cut:
                yield work(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield work(pa.Table.from_batches(held))

    return batches


def near_duplicates(docs: DataFrame, shingle: int = 5, least: int = 800, most: int = 2) -> DataFrame:
    """doc_id, text_hash, component_id (the smallest doc_id of the component) and first (see above) of each row; texts of similarity ``least`` thousandths or more are linked. most: a member's pairs of a meeting in the first two rounds."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("at"), F.col("text"))
    # nulls last: structs are compared field by field
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "at")
    rows = materialize(texts.mapInArrow(_sketches(shingle), "doc_id long, at long, id long, n int, fp binary, keys array<long>"))
    distinct = materialize(rows.groupBy("id").agg(F.min(place).alias("first"), F.min("at").alias("at"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("keys").alias("keys")))
    table = pivot_table(distinct)
    row = F.concat("fp", "pivots").alias("row")
    members = table.select(F.explode(F.slice("keys", 1, EARLY)).alias("key"), "id", "n", row)
    sets, parts = None, None
    for turn in count():
        met = members.repartition("key").sortWithinPartitions("key", "id")
        found = materialize(met.mapInArrow(_candidates(least, most), "a long, b long, key long"))
        pairs = materialize(found.where("b is not null").select("a", "b").distinct())
        late = found.where("b is null").select(F.col("a").alias("id"), "key")
        if turn < 2:  # later members are known from pairs held back
            some = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(late.select("id")).distinct()
            some = some.join(sets.select("id"), "id", "left_anti") if sets is not None else some
            some = materialize(some.join(distinct.select("id", "at"), "id"))
            own = texts.join(some.select("at").distinct(), "at", "left_semi").select("text").mapInArrow(_sets(shingle), "id long, s array<long>, bins binary")
            own = materialize(own.groupBy("id").agg(F.first("s").alias("s"), F.first("bins").alias("bins")))
            sets = own if sets is None else sets.union(own)
        left, right = (sets.select(F.col("id").alias(c), F.col("s").alias(f"s_{c}")) for c in "ab")
        same = F.size(F.array_intersect("s_a", "s_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", same.alias("i"), (F.size("s_a") + F.size("s_b")).alias("t"))
        good = materialize(both.where(F.col("i") * 1000 >= (F.col("t") - F.col("i")) * least).select("a", "b"))
        if parts is None or good.limit(1).count():
            parts = materialize(connected_components(good if parts is None else good.union(parts)))
        if turn and not late.limit(1).count():
            break
        # a pair held back is between members that meet again
        again = late.groupBy("id").agg(F.collect_list("key").alias("again")).join(sets.select("id", "bins"), "id")
        now = parts.select(F.col("node").alias("id"), F.col("component").alias("to"))
        known = table.join(again, "id", "inner" if turn else "left").join(now, "id", "left")
        keys = F.col("again") if turn else F.concat(F.slice("keys", EARLY + 1, KEYS), F.coalesce("again", F.array().cast("array<long>")))
        members = known.select(F.explode(keys).alias("key"), "id", "n", row, F.coalesce("to", "id").alias("root"), "bins")
        most *= 16 if turn else 1
    named = materialize(distinct.select("id", "first").join(parts, F.col("id") == F.col("node"), "left").select("id", "first", F.coalesce("component", "id").alias("root")))
    least_id = materialize(named.groupBy("root").agg(F.min("first").alias("least")))
    names = materialize(named.join(least_id, "root").select("id", "least"))
    return rows.select("doc_id", "at", "id").join(names, "id").select("doc_id", F.col("at").alias("text_hash"), F.col("least.doc_id").alias("component_id"), (place == F.col("least")).alias("first"))
