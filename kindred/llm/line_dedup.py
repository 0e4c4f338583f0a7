"""Removal of repeated lines by overlapping windows of three lines.

Lines end at line feeds. A window is ``size`` neighbouring lines of one text that are not all blank; windows are equal if their lines are
(compared by 64-bit hashes of lines, hashed again in two ways). The first window of its kind in the order of (doc_id, line) stays; all
lines that a later one covers go. Overlapping windows cover whole repeated blocks. Windows are judged on the input, not on what is left.

Counts and first places are aggregated before the shuffle. A window that very many documents have is one row in the table of repeated
windows; its occurrences meet that row in a join that adaptive execution splits. Nothing is gathered but a document's own lines.

Null text has no lines and stays null. A text whose lines all go becomes empty; rows are never dropped. A row is known by its doc_id and a hash
of its text: texts under one doc_id, or without one, are documents of their own, earlier or later than each other by that hash, so each
window stays once among them. Rows that repeat both doc_id and text get the same result, none is earlier than the other. A null doc_id comes before all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.texts import BLANKS, lines, without
from kindred.sources.storage import materialize

def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of its rows (null ids have a flag, so no real id meets them) and its lines."""
    doc = F.struct(F.col("doc_id").isNotNull().alias("named"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("tag"))
    return docs.withColumns({"__doc": doc, "__lines": lines(F.col("text"))})


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """doc, at (first line, from 0) and two hashes of each window."""
    hashed = docs.select("__doc", F.transform("__lines", lambda x: F.struct(F.xxhash64(x).alias("h"), (without(x, BLANKS) != "").alias("full"))).alias("h"))
    some = hashed.where(F.size("h") >= size)

    def window(i):
        part = [F.col("h")[i + k] for k in range(size)]
        key = [x["h"] for x in part]
        full = part[0]["full"]
        for x in part[1:]:
            full = full | x["full"]
        return F.struct(i.alias("at"), full.alias("full"), F.xxhash64(*key).alias("k1"), F.xxhash64(F.lit(1), *key[::-1]).alias("k2"))

    rows = some.select("__doc", F.inline(F.transform(F.sequence(F.lit(0), F.size("h") - size), window)))
    return rows.where("full").select(F.col("__doc").alias("doc"), "at", "k1", "k2")


def dedup_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """The rows of ``docs`` with ``text`` cut, and the columns n_lines and n_removed_lines added (in place of columns of these names)."""
    windows = _windows(_keyed(docs).select("__doc", "__lines"), size)
    place = F.struct("doc", "at")
    first = windows.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("last > first")
    first = materialize(first.select("k1", "k2", "first"))
    later = windows.join(first, ["k1", "k2"]).where(place > F.col("first"))
    marks = later.groupBy(F.col("doc").alias("__marked")).agg(F.collect_set("at").alias("__starts"))
    docs = docs.drop("n_lines", "n_removed_lines")
    # the lines are split again after the join, so they aren't sent
    joined = _keyed(docs).drop("__lines").join(marks, F.col("__doc") == F.col("__marked"), "left")
    joined = joined.withColumn("__lines", lines(F.col("text")))
    covered = F.array_distinct(F.flatten(F.transform("__starts", lambda s: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: s + k))))
    kept = F.when(F.col("__starts").isNotNull() & F.col("text").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), covered))
    joined = joined.withColumn("__kept", kept)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines"))
    cut = F.array_join(F.transform("__kept", lambda i: F.col("__lines")[i]), "\n")
    return joined.select(
        *(F.coalesce(cut, F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        n.cast("long").alias("n_lines"),
        F.when(F.col("__kept").isNull(), 0).otherwise(n - F.size("__kept")).cast("long").alias("n_removed_lines"),
    )
