"""Exact deduplication against a minimal perfect hash of known digests.

The history is a table of distinct 32-byte digests. Its keys are dealt to
buckets by their leading bits; each bucket of about ``BUCKET_KEYS`` keys
becomes one index row: the bit arrays of a minimal perfect hash (level after
level, keys that are alone on their bit stay there, the others go on to the
next level), and per slot the full digest, the winner's locator and the
number of rows. A lookup finds the only slot a digest can have and compares
all 32 bytes, so a digest that is not in the history is never taken for one
that is. Members are repeats of the stored winner; the others are grouped
among themselves.

Only distinct digests (grouped with map-side partial aggregation) travel to
the index; rows of a hot group meet their class in a join whose class side
has one row per digest, which AQE splits.

Defined results: a null text is the empty text; empty texts are one group;
of equal texts the smallest doc_id stays (a null doc_id after all others),
of repeated rows with one doc_id the first in table order; an empty table
gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import SPACE, placed, row_ids, whole, written

BUCKET_KEYS = 512
GAMMA = 2.0
INDEX = "bucket long, n long, bits array<binary>, digests binary, ids binary, rows binary, row_n binary"
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def normalised(text) -> F.Column:
    return F.regexp_replace(whole(text), SPACE, " ")


def digest(text) -> F.Column:
    """SHA-256 of the normalised text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of each key (n x 4 uint64 words of its digest) on a level."""
    with np.errstate(over="ignore"):
        h = keys[:, 0] ^ ((keys[:, 1] + np.uint64(level + 1)) * np.uint64(_ODD[0]))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_ODD[1]) + keys[:, 2 + level % 2] * np.uint64(_ODD[2])
        h ^= h >> np.uint64(32)
    return (h % np.uint64(size)).astype(np.int64)


def build_bits(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels, and each key's slot in 0..n-1."""
    slots = np.empty(len(keys), np.int64)
    todo, levels, before = np.arange(len(keys)), [], 0
    while len(todo):
        size = max(8, -(-int(GAMMA * len(todo)) // 8) * 8)
        at = _positions(keys[todo], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        own = alone[at]
        slots[todo[own]] = before + rank[at[own]]
        before += int(alone.sum())
        levels.append(alone)
        todo = todo[~own]
    return levels, slots


def find_slots(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The only slot each key can have; -1: none."""
    slots = np.full(len(keys), -1, np.int64)
    todo, before = np.arange(len(keys)), 0
    for k, bits in enumerate(levels):
        at = _positions(keys[todo], k, len(bits))
        own = bits[at]
        slots[todo[own]] = before + (np.cumsum(bits) - 1)[at[own]]
        before += int(bits.sum())
        todo = todo[~own]
    return slots


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def bucket_of(n_buckets: int) -> F.Column:
    return F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long") % n_buckets


def build_index(classes: DataFrame, n_buckets: int) -> DataFrame:
    """Index rows over distinct (digest, win_id, win_row, n)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        levels, slots = build_bits(_words(pdf.digest))
        order = np.argsort(slots)
        ids = pdf.win_id.to_numpy("float64", na_value=np.nan)
        ids = np.where(np.isnan(ids), np.iinfo(np.int64).min, pdf.win_id.fillna(0).to_numpy("int64"))
        return pd.DataFrame({
            "bucket": [pdf.bucket.iloc[0]], "n": [len(pdf)], "bits": [[np.packbits(x).tobytes() for x in levels]],
            "digests": [b"".join(pdf.digest.iloc[order])], "ids": [ids[order].astype("<i8").tobytes()],
            "rows": [pdf.win_row.to_numpy("<i8")[order].tobytes()], "row_n": [pdf.n.to_numpy("<i8")[order].tobytes()]})

    return classes.withColumn("bucket", bucket_of(n_buckets)).groupBy("bucket").applyInPandas(build, INDEX)


def _slots(digests: pd.Series, x: pd.Series) -> np.ndarray:
    """Slot of each digest in an index row whose stored digest equals it byte by byte; -1: no member."""
    if not len(digests):
        return np.empty(0, np.int64)
    keys = _words(digests)
    levels = [np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for b in x.bits]
    slots = find_slots(keys, levels)
    stored = np.frombuffer(x.digests, "<u8").reshape(-1, 4)
    return np.where((slots >= 0) & (stored[slots] == keys).all(axis=1), slots, -1)


def lookup(classes: DataFrame, index: DataFrame, n_buckets: int) -> DataFrame:
    """classes with ``hit`` and, for members, the stored winner instead of their own."""
    out = "digest binary, win_id long, win_row long, n long, hit boolean"

    def probe(pdf: pd.DataFrame, idx: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[["digest", "win_id", "win_row", "n"]].astype({"win_id": "Int64"})
        hit = np.zeros(len(pdf), bool)
        if len(idx) and len(pdf):
            x = idx.iloc[0]
            slots = _slots(pdf.digest, x)
            hit = slots >= 0
            ids = np.frombuffer(x.ids, "<i8")[slots[hit]]
            pdf.loc[hit, "win_id"] = pd.array(np.where(ids == np.iinfo(np.int64).min, 0, ids), "Int64")
            pdf.loc[hit, "win_row"] = np.frombuffer(x.rows, "<i8")[slots[hit]]
        return pdf.assign(hit=hit)

    new = classes.withColumn("bucket", bucket_of(n_buckets))
    return new.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(probe, out)


def merged(classes: DataFrame, index: DataFrame, n_buckets: int) -> DataFrame:
    """(digest, win_id, win_row, n) of the history and of ``classes``, one row per digest of either.

    Members add their count to the slot that holds their digest and take its
    winner; nonmembers, of one row per digest, stay as they are. Nothing is
    grouped by digest again, so a member that no slot admits would come twice.
    """
    def settle(pdf: pd.DataFrame, idx: pd.DataFrame) -> pd.DataFrame:
        own = pdf[["digest", "win_id", "win_row", "n"]].astype({"win_id": "Int64"})
        if not len(idx):
            return own
        x = idx.iloc[0]
        slots = _slots(own.digest, x)
        n = np.frombuffer(x.row_n, "<i8").copy()
        member = slots >= 0
        np.add.at(n, slots[member], own.n.to_numpy("int64")[member])
        ids = np.frombuffer(x.ids, "<i8")
        history = pd.DataFrame({"digest": [x.digests[k:k + 32] for k in range(0, 32 * len(n), 32)],
                                "win_id": pd.array(ids, "Int64"), "win_row": np.frombuffer(x.rows, "<i8"), "n": n})
        history.loc[ids == np.iinfo(np.int64).min, "win_id"] = pd.NA
        return pd.concat([history, own[~member]], ignore_index=True)

    new = classes.withColumn("bucket", bucket_of(n_buckets))
    return new.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(
        settle, "digest binary, win_id long, win_row long, n long")


def _classes(rows: DataFrame) -> DataFrame:
    w = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    return rows.groupBy("digest").agg(w.alias("w"), F.count("*").alias("n")).select(
        "digest", F.col("w.doc_id").alias("win_id"), F.col("w.row_id").alias("win_row"), "n")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row_id, doc_id, digest, win_id, win_row, group_size) of every row.

    The rows with the smaller half of the id range are the history the index
    is built on; all others are looked up. Any cut gives the same result.
    ``row_col`` names stored row ids, if docs has them.
    """
    cols = [F.col(id_col).cast("long").alias("doc_id"), digest(text_col).alias("digest")]
    rows = docs.select(F.col(row_col).alias("row_id"), *cols) if row_col else row_ids(docs.select(*cols))
    rows = written(rows, "dedup-rows")
    lo, hi = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    old = F.coalesce(F.col("doc_id") <= F.lit(((lo or 0) + (hi or 0)) // 2), F.lit(False))
    history = written(_classes(rows.where(old)), "dedup-history")
    n_buckets = max(1, history.count() // BUCKET_KEYS)
    index = written(build_index(history, n_buckets), "dedup-index")
    # a member's winner is its slot's: history ids are the smaller ones, and null ids are looked up
    every = merged(_classes(rows.where(~old)), index, n_buckets)
    return rows.join(every.withColumnRenamed("n", "group_size"), "digest")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row per group of equal texts, all columns."""
    docs = placed(docs, "dedup-input", "__own_row")
    kept = exact_groups(docs, id_col, text_col, "__own_row").where(F.col("row_id") == F.col("win_row")).select(
        F.col("row_id").alias("__kept_row"))
    return docs.join(kept, F.col("__own_row") == F.col("__kept_row"), "left_semi").drop("__own_row")
