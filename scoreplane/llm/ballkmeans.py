"""Codes of vectors by ball k-means: one codebook for each part of the vector.

Vectors are made whole numbers (floor of ``SCALE`` times a component) and cut
into ``PARTS`` equal parts. Each part has a codebook, started with that part
of the ``ENTRIES`` smallest ids. In each of ``ROUNDS`` rounds every part goes
to its nearest entry, and entries become the floor of the mean of their parts;
then all parts are assigned once more. Distances are squared and in whole
numbers, so results do not depend on how rows are dealt.

The first assignment compares all entries. Every later one starts from the
entry that the part had:

* its ball: the entry's radius, the greatest distance among its parts before
  the entry moved, plus the way it moved. Only entries closer than two radii
  are its neighbours (a table of entries, made on the driver);
* stable core: a part closer to its entry than half the way to the nearest
  neighbour keeps it, nothing is compared;
* rings: neighbours are sorted by distance, and a part is compared with those
  closer than twice its own distance only. An entry c that is strictly farther
  than twice d(x, own) from the own one has d(x, c) > d(x, own), so what is left
  out cannot win or tie.

Rows are never shuffled by a key until the sums by label: each task reads its
rows and codes, and gives one row per part and entry (count, sums, greatest
distance), so an entry with a third of all rows is as cheap as another. The
codebooks (``PARTS`` x ``ENTRIES`` entries) are all that the driver holds.
The sums by label come back on (label, salt).

Defined results: rows whose vector is null or holds null or non-finite
components are dropped, and so are those with a scaled component of ``LIMIT``
or more in size, an empty vector, a length that is no multiple of ``PARTS`` or
that differs from that of the row of the smallest id (sums must fit 64 bits and
parts must be equal). Null ids come last; rows of one id are ordered by their
vector; repeated rows count again; fewer rows than ``ENTRIES`` give a shorter
codebook; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import written

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
LIMIT = 1 << 24
SALT = 64
STATE = "vec_id long, label string, vec array<int>, codes binary"


def scaled(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
           scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, vec, codes) with whole components, of the rows that take part; no codes yet."""
    x = F.col("x")
    fits = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & (F.abs(v) < LIMIT / scale))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                             F.col(vec_col).cast("array<double>").alias("x"))
    rows = rows.where(F.coalesce(fits, F.lit(False)) & (F.size(x) > 0) & (F.size(x) % parts == 0))
    return rows.select("vec_id", "label", F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("vec"),
                       F.lit(b"").alias("codes"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    n = batch.num_rows
    return batch.column("vec").flatten().to_numpy().astype(np.int64).reshape(n, -1)


def _codes(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)


def nearest_entry(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the nearest entry of each part, ties to the lower: every entry compared."""
    return np.argmin(((x[:, None, :] - book[None]) ** 2).sum(axis=2), axis=1)


def neighbours(book: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, squared distance, number) of each entry's neighbours, nearest first; reach: upper bounds of the radii."""
    apart = ((book[:, None, :] - book[None]) ** 2).sum(axis=2)
    far = np.iinfo(np.int64).max
    np.fill_diagonal(apart, far)  # last in its own list
    index = np.argsort(apart, axis=1, kind="stable")
    apart = np.take_along_axis(apart, index, axis=1)
    # two radii, rounded up beyond what the square roots lose
    limit = (2 * reach * (1 + 1e-9) + 1e-3) ** 2
    number = ((apart <= limit[:, None]) & (apart < far)).sum(axis=1)
    return index, apart, number


def reassign(x: np.ndarray, own: np.ndarray, book: np.ndarray, near: tuple) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance, compared pairs) of each part, from the entries they had."""
    index, apart, number = near
    d = ((x - book[own]) ** 2).sum(axis=1)
    best, best_d, compared = own.copy(), d.copy(), 0
    open_ = np.nonzero((number[own] > 0) & (apart[own, 0] <= 4 * d))[0] if len(book) > 1 else np.zeros(0, np.int64)
    ring = 0
    while len(open_):  # rows whose ring reaches the next neighbour of their entry
        cand = index[own[open_], ring]
        cd = ((x[open_] - book[cand]) ** 2).sum(axis=1)
        compared += len(open_)
        wins = (cd < best_d[open_]) | ((cd == best_d[open_]) & (cand < best[open_]))
        best[open_[wins]], best_d[open_[wins]] = cand[wins], cd[wins]
        ring += 1
        go = (number[own[open_]] > ring) & (ring < len(book) - 1)
        open_ = open_[go]
        open_ = open_[apart[own[open_], ring] <= 4 * d[open_]]
    return best, best_d, compared


def assigned(state: DataFrame, books: list[np.ndarray], reach: list[np.ndarray] | None) -> DataFrame:
    """state with the codes of the nearest entries; reach: bounds of the balls' radii if the rows have codes."""
    parts = len(books)
    near = [neighbours(b, r) for b, r in zip(books, reach)] if reach else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch).reshape(batch.num_rows, parts, -1)
            old = _codes(batch, parts) if near else None
            new = np.empty((batch.num_rows, parts), np.uint8)
            for p in range(parts):
                new[:, p] = reassign(x[:, p], old[:, p], books[p], near[p])[0] if near else nearest_entry(x[:, p], books[p])
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "vec": batch.column("vec"),
                                   "codes": pa.array([r.tobytes() for r in new], pa.binary())})

    return state.mapInArrow(run, STATE)


def moments(state: DataFrame, books: list[np.ndarray]) -> tuple[list, list, list]:
    """(counts, sums, squared radii) of every part and entry, summed over all rows."""
    parts, entries, width = len(books), len(books[0]), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)
        radius = np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes = _matrix(batch).reshape(batch.num_rows, parts, -1), _codes(batch, parts)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(sums[p], codes[:, p], x[:, p])
                np.maximum.at(radius[p], codes[:, p], ((x[:, p] - books[p][codes[:, p]]) ** 2).sum(axis=1))
        p, e = np.nonzero(n)
        yield pa.record_batch({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(n[p, e]),
                               "sums": pa.array(list(sums[p, e]), pa.list_(pa.int64())), "radius": pa.array(radius[p, e])})

    rows = state.mapInArrow(run, "part int, entry int, n long, sums array<long>, radius long")
    added = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    got = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), *added).collect()
    n, sums, radius = ([[0] * entries for _ in range(parts)] for _ in range(3))
    for r in got:  # at most one row for each part and entry
        n[r.part][r.entry], radius[r.part][r.entry] = r.n, r.radius
        sums[r.part][r.entry] = [int(r[f"s{k}"]) for k in range(width)]
    return n, sums, radius


def moved(books: list[np.ndarray], n: list, sums: list, radius: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(codebooks, upper bounds of the radii) after a round; unused entries stay."""
    new, reach = [], []
    for p, book in enumerate(books):
        b = np.array([[s // n[p][e] for s in sums[p][e]] if n[p][e] else book[e] for e in range(len(book))], np.int64)
        new.append(b)
        reach.append(np.sqrt(np.array(radius[p], float)) + np.sqrt(((b - book) ** 2).sum(axis=1).astype(float)))
    return new, reach


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel()).encode()).hexdigest()


def codes(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
          parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error) of every kept row, final codebooks)."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    state = scaled(embeddings, id_col, vec_col, label_col, parts=parts)
    first = state.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries)
    start = [r.vec for r in first.select("vec").collect()]  # at most ``entries`` rows
    start = [v for v in start if len(v) == len(start[0])]
    width = len(start[0]) if start else parts
    if start and len(start) < entries:  # rows of another length stood among the first
        rows = state.where(F.size("vec") == width).orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries)
        start = [r.vec for r in rows.select("vec").collect()]
    state = state.where(F.size("vec") == width)
    seed = np.array(start, np.int64).reshape(len(start), parts, -1) if start else np.zeros((1, parts, 1), np.int64)
    books, reach = [np.ascontiguousarray(seed[:, p]) for p in range(parts)], None
    for k in range(rounds):
        state = written(assigned(state, books, reach), f"codes-round{k}", compression="zstd")
        books, reach = moved(books, *moments(state, books))
    last = assigned(state, books, reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, c = _matrix(batch).reshape(batch.num_rows, parts, -1), _codes(batch, parts)
            error = sum(((x[:, p] - books[p][c[:, p]]) ** 2).sum(axis=1) for p in range(parts))
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "label": batch.column("label"),
                                   "code": pa.array([v.hex() for v in batch.column("codes").to_pylist()], pa.string()),
                                   "error": pa.array(error, pa.int64())})

    out = last.mapInArrow(run, "vec_id long, label string, code string, error long")
    return written(out, "codes"), books if start else []


def with_label_error(rows: DataFrame, salt: int = SALT) -> DataFrame:
    """rows with label_error: error summed over the rows of a label, nulls together."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("s_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("s_salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salt)).cast("int"))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("s_label")) & (F.col("salt") == F.col("s_salt"))).drop(
        "s_label", "s_salt", "salt")
