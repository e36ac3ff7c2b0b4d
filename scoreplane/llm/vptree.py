"""Nearest neighbours by vantage-point trees, one per shard.

Rows are dealt to shards of some ``SHARD_ROWS`` by a hash of their row id, so
copies and frequent labels spread. In each shard a tree is built over the
unit vectors with the chord as distance (a metric that follows the cosine): a
vantage point, then the nearer half of the rest, then the farther half, and
so on down to leaves of ``LEAF`` rows. The tree is the order of the rows with
the least and greatest distance of either half, written as the index: every
row is in it.

A query goes down to its leaf first, then through all nodes, leaving out a half
if ``factor`` times what the triangle inequality says of its distance exceeds
that of the k-th best so far. Factor 1 is an exact search; above 1 more is
left out and neighbours may be lost. Every query starts with the k-th best of a
bounded sample of rows as its bound, so that no shard has to find its own.

Queries and shards meet in blocks: a task holds one shard and at most some
``QUERY_ROWS`` queries. A shard gives at most k rows for a query; the best k of
all shards are ranked by a limited window.

Scores are cosines of the vectors as they are, summed component by component
in double precision, so equal vectors get equal scores wherever they lie.

Defined results: a vector that is null, zero or holds null or non-finite
components takes no part; vectors of another length than the query's are no
candidates; a row with null id is a candidate, after all others among ties,
and no query; repeated rows are candidates of each other; an empty table
gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreplane.llm.common import row_ids, written

NEAREST = 5
FACTOR = 1.0
SHARD_ROWS = 16_384
QUERY_ROWS = 16_384
SAMPLE_ROWS = 1024
LEAF = 256
ROUND = 1e-7  # above the rounding of chords; what lies within is looked at


def usable(vec: Column) -> Column:
    """True for vectors of finite components, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with that row of b, summed from the first component to the last."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for k in range(a.shape[1]):
        dot += a[:, k] * b[:, k]
        aa += a[:, k] * a[:, k]
        bb += b[:, k] * b[:, k]
    return np.clip(dot / np.sqrt(aa * bb), -1, 1)


def chord(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cos))


def build(unit_rows: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): rows in tree order; bounds of a vantage point: least and greatest distance of its two halves."""
    n = len(unit_rows)
    order, bounds, todo = np.arange(n), np.full((n, 4), np.nan), [(0, n)]
    rng = np.random.default_rng(n)
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= leaf:
            continue
        # of a few rows, the one whose distances differ most
        tried = rng.integers(lo, hi, 8)
        against = unit_rows[order[rng.integers(lo, hi, 128)]]
        best = tried[np.argmax(chord(unit_rows[order[tried]] @ against.T).std(axis=1))]
        order[[lo, best]] = order[[best, lo]]
        rest = order[lo + 1:hi]
        d = chord(unit_rows[rest] @ unit_rows[order[lo]])
        by = np.argsort(d, kind="stable")
        order[lo + 1:hi], d = rest[by], d[by]
        half = len(rest) // 2
        bounds[lo] = d[0], d[half - 1], d[half], d[-1]
        todo += [(lo + 1, lo + 1 + half), (lo + 1 + half, hi)]
    return order, bounds


class Search:
    """The k best rows of one shard for each of some queries; ``visited`` counts the compared pairs."""

    def __init__(self, vecs, row_ids, vec_ids, bounds, queries, query_rows, least, k=NEAREST, factor=FACTOR, leaf=LEAF):
        self.vecs, self.unit, self.rows, self.ids, self.bounds = vecs, unit(vecs), row_ids, vec_ids, bounds
        self.q, self.qu, self.q_rows = queries, unit(queries), query_rows
        self.k, self.factor, self.leaf, self.visited = k, factor, leaf, 0
        self.score = np.full((len(queries), k), -np.inf)
        self.place = np.full((len(queries), k), -1)
        self.least = least.copy()  # score that the k-th best reaches at least

    def offer(self, qs: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Compare queries with rows lo to hi; returns their chords."""
        cos = self.qu[qs] @ self.unit[lo:hi].T
        self.visited += cos.size
        at, col = np.nonzero((cos >= (self.least[qs] - ROUND)[:, None]) & (self.rows[lo:hi] != self.q_rows[qs][:, None]))
        if len(at):
            exact = cosines(self.q[qs[at]], self.vecs[lo + col])
            for i in np.unique(at):
                own, q = at == i, qs[i]
                place = np.concatenate([self.place[q], lo + col[own]])
                score = np.concatenate([self.score[q], exact[own]])
                ok = place >= 0
                place, score = place[ok], score[ok]
                # a place may come twice: from the way down and from the search
                place, once = np.unique(place, return_index=True)
                score = score[once]
                best = np.lexsort((self.rows[place], self.ids[place], -score))[:self.k]
                self.place[q, :len(best)], self.score[q, :len(best)] = place[best], score[best]
                self.least[q] = max(self.least[q], self.score[q, -1])
        return chord(cos)

    def halves(self, lo: int, hi: int):
        half = lo + 1 + (hi - lo - 1) // 2
        return (lo + 1, half), (half, hi)

    def down(self, lo: int, hi: int, qs: np.ndarray) -> None:
        """Each query to its own leaf."""
        todo = [(lo, hi, qs)]
        while todo:
            lo, hi, qs = todo.pop()
            if not len(qs) or lo >= hi:
                continue
            if hi - lo <= self.leaf:
                self.offer(qs, lo, hi)
                continue
            d = chord(self.qu[qs] @ self.unit[lo])
            near = d <= (self.bounds[lo, 1] + self.bounds[lo, 2]) / 2
            left, right = self.halves(lo, hi)
            todo += [(*left, qs[near]), (*right, qs[~near])]

    def through(self, lo: int, hi: int, qs: np.ndarray) -> None:
        todo = [(lo, hi, qs)]
        while todo:
            lo, hi, qs = todo.pop()
            if not len(qs) or lo >= hi:
                continue
            if hi - lo <= self.leaf:
                self.offer(qs, lo, hi)
                continue
            d = self.offer(qs, lo, lo + 1)[:, 0]
            reach = chord(self.least[qs].clip(-1, 1))
            b = self.bounds[lo]
            for (first, last), part in zip(((b[0], b[1]), (b[2], b[3])), self.halves(lo, hi)):
                apart = np.maximum(first - d, d - last)  # the triangle inequality
                todo.append((*part, qs[self.factor * (apart - ROUND) <= reach + ROUND]))

    def run(self) -> None:
        qs = np.arange(len(self.q))
        self.down(0, len(self.vecs), qs)
        self.through(0, len(self.vecs), qs)


def index(rows: DataFrame, shards: int, leaf: int = LEAF) -> DataFrame:
    """(dim, shard, pos, row_id, vec_id, named, vec, b0 .. b3) of (vec_id, vec): every usable row in its shard's tree order;
    named is false, vec_id 0, where the id is null."""
    rows = row_ids(rows).where(usable(F.col("vec"))).select(
        F.size("vec").alias("dim"), F.pmod(F.xxhash64("row_id"), F.lit(shards)).alias("shard"), "row_id",
        F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNotNull().alias("named"), "vec")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id", ignore_index=True)
        order, bounds = build(unit(np.stack(pdf.vec.to_numpy())), leaf)
        return pdf.iloc[order].assign(pos=np.arange(len(pdf)), **{f"b{k}": bounds[:, k] for k in range(4)})

    return rows.groupBy("dim", "shard").applyInPandas(
        run, "dim int, shard long, pos long, row_id long, vec_id long, named boolean, vec array<double>, "
             "b0 double, b1 double, b2 double, b3 double")


def nearest(embeddings: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEAREST,
            factor: float = FACTOR, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
            sample_rows: int = SAMPLE_ROWS, leaf: int = LEAF) -> DataFrame:
    """(query_id, query_row, rank, vec_id, row_id, score) of the rows for which ``is_query`` of vec_id holds."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    tree = written(index(rows, shards, leaf), "vantage-trees")
    queries = tree.where(is_query & F.col("named")).select("dim", "row_id", "vec_id", "vec")
    # at most sample_rows vectors: a bounded side
    sample = tree.orderBy(F.xxhash64("row_id", F.lit(3)), "row_id").limit(sample_rows).select("dim", "row_id", "vec").toPandas()
    by_dim = {d: (g.row_id.to_numpy(), unit(np.stack(g.vec.to_numpy()))) for d, g in sample.groupby("dim")}

    def bound(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for dim, g in pdf.groupby("dim"):
                least = np.full(len(g), -2.0)
                if dim in by_dim and len(by_dim[dim][0]) > k:
                    own, vecs = by_dim[dim]
                    cos = unit(np.stack(g.vec.to_numpy())) @ vecs.T
                    cos[g.row_id.to_numpy()[:, None] == own] = -2
                    least = np.partition(cos, -k, axis=1)[:, -k] - ROUND
                yield g.assign(least=least)

    blocks = max(1, math.ceil(queries.count() / query_rows))
    queries = queries.mapInPandas(bound, "dim int, row_id long, vec_id long, vec array<double>, least double")
    queries = queries.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(blocks)))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = queries.withColumn("shard", upto(shards))  # each query to every shard, in blocks
    every = tree.withColumn("block", upto(blocks))

    def run(qs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(qs):
            return pd.DataFrame({c: [] for c in ("query_id", "query_row", "vec_id", "named", "row_id", "score")})
        rows = rows.sort_values("pos", ignore_index=True)
        ids, named = rows.vec_id.to_numpy(), rows.named.to_numpy(bool)
        s = Search(np.stack(rows.vec.to_numpy()), rows.row_id.to_numpy(), np.where(named, ids, np.iinfo(np.int64).max),
                   rows[["b0", "b1", "b2", "b3"]].to_numpy(), np.stack(qs.vec.to_numpy()), qs.row_id.to_numpy(),
                   qs.least.to_numpy(), k, factor, leaf)
        s.run()
        q, col = np.nonzero(s.place >= 0)
        at = s.place[q, col]
        return pd.DataFrame({"query_id": qs.vec_id.to_numpy()[q], "query_row": s.q_rows[q], "vec_id": ids[at],
                             "named": named[at], "row_id": s.rows[at], "score": s.score[q, col]})

    keys = ["dim", "shard", "block"]
    found = asked.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInPandas(
        run, "query_id long, query_row long, vec_id long, named boolean, row_id long, score double")
    found = found.withColumn("vec_id", F.when(F.col("named"), F.col("vec_id"))).drop("named")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
