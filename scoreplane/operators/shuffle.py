"""Reproducible shuffle (F6): a keyed permutation of dense positions.

Rows are numbered by a total order, and a Feistel network keyed by the seed
permutes the numbers, so a row's place follows from its number and the seed
alone: any partitioning, a retried task or a second run gives the same order.
The network permutes 0 .. 4^half - 1, the smallest such range that holds all
rows; a number thrown beyond the rows is permuted again (cycle walking) until
it falls among them, which keeps the whole a permutation of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane.operators.listings import with_place

MULTIPLIER, SHIFT, ROUNDS = 2_654_435_761, 15, 6


def round_keys(seed: int) -> list[int]:
    return [(seed * 7919 + r * 104_729) % (1 << 20) for r in range(ROUNDS)]


def permutation(n: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """A permutation of 0 .. n - 1 as a function of arrays; n up to 2^60."""
    if not 0 <= n <= 1 << 60:
        raise ValueError("0 to 2^60 rows")
    half = max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)
    mask, keys = (1 << half) - 1, round_keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:  # below 2^31 times below 2^32: no overflow
            left, right = right, left ^ ((((right + k) * MULTIPLIER) >> SHIFT) & mask)
        return (left << half) | right

    def run(x: np.ndarray) -> np.ndarray:
        y = once(np.asarray(x, np.int64))
        while (far := y >= n).any():
            y[far] = once(y[far])
        return y

    return run


def shuffled(df: DataFrame, order: list[str] | None = None, seed: int = 42, name: str = "place") -> DataFrame:
    """df in random order, with each row's place from 1.

    ``order`` is the total order that numbers the rows (default: all columns;
    rows equal in it are alike, so any order of theirs is the same). An empty
    table stays empty. Numbering runs jobs while it is called.
    """
    rows = with_place(df.orderBy(*(order or df.columns)), "_at")
    move = permutation(rows.count(), seed)
    place = F.pandas_udf(lambda at: pd.Series(move(at.to_numpy() - 1) + 1), "long")
    return rows.withColumn(name, place("_at")).drop("_at").orderBy(name)
