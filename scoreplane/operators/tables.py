"""Table changes as pure functions (A5, I1, I2) plus id assignment.

Parquet has no in-place change: each function returns the new table (and
counts come from a separate action); the caller writes it to a new path.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreplane.session import checkpoint_dir


def delete_ids(table: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Remove rows whose id is in ``ids`` (left anti join)."""
    return table.join(ids.select(F.col(id_col).alias("_del")).distinct(),
                      F.col(id_col) == F.col("_del"), "left_anti")


def retain_recent(table: DataFrame, as_of: str | _dt.date, days: int, ts: str = "timestamp") -> DataFrame:
    """Keep rows with DATE(ts) >= as_of - days (strictly older are deleted)."""
    return table.where(F.to_date(ts) >= F.date_sub(F.lit(as_of).cast("date"), days))


def expired_rows(table: DataFrame, as_of: str | _dt.date, days: int, ts: str = "timestamp") -> DataFrame:
    """I2 complement: the rows a retention run deletes."""
    return table.where(F.to_date(ts) < F.date_sub(F.lit(as_of).cast("date"), days))


# monotonically_increasing_id() puts the partition index above bit 33 and
# the row's position within its partition below it.
_ROW_BITS = 33


def assign_ids(new_rows: DataFrame, existing: DataFrame | None, id_col: str,
               order: list[str], materialize: bool = True) -> DataFrame:
    """A5: ids after the current maximum, following a total order of the batch.

    Distributed, with one shuffle: the batch is range-sorted on ``order`` and,
    in the same stage, each row is stamped with its (partition, position) by
    ``monotonically_increasing_id``. A partition's offset is the sum of the
    row counts of the partitions before it: a partial aggregate to one row
    per partition and a running sum over those few rows (bounded by the
    partition count, not the data), broadcast back. Both branches read the
    same (reused) sort exchange.

    The input is checkpointed to the shared folder first unless the caller
    already did (``materialize=False``): the range bounds are then sampled
    from fixed data, so a retried task or a lost executor rebuilds the same
    partitions and, ``order`` being unique per row, the same ids.
    """
    spark = new_rows.sparkSession
    if materialize:
        checkpoint_dir(spark)
        new_rows = new_rows.checkpoint(eager=True)
    stamped = new_rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id())
    pid = F.shiftright(F.col("_m"), _ROW_BITS)
    pos = F.col("_m").bitwiseAND((1 << _ROW_BITS) - 1)
    counts = stamped.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.select("_pid", F.coalesce(
        F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    base = (existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_b"))
            if existing is not None else spark.range(1).select(F.lit(0).alias("_b")))
    out = (stamped.join(F.broadcast(offs), pid == F.col("_pid"))
           .crossJoin(F.broadcast(base)))
    return out.withColumn(id_col, (F.col("_b") + F.col("_off") + pos + 1).cast("bigint")).drop(
        "_m", "_pid", "_off", "_b")
