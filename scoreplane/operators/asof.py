"""As-of join: for each left row, the latest right row of the same key at or before it.

Spark has no native as-of join. A plain ``join`` on the key with
``right.ts <= left.ts`` emits every pair within a key, and a window
partitioned by the key sends a hot key to one task. This version is exact
and bounded for any key distribution:

1. left and right rows are unioned and range-partitioned on (key, ts), so
   a hot key is split over many partitions by time;
2. per (partition, key) the last right row is aggregated (partial
   aggregation), and each (partition, key) receives the latest right row of
   the earlier partitions through a window over these summaries, whose size
   per key is bounded by the number of partitions;
3. within a partition a running ``last(.., ignorenulls)`` window over
   (partition, key) - at most one partition of rows - finds the latest
   right row so far, falling back to the carried-in one.

The partition id is stamped on the rows and the result is checkpointed to
the shared checkpoint folder, so both branches (and any retried task) see
the same partitioning: range bounds come from sampling and would differ
between two evaluations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreplane.session import checkpoint_dir


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, tie: str,
              right_cols: list[str], prefix: str = "r_",
              num_partitions: int | None = None) -> DataFrame:
    """Left rows with ``prefix + c`` for the latest right row (right.ts <= left.ts).

    ``tie`` is a left column giving a total order among left rows with equal
    ``ts``; right rows sort before left rows at equal time (<= semantics).
    """
    n = num_partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lcols = left.columns
    payload = [ts] + [c for c in right_cols if c != ts]
    r = right.select(
        F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(0).alias("_side"),
        F.lit(None).cast(left.schema[tie].dataType).alias("_tie"),
        F.struct(*[F.col(c).alias(c) for c in payload]).alias("_r"),
        *[F.lit(None).cast(left.schema[c].dataType).alias(f"_l_{c}") for c in lcols])
    l_ = left.select(
        F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"),
        F.lit(None).cast(r.schema["_r"].dataType).alias("_r"),
        *[F.col(c).alias(f"_l_{c}") for c in lcols])
    checkpoint_dir(left.sparkSession)
    u = (l_.unionByName(r).repartitionByRange(n, "_k", "_t", "_side", "_tie")
         .withColumn("_pid", F.spark_partition_id())
         .checkpoint(eager=True))
    # 2. last right row per (partition, key), then carried in from earlier partitions
    summ = (u.where(F.col("_side") == 0).groupBy("_pid", "_k")
             .agg(F.max_by("_r", F.struct("_t")).alias("_last")))
    keys = u.where(F.col("_side") == 1).select("_pid", "_k").distinct()
    w_carry = (Window.partitionBy("_k").orderBy("_pid")
               .rowsBetween(Window.unboundedPreceding, -1))
    both = (keys.join(summ, ["_pid", "_k"], "full")
            .withColumn("_carry", F.last("_last", ignorenulls=True).over(w_carry))
            .where(F.col("_carry").isNotNull())
            .select("_pid", "_k", "_carry"))
    # 3. running last right row inside the partition
    w_run = (Window.partitionBy("_pid", "_k").orderBy("_t", "_side", "_tie")
             .rowsBetween(Window.unboundedPreceding, 0))
    run = u.withColumn("_cur", F.last("_r", ignorenulls=True).over(w_run)).where(F.col("_side") == 1)
    out = run.join(both, ["_pid", "_k"], "left")
    m = F.coalesce(F.col("_cur"), F.col("_carry"))
    return out.select(*[F.col(f"_l_{c}").alias(c) for c in lcols],
                      *[m[c].alias(prefix + c) for c in payload])
