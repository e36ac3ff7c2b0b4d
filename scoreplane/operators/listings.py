"""Places in an ordered listing: exact deep pages and the rank of each row.

``limit`` with a large ``offset`` keeps all skipped rows in one task. Here only
the sort columns are dealt out by range, each range is counted, and the sums
before each range say in which ranges the page lies. Only those are sorted,
and only the page's rows are fetched by their key.

The dealt sort columns are checkpointed once (a job while the plan is built):
range bounds are sampled, and counts and rows must come from the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreplane.session import checkpoint_dir


def _before(rows: DataFrame) -> DataFrame:
    """(part, before, n): rows of each part and of all parts before it; one row per part."""
    sums = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    return sums.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))


def deep_page(df: DataFrame, order: list[Column], key: str, limit: int, offset: int = 0,
              num_partitions: int | None = None) -> DataFrame:
    """rows ``offset + 1`` to ``offset + limit`` of df in the order, with their ``rank``.

    ``key`` is unique and ends the order. Rows skipped are counted, not sorted.
    """
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    checkpoint_dir(df.sparkSession)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [f"_o{k}" for k in range(len(order))]
    # the order's own expressions, evaluated once, then compared as columns
    plain = [_unsorted(c) for c in order]
    keys = df.select(F.col(key).alias("_key"), *[c.alias(s) for (c, _), s in zip(plain, sort)])
    by = [F.col(s).desc() if down else F.col(s).asc() for (_, down), s in zip(plain, sort)] + [F.col("_key").asc()]
    keys = keys.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()).checkpoint()
    hit = _before(keys).where((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_n") > offset))
    # at most one row per range
    rows = keys.join(F.broadcast(hit), "_part")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) + F.col("_before")
    page = rows.withColumn("rank", place.cast("long")).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    # ``limit`` rows at most
    return df.join(F.broadcast(page.select("_key", "rank")), F.col(key) == F.col("_key")).drop("_key").orderBy("rank")


def _unsorted(c: Column | tuple) -> tuple[Column, bool]:
    """An order is given as a column, or (column, "desc")."""
    if isinstance(c, tuple):
        return c[0], c[1] == "desc"
    return c, False


def with_place(listing: DataFrame, name: str = "place") -> DataFrame:
    """An ordered listing with the place at which it shows each row, from 1.

    Reads the order that the listing has, whatever made it: rows are stamped
    with (partition, place in it) as they come, and partitions are counted.
    """
    checkpoint_dir(listing.sparkSession)
    rows = listing.withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    rows = rows.withColumns({"_part": F.shiftright("_m", 33), "_in": F.col("_m").bitwiseAND((1 << 33) - 1)})
    return rows.join(F.broadcast(_before(rows)), "_part").withColumn(
        name, F.col("_before") + F.col("_in") + 1).drop("_m", "_part", "_in", "_before", "_n")
