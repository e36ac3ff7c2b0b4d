"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in hash order, repeated up to
``MAX_EPOCHS`` times. A copy's virtual finish time is the number of words
its source has sent once it is out, divided by the source's target; the
finish times of all sources are range-sorted together and the order is cut
at the total budget. At time 1 every queue has sent its target.

Sources by code point, null last, weigh 1, 2, 3 and again; targets share the
total in proportion to the weights, none above ``MAX_EPOCHS`` times its
source's size, the excess reshared by weight. With the sources sorted by cap
over weight that is a prefix of capped sources and one common rate for the
rest.

Both prefix sums (words in a queue, words in the merged order) run over
buckets of the sort key that hold some ``BUCKET_ROWS`` rows whatever the
source, so a source with a third of all rows is spread like the rest: sums
per bucket, a running sum over the bucket totals, and a window inside each
bucket. The bucket totals of the merged order are themselves summed by
``RANGE`` buckets first, so that only one row of each range passes one task.

Copies that finish after 1 plus the longest document's share of its target are
left out before the merge: by then every queue has sent its target, that is
all together the budget.

Defined results: null and empty texts have size 0, are taken 0 times and
cost nothing; equal finish times are ordered by source, epoch and hash;
repeated rows queue each for itself; an empty table gives an empty result;
extra columns are kept by ``mix`` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreplane.llm.common import placed, row_ids, whole, word_count, written

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
BUCKET_ROWS = 256
MAX_BUCKETS = 1 << 16
RANGE = 256


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of (source, source_size): one row per source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    df = sizes.withColumn("w", w).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    df = df.withColumn("all_w", F.sum("w").over(everything))
    df = df.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    df = df.withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # the common rate if all sources before this one are capped
    df = df.withColumn("rate", (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    df = df.withColumn("free", F.col("rate") * F.col("w") <= F.col("cap"))
    rate = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("rate").alias("rate")))).over(everything)["rate"]
    return df.withColumn("common", rate).select(
        "source", "source_size", F.coalesce(F.least("cap", F.col("common") * F.col("w")), "cap").alias("target"))


def _running(df: DataFrame, keys: list[str], bucket: str, order: list[str], size: str, out: str) -> DataFrame:
    """df with ``out``: the sum of ``size`` up to and with each row, by keys in the order; bucket follows the order."""
    same = [df[k].eqNullSafe(F.col(f"b_{k}")) for k in [*keys, bucket]]
    sums = df.groupBy(*keys, bucket).agg(F.sum(size).alias("b_sum"))
    if keys:
        sums = sums.withColumn("b_before", F.sum("b_sum").over(Window.partitionBy(*keys).orderBy(bucket)) - F.col("b_sum"))
    else:
        sums = sums.withColumn("b_range", F.floor(F.col(bucket) / RANGE))
        ranges = sums.groupBy(F.col("b_range").alias("r_range")).agg(F.sum("b_sum").alias("r_sum"))
        ranges = ranges.withColumn("r_before", F.sum("r_sum").over(Window.orderBy("r_range")) - F.col("r_sum")).drop("r_sum")
        inside = F.sum("b_sum").over(Window.partitionBy("b_range").orderBy(bucket)) - F.col("b_sum")
        sums = sums.withColumn("b_in", inside).join(ranges, F.col("b_range") == F.col("r_range")).withColumn(
            "b_before", F.col("b_in") + F.col("r_before"))
    sums = sums.select(*[F.col(k).alias(f"b_{k}") for k in [*keys, bucket]], "b_before")
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__in", F.sum(size).over(inside))
    return df.join(sums, cond).withColumn(out, F.col("__in") + F.col("b_before")).drop(
        "__in", "b_before", *[f"b_{k}" for k in [*keys, bucket]])


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, row_col: str | None) -> DataFrame:
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            word_count(whole(text_col)).alias("size")]
    rows = docs.select(F.col(row_col).alias("row_id"), *cols) if row_col else row_ids(docs.select(*cols))
    return written(rows, "mix-sizes")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, row_col: str | None = None) -> DataFrame:
    """(row_id, doc_id, size, source_size, target, taken, copies) of every row; row_col: stored row ids, if docs has them."""
    rows = _sized(docs, id_col, text_col, source_col, row_col)
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    per_source = written(targets(per_source, weights, max_epochs), "mix-targets")
    buckets = max(1, min(MAX_BUCKETS, rows.count() // BUCKET_ROWS))
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    queue = rows.where("size > 0").withColumn("h", F.md5(key))
    queue = queue.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)))
    queue = _running(queue, ["source"], "bucket", ["h", "doc_id", "row_id"], "size", "sent")
    # one row per source: each side of the join is split by Spark where a source is hot
    s = per_source.select(F.col("source").alias("s_source"), "source_size", "target")
    queue = queue.join(s, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    copies = queue.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    copies = copies.withColumn("finish", (F.col("sent") + F.col("epoch") * F.col("source_size")).cast("double") / F.col("target"))
    # one row: the finish time by which every queue has sent its target; rounding aside
    longest = rows.join(s, F.col("source").eqNullSafe(F.col("s_source"))).where("size > 0").agg(
        (1 + F.max(F.col("size") / F.col("target")) + 1e-6).alias("last"))
    copies = copies.crossJoin(F.broadcast(longest)).where("finish <= last")
    copies = written(copies.select("row_id", "source", "epoch", "h", "doc_id", "size", "finish"), "mix-copies")
    copies = copies.withColumn("slot", F.floor(F.col("finish") * buckets))
    order = ["finish", F.col("source").isNull(), "source", "epoch", "h", "doc_id", "row_id"]
    merged = _running(copies, [], "slot", order, "size", "out")
    budget = rows.agg(F.sum("size").alias("budget"))
    merged = merged.crossJoin(F.broadcast(budget)).where("out <= budget")  # the budget is one row
    taken = merged.groupBy("row_id").agg(F.sum("size").alias("taken"), F.count("*").alias("copies"))
    out = rows.join(s, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source", "source")
    return out.join(taken, "row_id", "left").withColumns({
        "taken": F.coalesce("taken", F.lit(0).cast("long")), "copies": F.coalesce("copies", F.lit(0).cast("long"))})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs as the mix takes them: a row for each copy taken, all columns."""
    names = docs.columns
    docs = placed(docs, "mix-input", "__own_row")
    taken = mixture(docs, id_col, text_col, source_col, row_col="__own_row", **how).where("copies > 0").select(
        F.col("row_id").alias("__taken_row"), F.col("copies").cast("int").alias("__copies"))
    out = docs.join(taken, F.col("__own_row") == F.col("__taken_row"))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(
        *[F.col(f"`{c}`") for c in names])
