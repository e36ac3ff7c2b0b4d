"""Structured Streaming forms of the stateful operators.

Sources are file streams over Parquet tables; sinks are Parquet folders
with their checkpoint below the cluster's shared checkpoint folder, so a
restarted query resumes exactly where it stopped. ``run_to_table`` drives
a query with ``availableNow`` and returns the sink as a batch DataFrame.

Event time must be ``TIMESTAMP`` for watermarks, so NTZ columns are cast
(the session zone is UTC).
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreplane import fixed_values as FV
from scoreplane.operators import calllog as CG
from scoreplane.operators.replay import answered
from scoreplane.plans import ingest as IG
from scoreplane.rules import RuleSet
from scoreplane.session import scratch_path


def file_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """Parquet table as a stream (schema taken from the table, not inferred per file)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if os.path.isdir(path):
        return r.parquet(path)
    # a single-file table: stream its folder, filtered to that file name
    return r.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))


def event_time(df: DataFrame, col: str = "ts", out: str = "event_ts") -> DataFrame:
    return df.withColumn(out, F.col(col).cast("timestamp"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available into a Parquet sink; read it back."""
    spark = stream.sparkSession
    base = scratch_path(spark, f"stream-{name}")
    q = (stream.writeStream.format("parquet").outputMode(mode)
         .option("path", f"{base}/data").option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def run_updates(stream: DataFrame, name: str, keys: list[str], count: str) -> DataFrame:
    """Run a counting query in update mode and read its state: open windows count as far as they got.

    Every micro-batch writes the changed keys to a folder of its own id, which
    a retried batch overwrites; counts only grow, so a key's state is its
    largest count.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, f"stream-{name}")
    q = (stream.writeStream.outputMode("update")
         .foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{base}/changes/batch={epoch}"))
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/changes").groupBy(*keys).agg(F.max(count).alias(count))


# S1 -----------------------------------------------------------------------
def daily_usage(calls: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Successful calls per key and UTC day; a window's state goes once the watermark passes it."""
    ok = event_time(calls.where(F.col("error").isNull()))
    return (ok.withWatermark("event_ts", delay)
              .groupBy(F.window("event_ts", "1 day").alias("w"), "api_key")
              .agg(F.count(F.lit(1)).alias("calls"))
              .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"), "api_key", "calls"))


# S2 -----------------------------------------------------------------------
def cache_misses(calls: DataFrame, ttl_hours: int = FV.CACHE_TTL_HOURS) -> DataFrame:
    """The calls that miss the response cache.

    A call misses unless an answered miss of its prompt lies within the
    lifetime before it; a failed call or an empty response fills nothing. The
    state of a prompt is the time of its last answered miss, dropped once the
    event time is a lifetime past it. Calls of a prompt are decided in time
    order within a micro-batch. ``replay.cache_misses`` is the batch form.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    life = int(ttl_hours * 3600 * 1_000_000)

    def decide(key, chunks, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(chunks)).sort_values(["at", "call_id"])
        last, kept = (state.get[0] if state.exists else None), []
        for call, at, ok in zip(rows.call_id, rows["at"], rows.ok):
            if last is None or at - last > life:
                last = int(at) if ok else last
                kept.append((int(call), key[0], int(at)))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last + life, state.getCurrentWatermarkMs() * 1000) // 1000 + 1)
        yield pd.DataFrame(kept, columns=["call_id", "prompt_hash", "at"])

    h = event_time(CG.with_hash(calls)).withWatermark("event_ts", f"{ttl_hours} hours")
    out = h.select("call_id", "prompt_hash", "event_ts", F.unix_micros("event_ts").alias("at"), answered().alias("ok")).groupBy(
        "prompt_hash").applyInPandasWithState(
        decide, "call_id long, prompt_hash string, at long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("call_id", "prompt_hash", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"))


# S3 (and exact S2) ---------------------------------------------------------
def _latest(df: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """Latest row per key by ``order`` (grouped max_by: partial aggregation, a hot key is one row per task)."""
    payload = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(key).agg(F.max_by(payload, F.struct(*order)).alias("_l"))
              .select(key, *[F.col("_l")[c].alias(c) for c in cols]))


def fold_latest_stream(rows: DataFrame, key: str, order: list[str], cols: list[str], name: str,
                       base: str | None = None) -> str:
    """Keep the latest row per key over a stream; returns the state folder ``base``.

    A streaming aggregation (``groupBy(key).agg(max_by(..))`` in update
    mode) holds the per-key state in Spark's state store, checkpointed below
    ``base``, so each micro-batch touches only the keys it carries. Every
    micro-batch appends the changed keys' new rows to ``base/changes``, in a
    folder of its own batch id that a retried batch overwrites, so a batch
    is never applied twice. ``read_latest`` compacts the change log with the
    same grouped ``max_by``. Pass the same ``base`` to resume a stopped query.
    """
    spark = rows.sparkSession
    base = base or scratch_path(spark, f"state-{name}")
    vals = list(dict.fromkeys(c for c in order + cols if c != key))
    changed = _latest(rows.select(key, *vals), key, order, vals)

    def publish(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/changes/batch={epoch}")

    q = (changed.writeStream.outputMode("update").foreachBatch(publish)
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return base


def _newest_snapshot(spark: SparkSession, base: str) -> int | None:
    """Batch id covered by the newest snapshot (a max over partition values), if any."""
    try:
        snaps = spark.read.parquet(f"{base}/snapshots")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition() or "") or "Path does not exist" in str(e):
            return None
        raise
    return snaps.agg(F.max("upto")).first()[0]


def read_latest(spark: SparkSession, base: str, key: str, order: list[str]) -> DataFrame:
    """Current state of a fold: latest row per key over the newest snapshot and later batches.

    Only change folders after the snapshot are read (partition pruning on
    the batch id), so a compacted log stays cheap to read.
    """
    ch = spark.read.parquet(f"{base}/changes")
    upto = _newest_snapshot(spark, base)
    if upto is not None:
        snap = spark.read.parquet(f"{base}/snapshots").where(F.col("upto") == upto).drop("upto")
        ch = snap.unionByName(ch.where(F.col("batch") > upto).drop("batch"))
    else:
        ch = ch.drop("batch")
    return _latest(ch, key, order, [c for c in ch.columns if c != key])


def compact_state(spark: SparkSession, base: str, key: str, order: list[str]) -> int:
    """Write the state up to the newest published batch as a snapshot; returns that batch id.

    Runs beside the stream: the snapshot covers a fixed batch range (batches
    published later are read from the change log), and it becomes visible
    only once written, so readers never see a partial one.
    """
    ch = spark.read.parquet(f"{base}/changes")
    upto = ch.agg(F.max("batch")).first()[0]
    prev = _newest_snapshot(spark, base)
    rows = ch.where(F.col("batch") <= upto)
    if prev is not None:
        snap = spark.read.parquet(f"{base}/snapshots").where(F.col("upto") == prev).drop("upto")
        rows = snap.unionByName(rows.where(F.col("batch") > prev).drop("batch"))
    else:
        rows = rows.drop("batch")
    state = _latest(rows, key, order, [c for c in rows.columns if c != key])
    state.write.mode("overwrite").parquet(f"{base}/snapshots/upto={upto}")
    return upto


def failure_state_stream(calls: DataFrame, name: str = "failures", base: str | None = None) -> str:
    """S3: running failure state per key (latest state-changing call; I7 + I4)."""
    ev = CG.failure_events(calls)
    return fold_latest_stream(ev, "api_key", ["ts", "call_id"], ["failed", "reason"], name, base)


def read_failure_state(spark: SparkSession, base: str) -> DataFrame:
    return (read_latest(spark, base, "api_key", ["ts", "call_id"]).where("failed")
            .select("api_key", F.col("ts").alias("fail_time"), "reason"))


def cache_state_stream(calls: DataFrame, name: str = "cache", base: str | None = None) -> str:
    """S2 exact: response cache upserted per micro-batch (I5, last write wins)."""
    ok = CG.with_hash(CG.successes(calls))
    return fold_latest_stream(ok, "prompt_hash", ["ts", "call_id"], ["response"], name, base)


def read_cache_state(spark: SparkSession, base: str) -> DataFrame:
    return (read_latest(spark, base, "prompt_hash", ["ts", "call_id"])
            .select("prompt_hash", "response", F.col("ts").alias("timestamp")))


# S4 -----------------------------------------------------------------------
def logins_per_local_day(logs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Login count per local calendar day (text time stamps are local wall clock)."""
    x = (logs.where(F.col("action") == FV.LOGIN_ACTION)
         .withColumn("event_ts", F.to_timestamp("timestamp", FV.LOG_TIME_FORMAT)))
    return (x.withWatermark("event_ts", delay)
             .groupBy(F.window("event_ts", "1 day").alias("w"))
             .agg(F.count(F.lit(1)).alias("logins"))
             .select(F.to_date(F.col("w.start")).alias("day"), "logins"))


# S5 -----------------------------------------------------------------------
def code_interval_join(issues: DataFrame, attempts: DataFrame,
                       ttl_seconds: int = FV.CODE_TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Attempts within ``ttl`` after an issue of the same user (stream-stream join)."""
    i = (event_time(issues, "ts", "i_ts").withWatermark("i_ts", delay)
         .select(F.col("user_id").alias("i_user"), "i_ts", F.col("code").alias("issue_code")))
    a = (event_time(attempts, "ts", "a_ts").withWatermark("a_ts", delay)
         .select("event_id", F.col("user_id").alias("a_user"), "a_ts", "code"))
    cond = ((F.col("a_user") == F.col("i_user")) & (F.col("a_ts") >= F.col("i_ts"))
            & (F.col("a_ts") <= F.col("i_ts") + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")))
    return a.join(i, cond, "inner").select(
        "event_id", F.col("a_user").alias("user_id"), F.col("a_ts").cast("timestamp_ntz").alias("ts"),
        F.col("i_ts").cast("timestamp_ntz").alias("issue_ts"), (F.col("code") == F.col("issue_code")).alias("code_ok"))


def attempt_outcomes(events: DataFrame, ttl_seconds: float = FV.CODE_TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """The outcome of every code attempt, also those without a pending issue, expired or wrong.

    ``events(event_id, user_id, kind, code, ts)`` may arrive in any order
    within the delay. A user's rows wait in keyed state until the watermark
    passes them, then they are replayed in time order (issues before attempts
    at one instant): an issue replaces the one before, the first attempt that
    is right or too late uses it up. The state of a user is that issue and the
    rows still waiting; an event-time timer wakes it when the watermark
    passes the first of them. Same rows as ``accounts.match_codes`` for all
    attempts before the watermark.
    """
    import json

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    ttl = ttl_seconds * 1_000_000
    cols = ["event_id", "user_id", "at", "code", "issue_at", "outcome"]

    def replay(key, chunks, state):
        issue, waiting = json.loads(state.get[0]) if state.exists else (None, [])
        if not state.hasTimedOut:
            for pdf in chunks:
                waiting += [[int(a), int(t), int(e), c] for a, t, e, c in zip(pdf["at"], pdf.attempt, pdf.event_id, pdf.code)]
        passed, out = state.getCurrentWatermarkMs() * 1000, []
        waiting.sort(key=lambda r: r[:3])
        due = next((k for k, r in enumerate(waiting) if r[0] >= passed), len(waiting))
        for at, attempt, event, code in waiting[:due]:
            if not attempt:
                issue = [at, code, False]
                continue
            if issue is None or issue[2]:
                outcome = "no_pending"
            elif at - issue[0] > ttl:
                outcome = "expired"
            else:
                outcome = "ok" if code == issue[1] else "invalid"
            if outcome in ("ok", "expired"):
                issue[2] = True
            out.append((event, key[0], at, code, issue and issue[0], outcome))
        waiting = waiting[due:]
        state.update((json.dumps([issue, waiting]),))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=cols).astype({"issue_at": "Int64"})

    e = event_time(events).withWatermark("event_ts", delay).select(
        "event_id", "user_id", "event_ts", F.unix_micros("event_ts").alias("at"),
        (F.col("kind") == "attempt").alias("attempt"), F.coalesce("code", F.lit("")).alias("code"))
    out = e.groupBy("user_id").applyInPandasWithState(
        replay, "event_id long, user_id long, at long, code string, issue_at long, outcome string", "state string", "append",
        GroupStateTimeout.EventTimeTimeout)
    stamp = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return out.select("event_id", "user_id", stamp("at").alias("ts"), "code", stamp("issue_at").alias("issue_ts"), "outcome")


# J4/A5 --------------------------------------------------------------------
class IngestWriter:
    """Publishes micro-batches of submissions so that a repeated one changes nothing.

    Batch E gets the ids after those of batch E-1, whose last id the ledger
    holds; both its rows (``rows/batch=E``) and its rejected records
    (``rejected/batch=E``) have a folder of their own, which a repeat
    overwrites with the same rows under the same ids, as a repeated
    micro-batch holds the same records. The ledger entry is written last and
    is the publish marker: readers see no batch without one. One writer at a
    time; ``existing`` is the table before the stream's first batch.
    """

    def __init__(self, spark: SparkSession, base: str, existing: DataFrame, model_labels: DataFrame, rs: RuleSet,
                 as_of: str | _dt.datetime, id_col: str = "sub_id"):
        self.spark, self.base, self.existing, self.labels = spark, base, existing, model_labels
        self.rs, self.as_of, self.id_col = rs, as_of, id_col

    def _last(self, epoch: int) -> int:
        """The last id given before batch ``epoch``."""
        if epoch == 0:
            return self.existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        return self.spark.read.parquet(f"{self.base}/ledger/batch={epoch - 1}").first()["last_id"]

    def publish(self, batch: DataFrame, epoch: int) -> None:
        last = self._last(epoch)
        before = self.spark.range(1).select(F.lit(last).cast("long").alias("id"))
        done = IG.ingest(batch, before, self.labels, self.rs, self.as_of, self.id_col)
        rows = f"{self.base}/rows/batch={epoch}"
        done.accepted.write.mode("overwrite").parquet(rows)
        done.rejected.write.mode("overwrite").parquet(f"{self.base}/rejected/batch={epoch}")
        n = self.spark.read.parquet(rows).count()
        self.spark.range(1).select(F.lit(last + n).cast("long").alias("last_id"), F.lit(n).cast("long").alias("accepted")).coalesce(
            1).write.mode("overwrite").parquet(f"{self.base}/ledger/batch={epoch}")


def ingest_stream(submissions: DataFrame, existing: DataFrame, model_labels: DataFrame, rs: RuleSet,
                  as_of: str | _dt.datetime, base: str | None = None) -> str:
    """Ingest a stream of submissions exactly once; returns its folder (pass it as ``base`` to go on after a stop)."""
    spark = submissions.sparkSession
    base = base or scratch_path(spark, "stream-ingest")
    writer = IngestWriter(spark, base, existing, model_labels, rs, as_of)
    q = (submissions.writeStream.foreachBatch(writer.publish)
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return base


def read_ingested(spark: SparkSession, base: str, part: str = "rows") -> DataFrame:
    """Rows (or ``rejected`` records) of the published batches, with the number of their batch."""
    ledger = spark.read.parquet(f"{base}/ledger").select("batch")
    return spark.read.parquet(f"{base}/{part}").join(ledger, "batch", "left_semi")
