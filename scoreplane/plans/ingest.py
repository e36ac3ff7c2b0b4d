"""Ingest a batch of scored records (compose, classify, reconcile, validate, stamp, append).

One plan per batch; the only shuffles are the label join by record id and
the id assignment.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreplane import fixed_values as FV
from scoreplane.functions.text import compose_text
from scoreplane.operators import labels as LB
from scoreplane.operators.tables import assign_ids
from scoreplane.plans.classify import classify
from scoreplane.rules import RuleSet
from scoreplane.session import checkpoint_dir
from scoreplane.sources.schemas import SCORE_COLUMNS

INT_SCORES = [c for c in SCORE_COLUMNS if c != "format_score"]


def _num_ok(c: Column, lo: float, hi: float) -> Column:
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (d >= lo) & (d <= hi)


def validation_errors(df: DataFrame) -> Column:
    """Names of failing fields (all reasons, not only the first)."""
    checks = [F.when(~_num_ok(F.col(c), 0, 100), F.lit(c)) for c in INT_SCORES]
    fmt = F.coalesce(F.col("format_score").cast("double"), F.lit(0.0)) if "format_score" in df.columns \
        else F.lit(0.0)
    checks.append(F.when(F.isnan(fmt) | ~_num_ok(_truncate(fmt), 0, 100), F.lit("format_score")))
    checks.append(F.when(~_num_ok(F.col("bias_score"), 0.0, 1.0), F.lit("bias_score")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def _truncate(d: Column) -> Column:
    """Python ``int()`` on a float: toward zero."""
    return F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("double")


def to_int_score(c: Column) -> Column:
    """Float assigned to an INTEGER column as a decimal literal: half away from zero."""
    return F.round(c.cast("double"), 0).cast("int")


@dataclass
class IngestResult:
    accepted: DataFrame
    rejected: DataFrame


def ingest(batch: DataFrame, existing: DataFrame, model_labels: DataFrame, rs: RuleSet,
           as_of: str | _dt.datetime, id_col: str = "sub_id") -> IngestResult:
    """Classify, reconcile, validate and number a batch of submissions.

    ``batch``: sub_id, resume_name, candidate_name, seven scores (format may
    be missing or NULL), bias_score, job_title, job_description, resume_text.
    ``as_of`` is the UTC instant of the insert; rows get its local wall clock.
    """
    # validation does not depend on the label: only valid rows are classified
    valid = _with_format(batch).where(F.size(validation_errors(_with_format(batch))) == 0)
    text = compose_text("job_description", "resume_text")
    keep = [c for c in valid.columns if c not in ("job_title", "job_description", "resume_text")]
    k = classify(valid, rs, "job_title", text, keep=keep)
    # Materialise the decided batch once (no text columns are kept): the id
    # assignment's range sampling reads it instead of re-running the classifier.
    checkpoint_dir(batch.sparkSession)
    ok = LB.reconcile(LB.attach_labels(k, model_labels, id_col=id_col)).checkpoint(eager=True)
    local = F.to_timestamp(F.date_format(
        F.from_utc_timestamp(F.lit(as_of).cast("timestamp"), FV.LOCAL_ZONE), FV.LOG_TIME_FORMAT)).cast(
        "timestamp_ntz")
    fmt = F.coalesce(_truncate(F.col("format_score").cast("double")), F.lit(0.0))
    rows = ok.select(
        id_col, "resume_name", "candidate_name",
        *[to_int_score(F.col(c)).alias(c) for c in INT_SCORES],
        fmt.cast("int").alias("format_score"),
        F.col("bias_score").cast("float").alias("bias_score"),
        "domain", "confidence", local.alias("timestamp"))
    numbered = assign_ids(rows, existing, "id", [id_col], materialize=False).drop(id_col)
    return IngestResult(numbered, rejected(batch, id_col))


def _with_format(batch: DataFrame) -> DataFrame:
    if "format_score" not in batch.columns:
        batch = batch.withColumn("format_score", F.lit(None).cast("double"))
    return batch


def rejected(batch: DataFrame, id_col: str = "sub_id") -> DataFrame:
    """Records that fail validation, with every failing field.

    Validation does not depend on the label, so this is map-only (no
    classification); it equals ``ingest(..).rejected``.
    """
    b = _with_format(batch)
    return (b.select(id_col, validation_errors(b).alias("errors"))
             .where(F.size("errors") > 0))
