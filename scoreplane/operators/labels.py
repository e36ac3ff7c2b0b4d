"""Model-label reconciliation.

Model labels arrive as a table keyed by record id (the model call itself is
an external service). A missing row, an unknown label or an error string
all count as "no valid label".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane import fixed_values as FV
from scoreplane.functions.text import strip_ws


def valid_label(c, labels=None):
    """Exact (case-sensitive) membership after stripping, else NULL."""
    labels = labels or FV.DOMAIN_LABELS
    s = strip_ws(c)
    return F.when(s.isin(labels), s)


def valid_labels(model_labels: DataFrame, label: str = "label", labels=None) -> DataFrame:
    """B8 as a filter: rows whose label is in the valid set."""
    return model_labels.where(valid_label(F.col(label), labels).isNotNull())


def attach_labels(df: DataFrame, model_labels: DataFrame, id_col: str = "id",
                  label: str = "label", out: str = "llm_domain", label_id: str = "id") -> DataFrame:
    """Left join of the label table by record id; invalid labels -> NULL.

    Keeps one label per id (the smallest) so the join never multiplies rows.
    """
    ml = (model_labels.select(F.col(label_id).alias("_lid"), valid_label(F.col(label)).alias("_lbl"))
          .groupBy("_lid").agg(F.min("_lbl").alias(out)))
    return df.join(ml, F.col(id_col) == F.col("_lid"), "left").drop("_lid")


def reconcile(df: DataFrame, kw: str = "kw_domain", llm: str = "llm_domain") -> DataFrame:
    """Final domain, confidence and agreement from keyword and model labels."""
    k, m = F.col(kw), F.col(llm)
    agreed = m.isNotNull() & (F.lower(m) == F.lower(k))
    domain = F.when(m.isNull(), k).otherwise(m)
    confidence = (F.when(m.isNull(), "low").when(agreed, "high")
                  .when(k == FV.UNCLASSIFIED, "high").otherwise("medium"))
    return df.select("*", domain.alias("domain"), confidence.alias("confidence"),
                     F.coalesce(agreed, F.lit(False)).alias("agreed"))


def label_or_keyword(df: DataFrame, kw: str = "kw_domain", llm: str = "llm_domain",
                     out: str = "domain") -> DataFrame:
    """Valid model label, else the keyword label."""
    return df.withColumn(out, F.coalesce(F.col(llm), F.col(kw)))
