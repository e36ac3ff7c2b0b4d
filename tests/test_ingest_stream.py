"""A stream of submissions is ingested once, whatever is repeated."""

import os

import pytest
from pyspark.sql import functions as F

from scoreplane.plans import ingest as IG
from scoreplane.plans.registry import INGEST_AS_OF, _RS
from scoreplane.sources import fixtures as FX
from scoreplane.streaming import streams as SS

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _all(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_repeated_batches_and_restart(spark, tmp_path):
    subs = FX.submissions(spark, SF).withColumn("resume_text", F.substring("resume_text", 1, 200))
    old, labels = FX.candidates(spark, SF), FX.model_labels(spark, SF)
    base, src = str(tmp_path / "out"), tmp_path / "in"
    cut = [r[0] for r in subs.selectExpr("percentile(sub_id, array(0.3, 0.6))").collect()][0]
    parts = [subs.where(F.col("sub_id") <= cut[0]), subs.where((F.col("sub_id") > cut[0]) & (F.col("sub_id") <= cut[1])),
             subs.where(F.col("sub_id") > cut[1])]
    src.mkdir()
    stream = spark.readStream.schema(subs.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    for k, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(str(src))
        SS.ingest_stream(stream, old, labels, _RS, INGEST_AS_OF, base)  # goes on where it stopped
        assert SS.read_ingested(spark, base).select("batch").distinct().count() == k + 1
    got = _all(SS.read_ingested(spark, base))
    # a batch run again gives the same rows under the same ids
    writer = SS.IngestWriter(spark, base, old, labels, _RS, INGEST_AS_OF)
    for k in (1, 0):
        writer.publish(parts[k], k)
    assert _all(SS.read_ingested(spark, base)) == got
    whole = IG.ingest(subs, old, labels, _RS, INGEST_AS_OF)
    # parts came in the order of the record ids, so all rows have the ids of one batch
    assert _all(SS.read_ingested(spark, base).drop("batch")) == _all(whole.accepted)
    assert _all(SS.read_ingested(spark, base, "rejected").drop("batch")) == _all(whole.rejected)


def test_a_batch_without_its_ledger_entry_is_not_seen(spark, tmp_path):
    subs = FX.submissions(spark, SF).limit(30).withColumn("resume_text", F.lit("x"))
    base = str(tmp_path / "out")
    writer = SS.IngestWriter(spark, base, FX.candidates(spark, SF), FX.model_labels(spark, SF), _RS, INGEST_AS_OF)
    writer.publish(subs, 0)
    n = SS.read_ingested(spark, base).count()
    # the writer stopped within batch 1, before its ledger entry
    spark.read.parquet(f"{base}/rows/batch=0").limit(3).write.parquet(f"{base}/rows/batch=1")
    assert SS.read_ingested(spark, base).count() == n
    writer.publish(subs, 1)
    ids = [r.id for r in SS.read_ingested(spark, base).collect()]
    assert len(ids) == 2 * n == len(set(ids)) and max(ids) - min(ids) + 1 == 2 * n
