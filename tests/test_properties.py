"""Invariants over the fixture views."""

import os

import pytest
from pyspark.sql import functions as F

from scoreplane.operators import aggregates as AG
from scoreplane.operators import similarity as SM
from scoreplane.operators import tables as TB
from scoreplane.sources import fixtures as FX

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_distribution_percentages_sum_to_100(spark):
    c = FX.candidates(spark, SF)
    total = AG.group_distribution(c).agg(F.sum("percentage")).first()[0]
    assert abs(total - 100.0) < 0.01 * 33
    assert AG.group_distribution(c).agg(F.sum("count")).first()[0] == c.count()


def test_similarity_bounds(spark):
    s = SM.similarity(FX.label_pairs(spark, SF), "resume_domain", "job_domain")
    r = s.agg(F.min("similarity"), F.max("similarity"), F.count("similarity")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0 and r[2] == s.count()
    same = SM.similarity(FX.label_pairs(spark, SF), "resume_domain", "resume_domain")
    assert same.where(F.col("similarity") != 1.0).count() == 0


def test_delete_and_retention_counts_add_up(spark):
    c = FX.candidates(spark, SF)
    ids = c.where(F.col("id") % 2 == 0).select("id")
    assert TB.delete_ids(c, ids).count() + ids.count() == c.count()
    kept = TB.retain_recent(c, FX.AS_OF_DATE, 365).count()
    gone = TB.expired_rows(c, FX.AS_OF_DATE, 365).count()
    assert kept + gone == c.count()
