"""Landed tables and the driver's memory."""

import os
import re

from pyspark.sql import functions as F

from hopweave.operators import walks
from hopweave.plans import tables


def test_release_hands_free_native_memory_back(spark, monkeypatch):
    said, trim = [], tables.trim_driver
    monkeypatch.setattr(tables, "trim_driver", lambda s: said.append(trim(s)))
    tables.release(spark)
    assert len(said) == 1 and "Trim native heap" in said[0]


def shuffled(spark):
    """Shuffles whose files no finished query has given back."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = [f for top in manager.localDirs() for _, _, files in os.walk(top.getPath()) for f in files]
    return {m[1] for f in names if (m := re.match(r"shuffle_(\d+)_.*\.data", f))}


def test_landed_tables_and_plans_leave_no_shuffle_files(spark):
    rows = spark.range(100).selectExpr("id % 9 AS src", "id % 7 AS dst", "1 AS weight").repartition(3, "src")
    before = shuffled(spark)
    e = tables.land(spark, rows.groupBy("src", "dst").agg(F.max("weight").alias("weight")), "tidy")
    assert not shuffled(spark) - before
    assert walks.plan(e, 3).steps == [63, 441, 3087]
    assert len(shuffled(spark) - before) <= 1  # of the one row of sums over all arcs
