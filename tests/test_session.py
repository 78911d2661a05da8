"""Stored tables: buckets that save a shuffle, and tables that are dropped."""

import os

from lexilake.session import durable, durable_by, forget


def test_buckets_save_a_shuffle(spark):
    stored = durable_by(spark.range(5000).selectExpr("id", "id * 2 AS v"), "id")
    other = spark.range(3000).selectExpr("id", "id AS w").hint("merge")
    joined = stored.join(other, "id")
    assert joined.count() == 3000
    plan = stored.join(other, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    path = stored._stored_at.replace("file:", "")
    assert os.path.isdir(path)
    forget(stored)
    assert not os.path.isdir(path) and not spark.catalog.tableExists(stored._stored_as)


def test_only_stored_tables_are_dropped(spark):
    plain, stored = spark.range(3), durable(spark.range(3))
    path = stored._stored_at.replace("file:", "")
    forget(plain, stored)
    assert not os.path.isdir(path) and plain.count() == 3
