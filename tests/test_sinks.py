"""``CREATE OR REPLACE TABLE``: whole replacement, failed writes, results that read what they replace."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from careops import sinks
from tests.conftest import rows


@pytest.fixture
def name(spark):
    n = f"replaced_{uuid.uuid4().hex[:8]}"
    yield n
    spark.sql(f"drop view if exists {n}")


def failing(spark):
    """Rows of which one breaks while it is written."""
    return spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(
        F.raise_error(F.lit("broken row")).cast("long")).alias("id"))


def test_a_replaced_table_has_the_new_rows_and_schema(spark, name):
    sinks.replace_table(spark.range(3), name)
    assert rows(spark.table(name)) == [(0,), (1,), (2,)]
    sinks.replace_table(spark.sql("select 7 as a, 'x' as b"), name)
    assert spark.table(name).columns == ["a", "b"] and rows(spark.table(name)) == [(7, "x")]


@pytest.mark.parametrize("as_path", [False, True])
def test_a_failing_write_leaves_the_old_table(spark, name, tmp_path, as_path):
    target = f"{tmp_path}/out" if as_path else name
    read = lambda: rows(spark.read.parquet(target) if as_path else spark.table(target))
    sinks.replace_table(spark.range(2), target, as_path=as_path)
    with pytest.raises(Exception, match="broken row"):
        sinks.replace_table(failing(spark), target, as_path=as_path)
    assert read() == [(0,), (1,)]


@pytest.mark.parametrize("as_path", [False, True])
def test_a_result_may_replace_what_it_reads(spark, name, tmp_path, as_path):
    target = f"{tmp_path}/out" if as_path else name
    read = lambda: spark.read.parquet(target) if as_path else spark.table(target)
    sinks.replace_table(spark.range(3), target, as_path=as_path)
    for _ in range(2):
        sinks.replace_table(read().select((F.col("id") + 10).alias("id")), target, as_path=as_path)
    assert rows(read()) == [(20,), (21,), (22,)]


def test_readers_that_began_keep_their_files(spark, name):
    sinks.replace_table(spark.range(2), name)
    before = spark.table(name)
    sinks.replace_table(spark.range(5), name)
    assert before.count() == 2 and spark.table(name).count() == 5
    assert sinks.drop_old_versions(spark, name) == 1
    assert spark.table(name).count() == 5


def test_date_partitions_still_prune(spark, name):
    df = spark.range(10).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("day"))
    sinks.replace_table(df, name, partition_by=["day"])
    some = spark.table(name).filter(F.col("day") == F.lit("2024-01-02").cast("date"))
    assert sorted(r.id for r in some.collect()) == [1, 4, 7]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_a_table_made_in_another_way_is_put_aside(spark, name):
    spark.range(1).write.saveAsTable(name)
    sinks.replace_table(spark.range(2), name)
    assert spark.table(name).count() == 2
    aside = [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name}_before_")]
    assert len(aside) == 1 and spark.table(aside[0]).count() == 1
    spark.sql(f"drop table {aside[0]}")
