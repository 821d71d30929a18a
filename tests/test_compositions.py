"""The original analyses' parameter set runs end to end, and the sinks work."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from careops import sinks
from careops.plans import compositions as C
from careops.plans.params import TESTDATA, WAREHOUSE
from careops.sources.testdata import testdata_sources
from tests.conftest import SF_SMALL, rows

ANALYSES = [
    lambda s, p: C.retention_day(s, p)[0],
    lambda s, p: C.retention_core_zone(s, p)[1],
    lambda s, p: C.retention_self_serve(s, p)[0],
    lambda s, p: C.retention_geo(s, p)[1],
    C.calls_extract,
    lambda s, p: C.multi_message(s, p, "rows"),
    C.answer_buckets,
    C.claim_costs,  # as_of = None: the current date
    C.payment_adjustment,
]


@pytest.mark.parametrize("i", range(len(ANALYSES)))
def test_warehouse_parameters_run(spark, i):
    # The 2018 dates select nothing in the test tables; the plans must still run.
    df = ANALYSES[i](testdata_sources(spark, SF_SMALL), WAREHOUSE)
    assert df.count() >= 0


def test_sinks_round_trip(spark):
    src = testdata_sources(spark, SF_SMALL)
    calls = C.calls_extract(src, TESTDATA)
    view = sinks.temp_view(calls, "tmp_first_source_call_data")
    assert rows(spark.sql("select * from tmp_first_source_call_data")) == rows(view)
    path = tempfile.mkdtemp(prefix="careops-sink-", dir="/tmp") + "/calls"
    sinks.replace_table(calls.withColumn("day", F.to_date("local_start_timestamp")), path, ["day"], as_path=True)
    back = spark.read.parquet(path).drop("day")
    assert rows(back, calls.columns) == rows(calls)


def test_command_line_runner(spark):
    import json as _json

    from careops.__main__ import main

    base = tempfile.mkdtemp(prefix="careops-cli-", dir="/tmp")
    main(["--analysis", "claim_cost_summary", "--testdata", SF_SMALL, "--params", "testdata",
          "--out", f"{base}/claims"])
    got = rows(spark.read.parquet(f"{base}/claims"))
    want = rows(C.claim_costs(testdata_sources(spark, SF_SMALL), TESTDATA))
    assert got == want
    # relation mapping form: Parquet paths written from the derived relations
    src = testdata_sources(spark, SF_SMALL)
    mapping = {}
    for name in ("calls",):
        src[name].write.parquet(f"{base}/in/{name}")
        mapping[name] = f"{base}/in/{name}"
    with open(f"{base}/sources.json", "w") as fh:
        _json.dump(mapping, fh)
    main(["--analysis", "call_extract", "--sources", f"{base}/sources.json", "--params", "testdata",
          "--out", f"{base}/calls_out"])
    assert rows(spark.read.parquet(f"{base}/calls_out")) == rows(C.calls_extract(src, TESTDATA))


def test_sources_from_catalog_tables(spark):
    from careops.sources.catalog import Sources

    derived = testdata_sources(spark, SF_SMALL)
    names = {}
    for rel in ("calls", "chats", "emails", "claims", "orders"):
        sinks.temp_view(derived[rel], f"wh_{rel}")
        names[rel] = f"wh_{rel}"
    src = Sources.from_tables(spark, names)
    assert rows(C.calls_extract(src, TESTDATA)) == rows(C.calls_extract(derived, TESTDATA))
    assert rows(C.retention_geo(src, TESTDATA)[0]) == rows(C.retention_geo(derived, TESTDATA)[0])


def test_june_contacts_have_their_own_window():
    from careops.plans.params import TESTDATA, WAREHOUSE

    assert WAREHOUSE.day_contact_window == ("2018-06-01", "2018-06-30")
    assert TESTDATA.day_contact_window != TESTDATA.contact_window


def test_june_contact_of_the_last_afternoon_does_not_count(spark):
    """The window ends at midnight of 30 June: a call that afternoon or in July is no contact, one of 29 June is."""
    from pyspark.sql import functions as F

    from careops.plans.params import WAREHOUSE

    day, week = WAREHOUSE.day_contact_window, WAREHOUSE.contact_window
    calls = spark.createDataFrame(
        [(1, "2018-06-30 15:00:00"), (2, "2018-06-29 15:00:00"), (3, "2018-07-01 00:00:00"), (4, "2018-05-31 10:00:00")],
        "order_id long, ts string").select(
        "order_id", F.lit("Customer").alias("origin_lob"), F.col("ts").cast("timestamp_ntz").alias("start_timestamp"))
    src = type("S", (), {
        "calls": calls,
        "chats": calls.limit(0).select("order_id", F.col("origin_lob").alias("lob"), F.col("start_timestamp").alias("chat_timestamp")),
        "emails": calls.limit(0).select("order_id", F.col("origin_lob").alias("lob"), F.col("start_timestamp").alias("created_at"))})
    assert sorted(r.order_id for r in C.contacted(src, WAREHOUSE, day).collect()) == [2]
    assert sorted(r.order_id for r in C.contacted(src, WAREHOUSE, week).collect()) == [1, 2, 3, 4]
