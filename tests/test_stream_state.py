"""The contact set's state ends with its window: nothing stays, nothing is lost, a restart repeats nothing."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from careops.operators import retention
from careops.streaming import extracts as S
from tests.conftest import rows

WINDOW = ("2018-04-02 00:00:00", "2018-07-01 00:00:00")
SCHEMAS = {
    "calls": "order_id long, origin_lob string, start_timestamp timestamp_ntz",
    "chats": "order_id long, lob string, chat_timestamp timestamp_ntz",
    "emails": "order_id long, lob string, created_at timestamp_ntz",
}


def land(spark, base, name, *records):
    """One file of (order, moment) records."""
    df = spark.createDataFrame([(o, "Customer", t) for o, t in records], "o long, l string, t string")
    cols = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    df.select(F.col("o").alias(cols[0]), F.col("l").alias(cols[1]), F.col("t").cast("timestamp_ntz").alias(cols[2])).coalesce(
        1).write.mode("append").parquet(f"{base}/{name}")


def run(spark, base):
    streams = [S.read_stream(spark, f"{base}/{n}", spark.createDataFrame([], s).schema, max_files=1)
               for n, s in SCHEMAS.items()]
    q = (S.contacted_orders_stream(*streams, *WINDOW, lateness="2 days").writeStream.format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(240)
    return q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_state_is_empty_after_the_end(spark):
    base = tempfile.mkdtemp(prefix="careops-stream-", dir="/tmp")
    land(spark, base, "calls", (1, "2018-04-05 10:00:00"), (1, "2018-05-05 10:00:00"), (2, "2018-06-30 23:00:00"))
    land(spark, base, "chats", (3, "2018-06-01 10:00:00"), (8, "2018-04-01 10:00:00"))
    land(spark, base, "emails", (2, "2018-04-02 00:00:00"), (4, "2018-07-01 00:00:00"), (7, "2018-07-01 00:00:01"))
    during = run(spark, base)
    assert during == 4  # orders 1 to 4
    land(spark, base, "calls", (1, "2018-04-03 10:00:00"), (5, "2018-04-04 10:00:00"))  # late, but the window is not over
    assert run(spark, base) == 5
    for name in SCHEMAS:  # all three streams come past the end
        land(spark, base, name, (9, "2018-07-20 10:00:00"))
    run(spark, base)
    for name in SCHEMAS:
        land(spark, base, name, (9, "2018-07-21 10:00:00"))
    assert run(spark, base) == 0
    batch = [spark.read.parquet(f"{base}/{n}") for n in SCHEMAS]
    assert rows(spark.read.parquet(f"{base}/out")) == rows(retention.contacted_orders(*batch, *WINDOW)) == [
        (1,), (2,), (3,), (4,), (5,)]
    land(spark, base, "calls", (6, "2018-05-01 10:00:00"))  # after the end and its lateness: no longer counted
    assert run(spark, base) == 0
    assert spark.read.parquet(f"{base}/out").count() == 5


def test_call_totals_keep_no_calls_after_the_end(spark):
    from careops.operators import service
    from careops.streaming.service import answer_time_buckets_stream

    base = tempfile.mkdtemp(prefix="careops-stream-", dir="/tmp")
    flags = [f"was_ans_in_{n}s" for n in (15, 30, 45, 60, 90, 120, 300)]

    def land_calls(*records):
        df = spark.createDataFrame([(g, t) for g, t in records], "call_guid long, t string")
        df.select("call_guid", F.col("t").cast("timestamp_ntz").alias("start_timestamp"), F.lit("X").alias("origin_country_name"),
                  *[F.lit(True).alias(c) for c in ("csat_good", "was_answered", *flags)], F.lit(False).alias("csat_bad")
                  ).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def totals():
        calls = spark.read.parquet(f"{base}/in")
        stream = S.read_stream(spark, f"{base}/in", calls.schema, max_files=1)
        name = f"totals_{len(calls.inputFiles())}"
        q = (answer_time_buckets_stream(stream, *WINDOW, lateness="1 day").writeStream.outputMode("complete")
             .format("memory").queryName(name).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination(240)
        held = [o["numRowsTotal"] for o in q.lastProgress["stateOperators"] if "dedup" in o["operatorName"].lower()]
        return rows(spark.table(name)), held

    land_calls((1, "2018-04-05 10:00:00"), (1, "2018-04-05 10:00:00"), (2, "2018-06-30 10:00:00"), (3, "2018-07-02 10:00:00"))
    got, held = totals()
    assert got == rows(service.answer_time_buckets(spark.read.parquet(f"{base}/in"), *WINDOW)) and held == [2]
    for day in ("20", "21"):
        land_calls((9, f"2018-07-{day} 10:00:00"))
        got, held = totals()
    assert held == [0]
    assert got == rows(service.answer_time_buckets(spark.read.parquet(f"{base}/in"), *WINDOW))
