"""Streaming extracts give the batch results (sf0.001 relations landed as files)."""

from __future__ import annotations

import tempfile

from careops.plans import compositions as C
from careops.plans.params import TESTDATA
from careops.sources.testdata import testdata_sources
from careops.streaming import extracts as S
from tests.conftest import SF_SMALL, rows


def test_streamed_extracts_equal_batch(spark):
    src = testdata_sources(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="careops-stream-", dir="/tmp")
    for name in ("calls", "chats", "emails"):
        src[name].repartition(3).write.parquet(f"{base}/in/{name}")
    p = TESTDATA
    calls = S.read_stream(spark, f"{base}/in/calls", src.calls.schema, max_files=1)
    q = S.stream_call_extract(calls, f"{base}/out/calls", f"{base}/ckpt/calls",
                              *p.extract_window, p.extract_excluded_dates, p.lob)
    q.awaitTermination(120)
    chats = S.read_stream(spark, f"{base}/in/chats", src.chats.schema)
    q = S.stream_chat_extract(chats, f"{base}/out/chats", f"{base}/ckpt/chats",
                              *p.extract_window, p.extract_excluded_dates, p.lob)
    q.awaitTermination(120)
    assert rows(spark.read.parquet(f"{base}/out/calls")) == rows(C.calls_extract(src, p))
    assert rows(spark.read.parquet(f"{base}/out/chats")) == rows(C.chats_extract(src, p))

    streams = [S.read_stream(spark, f"{base}/in/{n}", src[n].schema) for n in ("calls", "chats", "emails")]
    contacted = S.contacted_orders_stream(*streams, *p.contact_window, lob=p.lob)
    q = (contacted.writeStream.format("parquet").option("path", f"{base}/out/contacts")
         .option("checkpointLocation", f"{base}/ckpt/contacts").trigger(availableNow=True).start())
    q.awaitTermination(180)
    got = rows(spark.read.parquet(f"{base}/out/contacts"))
    assert got == rows(C.contacted(src, p))


def test_streamed_answer_buckets_equal_batch(spark):
    from careops.streaming.service import answer_time_buckets_stream

    src = testdata_sources(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="careops-stream-", dir="/tmp")
    src.calls.repartition(3).write.parquet(f"{base}/in/calls")
    p = TESTDATA
    calls = S.read_stream(spark, f"{base}/in/calls", src.calls.schema, max_files=1)
    totals = answer_time_buckets_stream(calls, *p.csat_window, p.csat_excluded_countries)
    q = (totals.writeStream.outputMode("complete").format("memory").queryName("csat_running_test")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(180)
    assert rows(spark.table("csat_running_test")) == rows(C.answer_buckets(src, p))


def test_restarted_extract_resumes_without_duplicates(spark):
    from pyspark.sql import functions as F

    src = testdata_sources(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="careops-stream-", dir="/tmp")
    calls = src.calls
    first, second = calls.filter(F.col("call_guid") % 2 == 0), calls.filter(F.col("call_guid") % 2 == 1)
    first.write.parquet(f"{base}/in/part=a")
    p = TESTDATA

    def run():
        stream = S.read_stream(spark, f"{base}/in", calls.schema)
        S.stream_call_extract(stream, f"{base}/out", f"{base}/ckpt", *p.extract_window,
                              p.extract_excluded_dates, p.lob).awaitTermination(120)

    run()                                          # first batch of files
    second.write.parquet(f"{base}/in/part=b")      # more files land
    run()                                          # restart from the checkpoint
    assert rows(spark.read.parquet(f"{base}/out")) == rows(C.calls_extract(src, p))


def test_streams_over_a_long_window_lose_and_repeat_nothing(spark):
    """Ninety days, several files in arrival order: late contacts and contacts far apart."""
    from careops.operators import retention, service
    from careops.streaming.service import answer_time_buckets_stream

    base = tempfile.mkdtemp(prefix="careops-stream-", dir="/tmp")
    src = testdata_sources(spark, SF_SMALL)
    window = ("2018-04-02 00:00:00", "2018-07-01 00:00:00")
    arrivals = [(1, "2018-04-05"), (2, "2018-06-30"), (9, "2018-04-03"), (3, "2018-06-01"), (4, "2018-04-10"), (9, "2018-06-28")]
    names = src.calls.columns
    for k, (order, day) in enumerate(arrivals):  # one file each; order 4 arrives after the end of June
        fixed = {"call_guid": str(k % 5), "order_id": str(order), "start_timestamp": f"'{day} 12:00:00'", "origin_lob": "'Customer'",
                 "origin_country_name": "'X'", "csat_good": "true", "csat_bad": "false", "was_answered": "true"}
        kinds = dict(src.calls.dtypes)
        row = spark.range(1).selectExpr(*[
            f"cast({fixed.get(c, 'false' if kinds[c] == 'boolean' else 'null')} as {kinds[c]}) as {c}" for c in names])
        row.coalesce(1).write.mode("append").parquet(f"{base}/in")
    calls = spark.read.parquet(f"{base}/in")
    none = [src[n].limit(0) for n in ("chats", "emails")]
    for n, df in zip(("chats", "emails"), none):
        df.write.parquet(f"{base}/{n}")
    streams = [S.read_stream(spark, f"{base}/in", src.calls.schema, max_files=1),
               *(S.read_stream(spark, f"{base}/{n}", df.schema) for n, df in zip(("chats", "emails"), none))]
    q = (S.contacted_orders_stream(*streams, *window).writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(180)
    want = rows(retention.contacted_orders(calls, *none, *window))
    assert [r[0] for r in want] == [1, 2, 3, 4, 9]
    assert rows(spark.read.parquet(f"{base}/out")) == want
    totals = answer_time_buckets_stream(S.read_stream(spark, f"{base}/in", src.calls.schema, max_files=1), *window)
    q = (totals.writeStream.outputMode("complete").format("memory").queryName("csat_long_window")
         .option("checkpointLocation", f"{base}/ckpt2").trigger(availableNow=True).start())
    q.awaitTermination(180)
    assert rows(spark.table("csat_long_window")) == rows(service.answer_time_buckets(calls, *window))
