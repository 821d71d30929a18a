"""Run one analysis and write its result.

    PYTHONPATH=. spark-submit careops/__main__.py --sources sources.json \\
        --analysis payment_adjustment --params warehouse --out scratch.payment_adjustment

(on a cluster ship the package with ``--py-files``; locally ``python -m
careops …`` works too).

``sources.json`` maps relation names (see ``careops.sources.schemas``) to a
catalog table name or a Parquet path (anything containing ``/``).  With
``--testdata DIR`` the relations are derived from the shared test tables
instead.  ``--out`` is a table name or a path (written as Parquet).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from careops import sinks
from careops.plans import compositions as C
from careops.plans.params import TESTDATA, WAREHOUSE
from careops.session import configure
from careops.sources.catalog import Sources
from careops.sources.testdata import testdata_sources

ANALYSES = {
    "retention_day_retained": lambda s, p: C.retention_day(s, p)[0],
    "retention_day_totals": lambda s, p: C.retention_day(s, p)[1],
    "retention_core_zone_retained": lambda s, p: C.retention_core_zone(s, p)[0],
    "retention_core_zone_totals": lambda s, p: C.retention_core_zone(s, p)[1],
    "retention_self_serve_retained": lambda s, p: C.retention_self_serve(s, p)[0],
    "retention_self_serve_totals": lambda s, p: C.retention_self_serve(s, p)[1],
    "retention_geo_retained": lambda s, p: C.retention_geo(s, p)[0],
    "retention_geo_totals": lambda s, p: C.retention_geo(s, p)[1],
    "call_extract": C.calls_extract,
    "chat_extract": C.chats_extract,
    "chat_transcript": C.transcript,
    "multi_message_chats": lambda s, p: C.multi_message(s, p, "rows"),
    "answer_time_buckets": C.answer_buckets,
    "claim_cost_summary": C.claim_costs,
    "orders_with_alcohol": C.orders_alcohol,
    "commission_combined": C.commission_combined,
    "payment_adjustment": C.payment_adjustment,
}


def sources_from_mapping(spark: SparkSession, mapping: dict[str, str]) -> Sources:
    def load(target: str):
        return (lambda: spark.read.parquet(target)) if "/" in target else (lambda: spark.table(target))

    return Sources({name: load(target) for name, target in mapping.items()})


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="careops")
    ap.add_argument("--analysis", required=True, choices=sorted(ANALYSES))
    src_group = ap.add_mutually_exclusive_group(required=True)
    src_group.add_argument("--sources", help="JSON file: relation name -> table or Parquet path")
    src_group.add_argument("--testdata", help="derive the relations from the shared test tables in DIR")
    ap.add_argument("--params", choices=("warehouse", "testdata"), default="warehouse")
    ap.add_argument("--out", required=True, help="table name, or a path (Parquet)")
    args = ap.parse_args(argv)

    spark = configure(SparkSession.builder.getOrCreate())
    if args.testdata:
        src = testdata_sources(spark, args.testdata)
    else:
        with open(args.sources) as fh:
            src = sources_from_mapping(spark, json.load(fh))
    params = WAREHOUSE if args.params == "warehouse" else TESTDATA
    df = ANALYSES[args.analysis](src, params)
    sinks.replace_table(df, args.out, as_path="/" in args.out)


if __name__ == "__main__":
    main()
