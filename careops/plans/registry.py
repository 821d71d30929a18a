"""Named queries over the test tables, and their oracle SQL.

``queries()[name](spark, sf_dir)`` returns the Spark DataFrame;
``oracle_sql()[name]`` the DuckDB statement that must give the same rows.
Both turn decimals into doubles (see ``present``) unless ``exact`` is set.
Every query reads whole test tables (through ``testdata_sources``).
"""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from careops.plans import compositions as C
from careops.plans.oracle import OracleSQL, full
from careops.plans.params import TESTDATA, Params
from careops.sources.catalog import Sources
from careops.sources.testdata import testdata_sources

Query = Callable[[SparkSession, str], DataFrame]


# One Sources (lazy plans, no data) per session and data folder, as a
# deployment would build it once; every query still reads all its data.
_SOURCES: "weakref.WeakKeyDictionary[SparkSession, dict[str, Sources]]" = weakref.WeakKeyDictionary()


def sources_for(spark: SparkSession, sf_dir: str) -> Sources:
    per_session = _SOURCES.setdefault(spark, {})
    if sf_dir not in per_session:
        per_session[sf_dir] = testdata_sources(spark, sf_dir)
    return per_session[sf_dir]


def present(df: DataFrame) -> DataFrame:
    """Money and rates leave the registered queries as double.

    Arithmetic stays exact decimal inside the operators; one final,
    correctly rounded conversion makes the compared values independent of
    how a consumer renders decimals.  The oracle SQL does the same.
    """
    return df.select(
        *[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name)
          for f in df.schema.fields]
    )


def _bind(fn: Callable, p: Params = TESTDATA, exact: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(sources_for(spark, sf_dir), p)
        return df if exact else present(df)

    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _retention_flags(src, p, two_flags: bool):
    return C.flags(src, p, C.week_cohorts(src, p, "plain"), two_flags=two_flags)


def _retention_activity(src, p, exclusive: bool, masks: bool = False):
    return C.activity(
        src, p, C.week_cohorts(src, p, "plain"), p.week_window, two_flags=True, exclusive=exclusive, masks=masks)


def _spark_queries() -> dict[str, Callable]:
    from careops.operators import retention as R

    return {
        # retention building blocks
        "first_order_cohort_day": C.day_cohorts,
        "first_order_cohort_week": lambda s, p: C.week_cohorts(s, p, "plain"),
        "first_order_cohort_week_core_zone": lambda s, p: C.week_cohorts(s, p, "core_zone"),
        "first_order_cohort_week_geo": lambda s, p: C.week_cohorts(s, p, "geo"),
        "contacted_orders": C.contacted,
        "self_serve_orders": C.self_served,
        "cohort_contact_flags": lambda s, p: _retention_flags(s, p, two_flags=True),
        "cohort_contact_flags_contact_only": lambda s, p: _retention_flags(s, p, two_flags=False),
        "retention_activity": lambda s, p: _retention_activity(s, p, exclusive=False),
        "retention_activity_exclusive": lambda s, p: _retention_activity(s, p, exclusive=True),
        "retained_users": lambda s, p: R.retained_users(
            _retention_activity(s, p, False, masks=True), "cs_contact", 0, p.horizon_weeks),
        "cohort_totals": lambda s, p: R.cohort_totals(_retention_activity(s, p, False, masks=True), "cs_contact", 0),
        # the four retention analyses
        "retention_day_retained": lambda s, p: C.retention_day(s, p)[0],
        "retention_day_totals": lambda s, p: C.retention_day(s, p)[1],
        "retention_core_zone_retained": lambda s, p: C.retention_core_zone(s, p)[0],
        "retention_core_zone_totals": lambda s, p: C.retention_core_zone(s, p)[1],
        "retention_self_serve_retained": lambda s, p: C.retention_self_serve(s, p)[0],
        "retention_self_serve_totals": lambda s, p: C.retention_self_serve(s, p)[1],
        "retention_geo_retained": lambda s, p: C.retention_geo(s, p)[0],
        "retention_geo_totals": lambda s, p: C.retention_geo(s, p)[1],
        # contact extracts
        "call_extract": C.calls_extract,
        "chat_extract": C.chats_extract,
        "chat_transcript": C.transcript,
        "multi_message_chats": lambda s, p: C.multi_message(s, p, "rows"),
        "multi_message_chats_distinct": lambda s, p: C.multi_message(s, p, "distinct"),
        # service reports
        "answer_time_buckets": C.answer_buckets,
        "claim_cost_summary": C.claim_costs,
        # payment adjustment
        "alcohol_true_positives": C.true_positives,
        "alcohol_false_negatives": C.false_negatives,
        "alcohol_order_totals": C.alcohol_totals,
        "order_adjustments": C.adjustments,
        "orders_with_alcohol": C.orders_alcohol,
        "commission_same_day": lambda s, p: C.commission_tier(s, p, 1),
        "commission_fortnight": lambda s, p: C.commission_tier(s, p, 2),
        "commission_anytime": lambda s, p: C.commission_tier(s, p, 3),
        "commission_default": lambda s, p: C.commission_tier(s, p, 4),
        "commission_combined": C.commission_combined,
        "payment_adjustment": C.payment_adjustment,
    }


def queries(p: Params = TESTDATA, exact: bool = False) -> dict[str, Query]:
    """The named queries; ``exact`` leaves money and rates as the decimals that the operators return."""
    return {name: _bind(fn, p, exact) for name, fn in _spark_queries().items()}


def oracle_sql(p: Params = TESTDATA, exact: bool = False) -> dict[str, str]:
    o = OracleSQL(p)
    plain, zone, geo, day = (o.cohorts_week("plain"), o.cohorts_week("core_zone"),
                             o.cohorts_week("geo"), o.cohorts_day())
    act = lambda cohorts, two, excl=False: o.activity(o.flags(cohorts, two), two, excl)
    act_day = o.activity(o.flags(day, False, p.day_contact_window), False, False)
    act2 = act(plain, True)
    act2x = act(plain, True, True)
    sql = {
        "first_order_cohort_day": day,
        "first_order_cohort_week": plain,
        "first_order_cohort_week_core_zone": zone,
        "first_order_cohort_week_geo": geo,
        "contacted_orders": o.contacts(),
        "self_serve_orders": o.self_serve(),
        "cohort_contact_flags": o.flags(plain, True),
        "cohort_contact_flags_contact_only": o.flags(plain, False),
        "retention_activity": act2,
        "retention_activity_exclusive": act2x,
        "retained_users": o.retained(act2, "cs_contact", 0),
        "cohort_totals": o.totals(act2, "cs_contact", 0),
        "retention_day_retained": o.retained(act_day, "cs_contact", 0),
        "retention_day_totals": o.totals(act_day, "cs_contact", 0),
        "retention_core_zone_retained": o.retained(act(zone, False), "cs_contact", 1),
        "retention_core_zone_totals": o.totals(act(zone, False), "cs_contact", 0),
        "retention_self_serve_retained": o.retained(act2x, "self_serve", 1),
        "retention_self_serve_totals": o.totals(act2x, "self_serve", 1),
        "retention_geo_retained": o.retained(act(geo, True), "cs_contact", 0),
        "retention_geo_totals": o.totals(act(geo, True), "cs_contact", 1, with_cohort=False),
        "call_extract": o.call_extract(),
        "chat_extract": o.chat_extract(),
        "chat_transcript": o.transcript(),
        "multi_message_chats": o.multi_message("rows"),
        "multi_message_chats_distinct": o.multi_message("distinct"),
        "answer_time_buckets": o.answer_buckets(),
        "claim_cost_summary": o.claim_costs(),
        "alcohol_true_positives": o.true_positives(),
        "alcohol_false_negatives": o.false_negatives(),
        "alcohol_order_totals": o.alcohol_totals(),
        "order_adjustments": o.adjustments(),
        "orders_with_alcohol": o.orders_alcohol(),
        "commission_same_day": o.commission(1),
        "commission_fortnight": o.commission(2),
        "commission_anytime": o.commission(3),
        "commission_default": o.commission(4),
        "commission_combined": o.commission(),
        "payment_adjustment": o.payment(),
    }
    statements = {k: full(v) for k, v in sql.items()}
    return statements if exact else present_sql(statements)


# Any folder of the test tables will do: only column types are read.
_TYPE_DIRS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1")
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")


def present_sql(statements: dict[str, str]) -> dict[str, str]:
    """Wrap each statement so its DECIMAL columns come out as DOUBLE (see ``present``).

    The decimal columns are found with DuckDB's ``DESCRIBE``, which plans the
    statement without running it.
    """
    import os

    import duckdb

    folder = next((d for d in _TYPE_DIRS if os.path.exists(f"{d}/orders.parquet")), None)
    if folder is None:
        raise FileNotFoundError("no test-table folder to read column types from")
    con = duckdb.connect()
    for t in _TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    out = {}
    for name, sql in statements.items():
        cols = con.execute(f"describe {sql}").fetchall()
        exprs = [
            f'cast("{c}" as double) as "{c}"' if str(t).upper().startswith("DECIMAL") else f'"{c}"'
            for c, t, *_ in cols
        ]
        out[name] = f"select {', '.join(exprs)}\nfrom (\n{sql}\n) presented"
    con.close()
    return out
