"""Business relations derived from the shared TPC-H-like test tables.

The warehouse tables the operators were written for are not available, so
each logical relation is derived, column for column, from the test tables
(``/root/testdata/sf*/``).  Every derivation keeps whole tables: rows are
only ever selected by a business attribute (event type, return flag),
never by id ranges, modulo tests or row caps.  Modulo arithmetic appears
only to synthesise attribute values (flags, reasons) row by row.

``careops.sources.testdata_sql`` holds the same derivations as SQL text for
the DuckDB oracle; the two must stay in step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from careops.functions.dealing import dealt, tasks_for
from careops.sources.catalog import Sources


def _plus(ts: str, unit: str, amount: Column) -> Column:
    return F.timestamp_add(unit, amount, F.col(ts))


# File schemas seen so far: later reads pass the schema and skip inference
# (a small job per read otherwise).
_SCHEMAS: dict[str, StructType] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path in _SCHEMAS:
        return spark.read.schema(_SCHEMAS[path]).parquet(path)
    df = spark.read.parquet(path)
    _SCHEMAS[path] = df.schema
    return df


def _lob(user_id: str) -> Column:
    return F.when(F.col(user_id) % 4 == 0, F.lit("Rider")).otherwise(F.lit("Customer"))


def _contact_order(event_id: str) -> Column:
    # Contacts without an order id exist in the warehouse; model them.
    e = F.col(event_id)
    return F.when(e % 11 == 0, F.lit(None).cast("bigint")).otherwise(e - e % 2)


def _reason(event_id: str) -> Column:
    e = F.col(event_id) % 4
    return (
        F.when(e == 0, "late order")
        .when(e == 1, "missing item")
        .when(e == 2, "refund")
        .otherwise("other")
    )


def testdata_sources(spark: SparkSession, sf_dir: str) -> Sources:
    read: dict[str, DataFrame] = {}

    def t(name: str) -> DataFrame:
        # One reader per table resolves each file schema once.  lineitem
        # feeds several relations that later meet in one join; separate
        # readers keep those self-joins plain.
        if name == "lineitem":
            return _table(spark, sf_dir, name)
        if name not in read:
            read[name] = _table(spark, sf_dir, name)
        return read[name]

    def orders() -> DataFrame:
        o = t("orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"
        )
        c = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        # nation is a fixed 25-row domain: a bounded broadcast.
        n = F.broadcast(t("nation").select("n_nationkey", "n_name"))
        # Dealt by row count: the join below meets these rows, the orders and the order list in one stage.
        lines = t("lineitem").select("l_orderkey", "l_suppkey")
        restaurant = (
            dealt(lines, tasks_for(lines, t("lineitem").count()), "l_orderkey")
            .groupBy("l_orderkey")
            .agg(F.min("l_suppkey").alias("restaurant_id"))
        )
        by_user = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return (
            o.join(c, o.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey)
            .join(restaurant, o.o_orderkey == restaurant.l_orderkey, "left")
            .select(
                F.col("o_orderkey").alias("id"),
                F.col("o_custkey").alias("user_id"),
                _plus("o_orderdate", "HOUR", F.col("o_orderkey") % 24).alias("delivered_at"),
                F.col("o_orderdate").alias("created_at"),
                F.row_number().over(by_user).cast("int").alias("order_rank_user"),
                F.col("c_nationkey").alias("zone_id"),
                F.col("n_name").alias("country_name"),
                F.col("c_mktsegment").alias("city_name"),
                "restaurant_id",
                F.when(F.col("o_orderkey") % 50 == 0, F.lit("0.00"))
                .otherwise(F.col("o_totalprice").cast("decimal(10,2)").cast("string"))
                .alias("subtotal"),
                F.when(F.col("o_orderstatus") == "F", "CANCELLED")
                .when(F.col("o_orderstatus") == "P", "CONFIRMED_BY_RESTAURANT")
                .otherwise("DELIVERED")
                .alias("status"),
            )
        )

    def zones() -> DataFrame:
        return t("nation").select(
            F.col("n_nationkey").alias("zone_id"),
            F.when(F.col("n_regionkey").isin(0, 1), 1).otherwise(0).alias("core_zone"),
        )

    def events_with_customer(event_type: str | None) -> DataFrame:
        e = t("events")
        if event_type is not None:
            e = e.filter(F.col("event_type") == event_type)
        c = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        return e.join(c, e.user_id == c.c_custkey)

    def calls() -> DataFrame:
        n = F.broadcast(t("nation").select("n_nationkey", "n_name"))
        e = events_with_customer("click")
        e = e.join(n, e.c_nationkey == n.n_nationkey)
        eid, v = F.col("event_id"), F.col("value")
        queue = eid % 60
        answer = queue + F.floor(v).cast("bigint")
        talk, hold, wrap = eid % 900, eid % 120, eid % 45
        return e.select(
            eid.alias("call_guid"),
            _contact_order("event_id").alias("order_id"),
            _lob("user_id").alias("origin_lob"),
            F.col("ts").alias("start_timestamp"),
            F.col("ts").alias("local_start_timestamp"),
            _plus("ts", "SECOND", queue).alias("local_first_queue_timestamp"),
            _plus("ts", "SECOND", answer).alias("local_first_answer_timestamp"),
            _plus("ts", "SECOND", answer + talk + hold).alias("local_end_timestamp"),
            talk.alias("total_talk_time"),
            hold.alias("total_hold_time"),
            (answer + talk + hold).alias("total_call_duration"),
            wrap.alias("wrap_up_duration"),
            (talk + hold + wrap).alias("total_handle_time"),
            F.concat(F.lit("agent_"), (eid % 37).cast("string")).alias("primary_agent_id"),
            F.col("c_mktsegment").alias("city_name"),
            F.concat(F.lit("07"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("phone_cleaned"),
            _reason("event_id").alias("contact_reason"),
            F.col("n_name").alias("origin_country_name"),
            (eid % 3 == 0).alias("csat_good"),
            (eid % 3 == 1).alias("csat_bad"),
            (eid % 13 != 0).alias("was_answered"),
            (eid % 17 == 0).alias("was_abandoned_under_5_secs"),
            *[(v <= s).alias(f"was_ans_in_{s}s") for s in (15, 30, 45, 60, 90, 120, 300)],
        )

    def chats() -> DataFrame:
        # Every event row is a chat session; its id is the event id, so the
        # conversation table (chat_id = conv_id) attaches transcripts to it.
        e = events_with_customer(None)
        eid = F.col("event_id")
        first = eid % 90
        return e.select(
            eid.alias("id"),
            _contact_order("event_id").alias("order_id"),
            _lob("user_id").alias("lob"),
            F.col("ts").alias("chat_timestamp"),
            F.col("ts").alias("local_chat_timestamp"),
            _plus("ts", "SECOND", first).alias("local_first_response_timestamp"),
            _plus("ts", "SECOND", first + eid % 1200).alias("local_end_timestamp"),
            F.concat(F.lit("agent_"), (eid % 37).cast("string")).alias("agent_ids"),
            F.col("c_mktsegment").alias("city_name"),
            F.col("user_id").alias("visitor_id"),
            _reason("event_id").alias("contact_reason"),
            (eid % 3 == 0).alias("csat_good"),
            (eid % 3 == 1).alias("csat_bad"),
            (1 + eid % 25).cast("int").alias("total_message_count"),
            (eid % 17 == 0).alias("was_abandoned_under_5_secs"),
            (eid % 13 == 0).alias("missed"),
        )

    def chat_event_log() -> DataFrame:
        start = F.timestamp_add(
            "HOUR", F.col("conv_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        )
        return t("conversations").select(
            F.col("conv_id").alias("chat_id"),
            F.timestamp_add("MINUTE", F.col("turn"), start).alias("event_timestamp"),
            F.when(F.col("role") == "system", "chat.system").otherwise("chat.msg").alias("event_type"),
            (F.col("role") == "user").alias("is_visitor_event"),
            (F.col("role") == "assistant").alias("is_agent_event"),
            F.col("text").alias("message_body"),
        )

    def emails() -> DataFrame:
        return t("events").filter(F.col("event_type") == "signup").select(
            _contact_order("event_id").alias("order_id"),
            _lob("user_id").alias("lob"),
            F.col("ts").alias("created_at"),
        )

    def claims() -> DataFrame:
        e = t("events").filter(F.col("event_type") == "error")
        o = t("orders").select("o_orderkey", "o_totalprice")
        eid = F.col("event_id")
        order_key = eid - eid % 4
        e = e.withColumn("claim_order", order_key)
        reason = eid % 5
        return e.join(o, e.claim_order == o.o_orderkey, "left").select(
            # A claim without an order id (fixed-amount goodwill) is kept.
            F.when(eid % 23 == 0, F.lit(None).cast("bigint")).otherwise(F.col("claim_order")).alias("order_id"),
            F.col("ts").alias("claim_time"),
            (eid % 3 == 0).alias("is_self_serve_claim"),
            F.when(reason == 0, "late live order")
            .when(reason == 1, "late order request credit")
            .when(reason == 2, "missing item")
            .otherwise("wrong order")
            .alias("claim_reason"),
            F.when(F.col("value") < 60, F.lit(15.0)).otherwise(F.col("value"))
            .cast("decimal(10,2)").alias("claim_amount_gbp"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("order_total_gbp"),
        )

    def order_list() -> DataFrame:
        # The imported order list: every order once, urgent orders twice (an
        # import list with repeated ids, whose effect on the sums is kept).
        o = t("orders")
        every = o.select(F.col("o_orderkey").alias("orders"))
        again = o.filter(F.col("o_orderpriority") == "1-URGENT").select(
            F.col("o_orderkey").alias("orders")
        )
        return every.unionAll(again)

    def items() -> DataFrame:
        li = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        p = t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
        name = F.col("p_name")
        alcohol = (
            (name.endswith("ring") | name.endswith("bolt")) & (F.col("p_partkey") % 3 != 0)
        ) | (name == "blue anvil")
        return li.join(p, li.l_partkey == p.p_partkey).select(
            F.col("l_orderkey").alias("order_id"),
            name.alias("mi_menu_category_name"),
            F.col("p_brand").alias("mi_name"),
            F.col("p_type").alias("mi_description"),
            alcohol.alias("mi_alcohol"),
            F.col("l_quantity").cast("decimal(6,0)").alias("oi_quantity"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("oi_unit_price"),
        )

    def adjustments() -> DataFrame:
        return t("lineitem").filter(F.col("l_returnflag") == "R").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("adjustment_cost"),
        )

    def restaurants() -> DataFrame:
        s = t("supplier").select("s_suppkey", "s_name", "s_nationkey")
        n = F.broadcast(t("nation").select("n_nationkey", "n_name"))
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            F.col("s_suppkey").alias("restaurant_id"),
            F.col("s_name").alias("restaurant_name"),
            F.col("n_name").alias("restaurant_company"),
        )

    def ledger() -> DataFrame:
        li = t("lineitem")
        ln, part = F.col("l_linenumber"), F.col("l_partkey")
        rate = (
            # Restaurants on a free trial have no usable commission line.
            F.when(F.col("l_suppkey") % 10 == 0, "Free Trial")
            .when(ln == 7, "Free Trial")
            .when(ln == 6, "Redelivery")
            .when((ln == 5) & (F.col("l_returnflag") == "N"), "0")
            .otherwise(
                F.concat(
                    (10 + part % 25).cast("string"),
                    F.lit(".50% + 0."),
                    F.lpad((part % 100).cast("string"), 2, "0"),
                )
            )
        )
        net = F.when((ln == 3) & (F.col("l_returnflag") == "A"), F.lit(None)).otherwise(
            F.col("l_extendedprice").cast("decimal(12,2)")
        )
        return li.select(
            F.col("l_suppkey").alias("restaurant_id"),
            F.col("l_shipdate").alias("created_at"),
            net.cast("decimal(12,2)").alias("restaurant_order_net"),
            rate.alias("commission_rate"),
        )

    return Sources(
        {
            "orders": orders,
            "zones": zones,
            "calls": calls,
            "chats": chats,
            "chat_event_log": chat_event_log,
            "emails": emails,
            "claims": claims,
            "items": items,
            "order_list": order_list,
            "adjustments": adjustments,
            "restaurants": restaurants,
            "ledger": ledger,
        }
    )
