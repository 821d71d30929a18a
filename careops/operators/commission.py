"""Commission of an order from the restaurant's invoice ledger.

A cancelled order's commission is read from the ledger line of the same
restaurant whose net amount is nearest the order subtotal, trying in turn:
tier 1 lines on the order date, tier 2 lines within one week either side,
tier 3 lines on any date; tier 4 is a default of 25 % + 0.00.  Lines whose
rate text is not a commission ('Free Trial', 'Redelivery', '0', NULL) are
ignored.  Among equally near lines the smallest rate text wins; lines with
a NULL net amount are used only when no line with an amount exists.

All tiers come out of one sort of ledger points and asks, without pairing
orders with ledger lines:

* *Blocks.*  Days are cut into short blocks, each day with a place of its
  own in its block.  The 15 days that an order can reach lie in three or four
  blocks, so it asks in those, not on 15 days.
* *Points.*  The ledger is read once, cut to the listed restaurants before it
  is shuffled (a broadcast or, for a long list, Spark's runtime Bloom filter
  in front of the scan), and combined to one row, with the smallest rate, for
  each (restaurant, block, place, net); for lines of any date these rows are
  combined again to (restaurant, net).
* *Asks* are combined as well: orders with the same restaurant, date and
  subtotal ask once.
* *Sort.*  Points and asks of a (restaurant, block) are sorted by amount, and
  running windows keep, for each place, the last point below and the next one
  above; an ask reads off its own day's place (tier 1) and all places that it
  reaches (tier 2).  Tier 3 is the same sweep with one place for all dates.  A
  sorted group holds at most one row for each place and different amount,
  however many lines and orders a busy restaurant has.

Only the listed orders are written; everything else is one lazy plan.

``commission_tier(k)`` exposes one tier as the warehouse's per-tier table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careops.functions import dealing
from careops.functions.commission import (
    DEFAULT_FIXED,
    DEFAULT_PERC,
    DEFAULT_RATE_TEXT,
    FIXED_TYPE,
    NON_COMMISSION_RATES,
    PERC_TYPE,
    fixed_com,
    perc_com,
)
from careops.functions.dealing import dealt, tasks_for
from careops.functions.materialize import written
from careops.functions.predicates import not_in

WEEK_DAYS = 7
# Days of a block: longer blocks mean fewer asks of an order and more windows for every row.
BLOCK_DAYS = 5
EPOCH = "1970-01-01"
_POINT, _ASK = 0, 1
_ASK_KEY = ("restaurant_id", "block", "day", "subtotal")


def usable_ledger(ledger: DataFrame) -> DataFrame:
    return ledger.filter(not_in("commission_rate", NON_COMMISSION_RATES)).select(
        "restaurant_id",
        F.to_date("created_at").alias("day"),
        F.col("restaurant_order_net").alias("net"),
        "commission_rate",
    )


def _day_number(day: Column) -> Column:
    return F.datediff(day, F.lit(EPOCH).cast("date"))


def ledger_points(lines: DataFrame, span: int, tasks: int | None = None) -> DataFrame:
    """``restaurant_id, block, place, net, rate``: the smallest rate by place in a block of ``span`` days and amount.

    Lines without a date are at a NULL block and place.
    """
    number = _day_number(F.col("day"))
    keys = ["restaurant_id", "block", "place", "net"]
    placed = lines.select(
        "restaurant_id",
        F.floor(number / span).cast("int").alias("block"),
        F.pmod(number, F.lit(span)).cast("int").alias("place"),
        "net",
        "commission_rate",
    )
    return dealt(placed, tasks, *keys).groupBy(*keys).agg(F.min("commission_rate").alias("rate"))


def order_asks(orders: DataFrame, span: int, reach: int, tasks: int | None = None) -> DataFrame:
    """``restaurant_id, block, day, subtotal, low, high, own``: each different ask in each block that it reaches.

    ``low``..``high`` are the places of the block within ``reach`` days of
    the date, ``own`` the date's own place where it lies in the block, else
    NULL.  Orders without a date ask nothing here.
    """
    number = _day_number(F.col("day"))
    start = F.col("block") * span
    own = number - start
    blocks = F.sequence(F.floor((number - reach) / span).cast("int"), F.floor((number + reach) / span).cast("int"))
    asked = orders.filter(F.col("restaurant_id").isNotNull() & F.col("day").isNotNull()).select(
        "restaurant_id", "day", "subtotal")
    different = dealt(asked, tasks, "restaurant_id", "day", "subtotal").distinct()
    return different.withColumn("block", F.explode(blocks)).select(
        "restaurant_id", "block", "day", "subtotal",
        F.greatest(number - reach - start, F.lit(0)).alias("low"),
        F.least(number + reach - start, F.lit(span - 1)).alias("high"),
        F.when((own >= 0) & (own < span), own).alias("own"),
    )


def _nearer(s: Column, hit: str) -> Column:
    """``(diff, rate)`` of a neighbour column; NULL where there is none or the ask has no amount."""
    c = F.col(hit)
    return F.when(c.isNotNull() & s.isNotNull(), F.struct(F.abs(c["net"] - s).alias("diff"), c["rate"].alias("rate")))


def answers(points: DataFrame, asks: DataFrame, span: int, tasks: int | None = None) -> DataFrame:
    """Each ask with the rates of its own day and of all places that it reaches; the asks are all different.

    ``own_near``, ``near``: ``(diff, rate)`` of the nearest point with an
    amount, NULL if there is none; ``own_any``, ``any``: the smallest rate of
    any point, NULL if there is no point at all.
    """
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    net, money = dict(points.dtypes)["net"], dict(asks.dtypes)["subtotal"]
    p = points.select(
        "restaurant_id", "block", F.lit(_POINT).alias("kind"), F.col("net").alias("x"), "place", "rate",
        null("day", "date"), null("subtotal", money), null("low", "int"), null("high", "int"), null("own", "int"),
    )
    q = asks.select(
        "restaurant_id", "block", F.lit(_ASK).alias("kind"), F.col("subtotal").cast(net).alias("x"), null("place", "int"),
        null("rate", "string"), "day", "subtotal", "low", "high", "own",
    )
    group = Window.partitionBy("restaurant_id", "block")
    below = group.orderBy(F.col("x").asc_nulls_first(), F.col("kind").asc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    above = group.orderBy(F.col("x").desc_nulls_last(), F.col("kind").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    places = range(span)
    here = lambda j: (F.col("kind") == _POINT) & (F.col("place") == j)
    point = lambda j: F.when(
        here(j) & F.col("x").isNotNull(), F.struct(F.col("x").alias("net"), F.col("rate").alias("rate")))
    swept = dealt(p.unionByName(q), tasks, "restaurant_id", "block").select(
        "*",
        *[F.last(point(j), ignorenulls=True).over(below).alias(f"prev{j}") for j in places],
        *[F.last(point(j), ignorenulls=True).over(above).alias(f"next{j}") for j in places],
        *[F.min(F.when(here(j), F.col("rate"))).over(group).alias(f"any{j}") for j in places],
    ).filter(F.col("kind") == _ASK)
    # Structs compare field by field: the smallest (diff, rate) is the match.
    near = F.array(*[F.least(_nearer(F.col("x"), f"prev{j}"), _nearer(F.col("x"), f"next{j}")) for j in places])
    found = F.array(*[F.col(f"any{j}") for j in places])
    reached = lambda values: F.array_min(F.slice(values, F.col("low") + 1, F.col("high") - F.col("low") + 1))
    own = lambda values: F.when(F.col("own").isNotNull(), F.get(values, F.col("own")))
    return swept.select(*_ASK_KEY, own(near).alias("own_near"), own(found).alias("own_any"),
                        reached(near).alias("near"), reached(found).alias("any"))


def _told(orders: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``orders`` with what was found for their key, NULL where nothing was (NULL amounts are a key like any other)."""
    renamed = found.select(*[F.col(c).alias(f"k_{c}") for c in keys], *[c for c in found.columns if c not in keys])
    same = F.col(keys[0]) == F.col(f"k_{keys[0]}")
    for c in keys[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    return orders.join(renamed, same, "left").drop(*[f"k_{c}" for c in keys])


def commission_match(
    orders_alcohol: DataFrame, ledger: DataFrame, tiers: Sequence[int] = (1, 2, 3, 4), materialize: bool = True
) -> DataFrame:
    """``orders, commission_rate, commission_rank`` (rank '1'..'4') per order.

    Only orders settled at one of ``tiers`` are returned; tiers not asked for
    skip what only they need.  ``materialize`` writes the listed orders,
    which are read several times; a caller whose ``orders_alcohol`` is stored
    already passes False.
    """
    tiers = set(tiers)
    lines = usable_ledger(ledger)
    orders = orders_alcohol.select(
        "orders", "restaurant_id", F.to_date("created_at").alias("day"), F.col("subtotal"), F.lit(1).alias("listed")
    ).distinct()
    if tiers == {4}:  # no usable line at all for the restaurant: nothing to match
        return _unmatched(orders, lines.select("restaurant_id").distinct())
    if materialize:
        orders = written(orders)
    reach = 0 if tiers == {1} else WEEK_DAYS
    span = min(BLOCK_DAYS, 2 * reach + 1)
    # Row counts of stored relations are read from their footers.
    n_lines, n_orders = ledger.count(), (orders if materialize else orders_alcohol).count()
    point_tasks, ask_tasks = tasks_for(orders, n_lines), tasks_for(orders, n_orders)

    # Lines of other restaurants never reach a shuffle: a short list is broadcast; in front of a join with a long
    # one Spark puts a Bloom filter of it (it wants a comparison on the list: ``listed``, which always holds).
    # A list too long for one task is hashed, so that no task sorts the lines that adaptive execution gives it.
    listed = orders.filter(F.col("listed") >= 1).select("restaurant_id")
    if n_orders > dealing.ROWS_PER_TASK:
        listed = listed.hint("shuffle_hash")
    points = ledger_points(lines.join(listed, "restaurant_id", "left_semi"), span, point_tasks)
    blocks = 2 * reach // span + 2  # that an ask lies in, at most
    week = answers(points, order_asks(orders, span, reach, ask_tasks), span, tasks_for(orders, n_lines + blocks * n_orders))
    week = dealt(week, tasks_for(orders, blocks * n_orders), "restaurant_id", "subtotal", "day").groupBy(
        "restaurant_id", "day", "subtotal").agg(
        F.min("own_near").alias("near1"), F.min("own_any").alias("any1"),
        F.min("near").alias("near2"), F.min("any").alias("any2"))
    told = _told(orders, week, ["restaurant_id", "day", "subtotal"])
    none = F.lit(None)
    if tiers & {3, 4}:
        # The same points without their dates: the ledger's exchange is used again.
        undated = points.groupBy("restaurant_id", "net").agg(F.min("rate").alias("rate")).select(
            "restaurant_id", F.lit(0).alias("block"), F.lit(0).alias("place"), "net", "rate")
        asked = orders.filter(F.col("restaurant_id").isNotNull()).select("restaurant_id", "subtotal")
        asks = dealt(asked, ask_tasks, "restaurant_id", "subtotal").distinct().select(
            "restaurant_id", F.lit(0).alias("block"), none.cast("date").alias("day"), "subtotal", F.lit(0).alias("low"),
            F.lit(0).alias("high"), none.cast("int").alias("own"))
        ever = answers(undated, asks, 1, tasks_for(orders, n_lines + n_orders)).select(
            "restaurant_id", "subtotal", F.col("near").alias("near3"), F.col("any").alias("any3"))
        told = _told(told, ever, ["restaurant_id", "subtotal"])
    else:
        told = told.withColumn("near3", none.cast(told.schema["near2"].dataType)).withColumn("any3", none.cast("string"))
    # Not sorted for a partial aggregate in the stage of the joins.
    best = dealt(told, ask_tasks, "orders").groupBy("orders").agg(*[F.min(f"{c}{k}").alias(f"{c}{k}") for k in (1, 2, 3) for c in ("near", "any")])
    rank, rate = F.lit("4"), F.lit(DEFAULT_RATE_TEXT)
    for k in (3, 2, 1):  # a lower tier wins wherever it has a line
        rank = F.when(F.col(f"any{k}").isNotNull(), F.lit(str(k))).otherwise(rank)
        rate = F.when(F.col(f"any{k}").isNotNull(), F.coalesce(F.col(f"near{k}")["rate"], F.col(f"any{k}"))).otherwise(rate)
    matched = best.select("orders", rate.alias("commission_rate"), rank.alias("commission_rank"))
    return matched.filter(F.col("commission_rank").isin([str(t) for t in sorted(tiers)]))


def _unmatched(orders: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Tier 4: the orders of restaurants that are not among ``restaurants``."""
    return orders.join(restaurants, "restaurant_id", "left_anti").select("orders").distinct().select(
        "orders", F.lit(DEFAULT_RATE_TEXT).alias("commission_rate"), F.lit("4").alias("commission_rank")
    )


def with_rates(match: DataFrame) -> DataFrame:
    """Add ``perc_com`` / ``fixed_com``: parsed from the rate, or the default."""
    default = F.col("commission_rank") == "4"
    return match.select(
        "orders",
        "commission_rate",
        F.when(default, F.lit(DEFAULT_PERC).cast(PERC_TYPE)).otherwise(perc_com(F.col("commission_rate"))).alias("perc_com"),
        F.when(default, F.lit(DEFAULT_FIXED).cast(FIXED_TYPE)).otherwise(fixed_com(F.col("commission_rate"))).alias("fixed_com"),
        "commission_rank",
    )


def commission_combined(orders_alcohol: DataFrame, ledger: DataFrame, materialize: bool = True) -> DataFrame:
    """One commission row per order with its tier (B20–B23 together)."""
    return with_rates(commission_match(orders_alcohol, ledger, materialize=materialize))


def commission_tier(orders_alcohol: DataFrame, ledger: DataFrame, tier: int) -> DataFrame:
    """B20 (tier 1), B21 (2), B22 (3), B23 (4): the orders settled at one tier.

    Computes only what that tier needs (tier 4 is a plain anti-join).
    """
    return with_rates(commission_match(orders_alcohol, ledger, tiers=(tier,)))
