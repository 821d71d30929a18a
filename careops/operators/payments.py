"""Restaurant payment adjustment for cancelled orders.

Scale notes: adjustments and the order list are both reduced to one row per
order before they meet (sum of costs, number of list copies), so the join
is one-to-one and a hot order is combined map-side.  The enrichment joins
are all keyed by order id and share one partitioning; the restaurant
mapping is joined in the form that the planner chooses from its size in bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careops.functions.dealing import dealt, tasks_for

# Order states whose cancellation is settled with the restaurant.
SETTLED_STATUSES = ("CANCELLED", "CONFIRMED_BY_RESTAURANT")

MONEY = "decimal(18,2)"

PAYMENT_COLUMNS = (
    "orders", "order_date", "adjustment_cost", "adjustment_flag", "restaurant_id",
    "restaurant_name", "restaurant_company", "subtotal", "alcohol_cost",
    "commission_in_ledger", "commission_calc", "pay_adj_total",
)


def order_adjustments(adjustments: DataFrame, order_list: DataFrame) -> DataFrame:
    """Sum of payment adjustments per listed order.

    An order listed k times is joined k times, so its sum counts k times;
    this is kept (sum × k), computed on one pre-aggregated row per side.
    """
    per_order = adjustments.groupBy("order_id").agg(F.sum("adjustment_cost").alias("_cost"))
    listed = order_list.groupBy("orders").agg(F.count(F.lit(1)).alias("_copies"))
    return listed.join(per_order, listed["orders"] == per_order["order_id"]).select(
        "orders", (F.col("_cost") * F.col("_copies")).cast(MONEY).alias("adjustment_cost")
    )


def settled_orders(
    order_list: DataFrame, orders: DataFrame, restaurants: DataFrame, statuses: Sequence[str] = SETTLED_STATUSES
) -> DataFrame:
    """Listed settled orders of known restaurants: ``orders, created_at, restaurant_id``, names, ``subtotal``.

    All that the commission match needs to know of an order; ``subtotal`` is
    the order's text subtotal as ``decimal(10,2)``.
    """
    sub = orders.filter(F.col("status").isin(list(statuses))).select(
        F.col("id").alias("orders"), "created_at", "restaurant_id", F.col("subtotal").cast("decimal(10,2)").alias("subtotal")
    )
    listed = order_list.select("orders")  # a semi-join: repeated ids change nothing
    names = restaurants.select("restaurant_id", "restaurant_name", "restaurant_company")
    return sub.join(listed, "orders", "left_semi").join(names, "restaurant_id")


def orders_with_alcohol(
    order_list: DataFrame,
    order_adj: DataFrame,
    orders: DataFrame,
    alcohol: DataFrame,
    restaurants: DataFrame,
    statuses: Sequence[str] = SETTLED_STATUSES,
) -> DataFrame:
    """Listed settled orders with adjustment, restaurant and alcohol cost.

    ``adjustment_flag`` is 'Y' when a (non-NULL) adjustment sum exists;
    ``alcohol_cost`` is 0 for orders without alcohol; ``subtotal`` is the
    order's text subtotal as ``decimal(10,2)``.
    """
    df = (
        settled_orders(order_list, orders, restaurants, statuses)
        .join(order_adj.select("orders", "adjustment_cost"), "orders", "left")
        .join(alcohol.select(F.col("order_id").alias("orders"), "order_total"), "orders", "left")
    )
    rows = df.select(
        "orders",
        "created_at",
        F.col("adjustment_cost").cast(MONEY).alias("adjustment_cost"),
        F.when(F.col("adjustment_cost").isNull(), "N").otherwise("Y").alias("adjustment_flag"),
        "restaurant_id",
        "restaurant_name",
        "restaurant_company",
        "subtotal",
        F.coalesce(F.col("order_total"), F.lit(0)).cast(MONEY).alias("alcohol_cost"),
    )
    # The joins share one stage; the wide rows are made distinct in another.
    return dealt(rows, tasks_for(rows, order_list.count()), "orders").distinct()


def commission_calc(subtotal: Column, alcohol: Column, perc: Column, fixed: Column) -> Column:
    """Commission owed, first matching rule wins.

    alcohol 0 -> subtotal × perc + fixed; subtotal 0 -> 0; no food left -> 0;
    otherwise (subtotal − alcohol) × perc + fixed; rounded to the cent.
    """
    zero = F.lit(0).cast(MONEY)
    return (
        F.when(alcohol == 0, F.round(subtotal * perc + fixed, 2))
        .when(subtotal == 0, zero)
        .when(subtotal - alcohol == 0, zero)
        .otherwise(F.round((subtotal - alcohol) * perc + fixed, 2))
        .cast(MONEY)
    )


def payment_adjustment(combined: DataFrame, orders_alcohol: DataFrame) -> DataFrame:
    """Commission and amount payable to the restaurant per order.

    ``pay_adj_total`` = subtotal − alcohol − commission (0 when the subtotal
    is 0); it can be negative.
    """
    c = combined.select(
        F.col("orders").alias("_o"), "commission_rate", "perc_com", "fixed_com"
    )
    df = c.join(orders_alcohol, c["_o"] == orders_alcohol["orders"])
    sub, alc = F.col("subtotal"), F.col("alcohol_cost")
    calc = commission_calc(sub, alc, F.col("perc_com"), F.col("fixed_com"))
    df = df.select(
        "orders",
        F.to_date("created_at").alias("order_date"),
        "adjustment_cost",
        "adjustment_flag",
        "restaurant_id",
        "restaurant_name",
        "restaurant_company",
        "subtotal",
        "alcohol_cost",
        F.col("commission_rate").alias("commission_in_ledger"),
        calc.alias("commission_calc"),
    )
    pay = F.when(sub == 0, F.lit(0).cast(MONEY)).otherwise(sub - alc - F.col("commission_calc"))
    return df.withColumn("pay_adj_total", pay.cast(MONEY)).select(*PAYMENT_COLUMNS)
