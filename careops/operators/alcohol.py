"""Alcohol cost of listed orders.

Items flagged as alcohol are trusted except in categories known to be
mis-flagged (true positives); unflagged items count too when their category
holds a true positive and is not on a second exclusion list (false
negatives).  The alcohol cost of an order is the sum of quantity × unit
price over both sets.

``alcohol_totals_one_scan`` gives the totals (B17) of both sets from one
scan of the items.

Scale notes: the order list only filters items, so it is applied as a
semi-join; the planner chooses its form from the sizes in bytes.  The category
set of the true positives is a distinct projection (one row per category).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careops.functions.dealing import dealt, tasks_for
from careops.functions.predicates import is_false, is_true, not_in

ITEM_COLUMNS = (
    "mi_menu_category_name", "mi_name", "mi_description", "mi_alcohol",
    "order_id", "oi_quantity", "oi_unit_price",
)


def listed_items(items: DataFrame, order_list: DataFrame) -> DataFrame:
    ids = order_list.select(F.col("orders").alias("order_id"))
    return items.join(ids, "order_id", "left_semi")


def alcohol_true_positives(
    items: DataFrame, order_list: DataFrame, excluded_categories: Sequence[str]
) -> DataFrame:
    """Distinct alcohol-flagged item lines outside the mis-flagged categories.

    Category names are compared exactly, trailing spaces included.
    """
    return (
        listed_items(items, order_list)
        .filter(is_true("mi_alcohol") & not_in("mi_menu_category_name", excluded_categories))
        .select(*ITEM_COLUMNS)
        .distinct()
    )


def alcohol_false_negatives(
    items: DataFrame,
    order_list: DataFrame,
    true_positives: DataFrame,
    excluded_categories: Sequence[str],
    excluded_prefix: str | None = None,
) -> DataFrame:
    """Distinct unflagged item lines in a category that has a true positive."""
    cats = true_positives.select("mi_menu_category_name").distinct()
    cond = is_false("mi_alcohol") & not_in("mi_menu_category_name", excluded_categories)
    if excluded_prefix is not None:
        cond = cond & ~F.col("mi_menu_category_name").startswith(excluded_prefix)
    return (
        listed_items(items, order_list)
        .filter(cond)
        .join(cats, "mi_menu_category_name", "left_semi")
        .select(*ITEM_COLUMNS)
        .distinct()
    )


def alcohol_order_totals(true_positives: DataFrame, false_negatives: DataFrame) -> DataFrame:
    """Alcohol cost per order over the union of both item sets.

    The warehouse takes a distinct UNION; the two sets are already distinct
    and disjoint (``mi_alcohol`` is True in one, False in the other), so a
    plain union is the same rows without another shuffle.
    """
    both = true_positives.select(*ITEM_COLUMNS).unionAll(false_negatives.select(*ITEM_COLUMNS))
    return both.groupBy("order_id").agg(
        F.sum(F.col("oi_quantity") * F.col("oi_unit_price")).cast("decimal(18,2)").alias("order_total")
    )


def alcohol_totals_one_scan(
    items: DataFrame,
    order_list: DataFrame,
    misflagged_categories: Sequence[str],
    not_alcohol_categories: Sequence[str],
    not_alcohol_prefix: str | None = None,
) -> DataFrame:
    """B17 from the items: what ``alcohol_order_totals`` of B15 and B16 gives, with one scan.

    Every line that can count (flagged outside the mis-flagged categories, or
    unflagged outside the second list) is read once, dealt by order into
    partitions of a bounded number of rows, made distinct there and summed by
    order and category, evidence (a true positive) apart from candidates.
    Those sums are small; the categories that have evidence come out of them
    and decide which candidates' sums count.  Both readers of the sums share
    the exchange below them.
    """
    category = F.col("mi_menu_category_name")
    evidence = is_true("mi_alcohol") & not_in("mi_menu_category_name", misflagged_categories)
    candidate = is_false("mi_alcohol") & not_in("mi_menu_category_name", not_alcohol_categories)
    if not_alcohol_prefix is not None:
        candidate = candidate & ~category.startswith(not_alcohol_prefix)
    counting = listed_items(items, order_list).filter(evidence | candidate).select(*ITEM_COLUMNS)
    lines = dealt(counting, tasks_for(items, items.count()), "order_id").distinct()
    cost = F.col("oi_quantity") * F.col("oi_unit_price")
    sums = lines.groupBy("order_id", "mi_menu_category_name").agg(
        F.sum(F.when(F.col("mi_alcohol"), cost)).alias("_flagged"),
        F.sum(F.when(~F.col("mi_alcohol"), cost)).alias("_other"),
        F.count(F.when(F.col("mi_alcohol"), 1)).alias("_evidence"),
        F.count(F.when(~F.col("mi_alcohol"), 1)).alias("_candidates"),
    )
    known = sums.filter(F.col("_evidence") > 0).select(category.alias("_category")).distinct()
    joined = sums.join(known, category == F.col("_category"), "left")
    counted = F.col("_category").isNotNull() & (F.col("_candidates") > 0)
    part = F.struct(F.col("_flagged").alias("a"), F.when(counted, F.col("_other")).alias("b"))
    return (
        joined.filter((F.col("_evidence") > 0) | counted)
        .select("order_id", part.alias("_p"))
        .groupBy("order_id")
        .agg(F.sum("_p.a").alias("_a"), F.sum("_p.b").alias("_b"))
        .select("order_id", F.when(
            F.col("_a").isNotNull() | F.col("_b").isNotNull(),
            F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).cast("decimal(18,2)").alias("order_total"))
    )
