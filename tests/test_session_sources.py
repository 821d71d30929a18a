"""Source column checks and the checkpoint-folder rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from careops.session import ensure_checkpoint_dir
from careops.sources.catalog import Sources


def test_missing_column_fails_at_plan_time(spark):
    bad = spark.createDataFrame([(1, "x")], "order_id long, lob string")  # no created_at
    with pytest.raises(ValueError, match="created_at"):
        Sources({"emails": bad})["emails"]


def test_sources_build_once(spark):
    calls = []

    def make():
        calls.append(1)
        return spark.createDataFrame([(1, "Customer", None)], "order_id long, lob string, created_at timestamp_ntz")

    src = Sources({"emails": make})
    assert src.emails is src["emails"] and len(calls) == 1


class _Conf:
    def __init__(self, value):
        self.value, self.set_calls = value, []

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default

    def set(self, key, value):
        self.set_calls.append((key, value))


class _Context:
    def __init__(self, master, current=None):
        self.master, self.current, self.set_to = master, current, None

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.set_to = self.current = path


class _Session:
    def __init__(self, master, configured=None, current=None):
        self.sparkContext = _Context(master, current)
        self.conf = _Conf(configured)


def test_cluster_without_checkpoint_dir_refuses_local_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Session("yarn"))


def test_configured_checkpoint_dir_is_used_as_is():
    s = _Session("yarn", configured="s3a://shared/ckpt")
    assert ensure_checkpoint_dir(s) == "s3a://shared/ckpt"
    assert s.sparkContext.set_to == "s3a://shared/ckpt"


def test_local_master_gets_scratch_folder():
    s = _Session("local[2]")
    path = ensure_checkpoint_dir(s)
    assert path.startswith("/tmp/careops-ckpt-") and s.sparkContext.set_to == path


ORDERS = ("id long, user_id long, delivered_at timestamp_ntz, created_at timestamp_ntz, order_rank_user int, zone_id int, "
          "country_name string, city_name string, restaurant_id long, subtotal string, status string")


@pytest.mark.parametrize("schema,column,said", [
    ("order_id long, lob string, created_at timestamp", "created_at", "without time zone"),
    ("order_id string, lob string, created_at timestamp_ntz", "order_id", "whole number"),
    ("order_id double, lob string, created_at timestamp_ntz", "order_id", "whole number"),
    ("order_id long, lob int, created_at timestamp_ntz", "lob", "text"),
])
def test_wrong_types_are_refused(spark, schema, column, said):
    with pytest.raises(TypeError, match=f"{column} is .*{said}"):
        Sources({"emails": spark.createDataFrame([], schema)})["emails"]


def test_double_prices_are_refused_and_other_widths_taken(spark):
    items = "order_id int, mi_menu_category_name string, mi_name string, mi_description string, mi_alcohol boolean, oi_quantity {q}, oi_unit_price {p}"
    fine = spark.createDataFrame([], items.format(q="smallint", p="decimal(38,4)"))
    assert Sources({"items": fine}).items.columns == fine.columns
    with pytest.raises(TypeError, match="oi_unit_price is double, must be a decimal"):
        Sources({"items": spark.createDataFrame([], items.format(q="int", p="double"))}).items


def test_only_the_columns_that_are_read_are_checked(spark):
    """An orders table without a subtotal, and with a zoned creation time, still serves retention."""
    from careops.plans import compositions as C
    from careops.plans.params import TESTDATA

    orders = spark.createDataFrame([], ORDERS).drop("subtotal").withColumn("created_at", F.col("created_at").cast("timestamp"))
    src = Sources({"orders": orders})
    assert C.week_cohorts(src, TESTDATA).columns == ["user_id", "id", "first_delivery_date", "cohort"]
    with pytest.raises(ValueError, match="subtotal"):
        C._use(src, "orders", *C._SETTLED)
    with pytest.raises(TypeError, match="created_at"):
        src.use("orders", "created_at")
