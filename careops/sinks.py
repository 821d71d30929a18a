"""Where results go: the warehouse's TEMP and permanent ``CREATE OR REPLACE``.

A TEMP table becomes a session temp view (lazy; ``persist`` it when several
later statements read it).

A permanent table is replaced as a whole: the result is written to a folder
of its own first, and only when every row is there does the name turn to it,
in one step.  So a failed write leaves the old table readable, a result may
replace a table that it reads, and readers that have begun keep the files
they began with.  Old versions stay until ``drop_old_versions``.

* A catalog name is a view over the current version's Parquet folder
  (partition folders by date still prune); turning it is ``CREATE OR REPLACE
  VIEW``, one catalog change that may also change the schema.
* A path is renamed into place, the old one aside, by the file system that
  holds it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def temp_view(df: DataFrame, name: str) -> DataFrame:
    """``CREATE OR REPLACE TEMP TABLE name AS …`` — visible to ``spark.sql`` and ``spark.table``."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def _quoted(name: str) -> str:
    return ".".join(f"`{part.strip('`')}`" for part in name.split("."))


def _files(spark: SparkSession, path: str):
    """The file system that holds ``path``, and its path type."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, name: str) -> str:
    """The folder of a table's versions, below the warehouse."""
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/versions/{name.replace('`', '').lower()}"


def _write(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_table(
    df: DataFrame,
    target: str,
    partition_by: Sequence[str] = (),
    as_path: bool = False,
) -> None:
    """``CREATE OR REPLACE TABLE target AS …``: replace a catalog name or a Parquet path as a whole."""
    if as_path:
        _replace_path(df, target, partition_by)
        return
    spark = df.sparkSession
    version = f"{_versions(spark, target)}/v-{uuid.uuid4().hex}"
    _write(df, version, partition_by)
    if spark.catalog.tableExists(target) and spark.catalog.getTable(target).tableType not in ("VIEW", "TEMPORARY"):
        # A table made in another way: put aside under a new name, not lost.
        spark.sql(f"alter table {_quoted(target)} rename to {_quoted(f'{target}_before_{uuid.uuid4().hex[:8]}')}")
    spark.sql(f"create or replace view {_quoted(target)} as select * from parquet.`{version}`")


def _replace_path(df: DataFrame, target: str, partition_by: Sequence[str]) -> None:
    spark, target = df.sparkSession, target.rstrip("/")
    mark = uuid.uuid4().hex
    _write(df, f"{target}.new-{mark}", partition_by)
    files, path = _files(spark, target)
    old = files.exists(path(target))
    if old and not files.rename(path(target), path(f"{target}.old-{mark}")):
        raise OSError(f"cannot put {target} aside; the new version is in {target}.new-{mark}")
    if not files.rename(path(f"{target}.new-{mark}"), path(target)):
        if old:
            files.rename(path(f"{target}.old-{mark}"), path(target))
        raise OSError(f"cannot rename {target}.new-{mark} into place")


def store_by_user(df: DataFrame, name: str, buckets: int, key: str = "user_id") -> DataFrame:
    """Store a relation in buckets of ``key``, sorted by it, as a catalog table; returns the table.

    Orders and flags that are stored so are combined and joined by user
    without an exchange (``retention.return_weeks``).  Both need the same
    number of buckets.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def current_version(spark: SparkSession, name: str) -> str | None:
    """The folder that a replaced table's name points at."""
    files = spark.table(name).inputFiles()
    folder = _versions(spark, name).rsplit(":", 1)[-1]
    at = next((f.index(folder) for f in files if folder in f), None)
    return None if at is None else files[0][:at] + "/".join([folder, files[0][at + len(folder):].split("/")[1]])


def drop_old_versions(spark: SparkSession, name: str) -> int:
    """Delete the versions of a catalog name that it no longer points at; returns how many went.

    For when no reader of an old version is left.
    """
    current = current_version(spark, name)
    if current is None:  # an empty table has no files to tell its version by
        return 0
    files, path = _files(spark, _versions(spark, name))
    gone = 0
    for status in files.listStatus(path(_versions(spark, name))):
        if status.getPath().getName() != current.rsplit("/", 1)[1]:
            files.delete(status.getPath(), True)
            gone += 1
    return gone
