"""``Sources``: a name -> DataFrame mapping handed to every operator."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from careops.sources.schemas import check_columns


class Sources:
    """Lazily built relations, checked for the columns that are read and their types.

    ``src.orders`` / ``src["orders"]`` is the whole relation, all columns
    checked; ``src.use("orders", "id", ...)`` checks and reads only the named
    ones, so a table that lacks columns of other analyses still serves.

    Each entry is a DataFrame or a zero-argument factory returning one; the
    factory runs once, on first use, and only builds a logical plan (no job).
    """

    def __init__(self, relations: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._factories = dict(relations)
        self._built: dict[str, DataFrame] = {}

    def _raw(self, name: str) -> DataFrame:
        if name not in self._built:
            item = self._factories[name]
            self._built[name] = item() if callable(item) else item
        return self._built[name]

    def __getitem__(self, name: str) -> DataFrame:
        return check_columns(name, self._raw(name))

    def use(self, name: str, *columns: str) -> DataFrame:
        """The named columns of a relation, checked."""
        return check_columns(name, self._raw(name), columns).select(*columns)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as exc:
            raise AttributeError(name) from exc

    @classmethod
    def from_tables(cls, spark: SparkSession, names: Mapping[str, str]) -> "Sources":
        """Relations read from catalog tables, e.g. ``{"orders": "prod.orders"}``."""
        return cls({k: (lambda t=t: spark.table(t)) for k, t in names.items()})

    @classmethod
    def from_parquet(cls, spark: SparkSession, paths: Mapping[str, str]) -> "Sources":
        """Relations read from Parquet paths (filters/columns pushed into the scan)."""
        return cls({k: (lambda p=p: spark.read.parquet(p)) for k, p in paths.items()})
