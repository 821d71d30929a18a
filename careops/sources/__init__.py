"""Logical source relations and their derivation from the test tables."""

from careops.sources.catalog import Sources
from careops.sources.schemas import REQUIRED_COLUMNS, check_columns
from careops.sources.testdata import testdata_sources

__all__ = ["Sources", "REQUIRED_COLUMNS", "check_columns", "testdata_sources"]
