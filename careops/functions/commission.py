"""Commission-rate strings from the invoice ledger.

Ledger lines carry the rate as free text such as ``'25.00% + 0.50'``.  The
digits are kept, the first four are the percentage in units of 0.0001 and
the last three the fixed fee in units of 0.01.  Shorter strings make the two
fields overlap (``'2500'`` gives 0.2500 and 5.00); an empty digit string
gives NULL.  Decimal types throughout, so results match to the cent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rate strings that are not a commission.
NON_COMMISSION_RATES = ("Free Trial", "Redelivery", "0")

# The fallback when no ledger line can be matched.
DEFAULT_RATE_TEXT = "0"
DEFAULT_PERC = "0.2500"
DEFAULT_FIXED = "0.00"

PERC_TYPE = "decimal(10,4)"
FIXED_TYPE = "decimal(10,2)"


def _digits(rate: Column) -> Column:
    return F.regexp_replace(rate, r"[^0-9]", "")


def perc_com(rate: Column) -> Column:
    first4 = F.left(_digits(rate), F.lit(4))
    return (first4.try_cast("decimal(10,0)") * F.lit(0.0001).cast(PERC_TYPE)).cast(PERC_TYPE)


def fixed_com(rate: Column) -> Column:
    last3 = F.right(_digits(rate), F.lit(3))
    return (last3.try_cast("decimal(10,0)") * F.lit(0.01).cast(FIXED_TYPE)).cast(FIXED_TYPE)
