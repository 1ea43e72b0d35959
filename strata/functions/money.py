"""Exact sums of amounts held as doubles.

Amounts are taken as whole units of their last digit (cents and the like), so sums do not depend on
row order, and the aggregate works on plain integers, which stay in hash aggregation and cost a
fraction of wide decimals.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = 1_000_000_000


def units(amount, scale: int) -> Column:
    """Amount as an integer count of 10**-scale; exact up to 2**53 units."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return F.rint(amount * 10**scale).cast("bigint")


def exact_sum(amount, scale: int) -> Column:
    """Sum as decimal(38, scale). High and low parts are summed apart, so no total overflows a long."""
    whole = units(amount, scale)
    high = F.sum(F.call_function("div", whole, F.lit(_STEP))).cast("decimal(19,0)")
    low = F.sum(whole % _STEP).cast("decimal(19,0)")
    return ((high * F.lit(Decimal(_STEP)) + low) * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(38,{scale})")
