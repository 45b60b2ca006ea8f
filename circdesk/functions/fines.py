"""The two fine policies as columns. They disagree on purpose and are never merged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from circdesk.functions.dates import days_between
from circdesk.model import vocab as V

MONEY = "decimal(18,2)"


def late_days(due: Column, returned: Column, as_of: Column) -> Column:
    """Days past due, up to the return or up to ``as_of``; 0 when not late."""
    end = F.coalesce(returned, as_of)
    return F.when(due < end, days_between(due, end)).otherwise(F.lit(0))


def replacement_fine(
    due: Column, returned: Column, price: Column, condition: Column, as_of: Column
) -> Column:
    """20,000 a day late; damaged adds the full price; lost is the price alone."""
    value = F.coalesce(price, F.lit(0).cast("decimal(10,2)"))
    late = (late_days(due, returned, as_of) * V.REPLACEMENT_DAILY).cast(MONEY)
    return (
        F.when(condition.isin(*V.LOST), value)
        .when(condition.isin(*V.DAMAGED), value + late)
        .otherwise(late)
        .cast(MONEY)
    )


def additive_fine(
    due: Column,
    returned: Column,
    price: Column,
    loan_status: Column,
    condition: Column,
    as_of: Column,
) -> Column:
    """5,000 a day for lines marked late (early returns go negative), plus 30 % or 100 % of the price."""
    nothing = F.lit(0).cast(MONEY)
    days = days_between(due, F.coalesce(returned, as_of))
    late = F.when(loan_status == V.TRE_HAN, (days * V.ADDITIVE_DAILY).cast(MONEY)).otherwise(nothing)
    share = F.lit(V.ADDITIVE_DAMAGE_SHARE).cast("decimal(2,1)")
    damage = (
        F.when(condition == V.HONG, price * share).when(condition == V.MAT, price).otherwise(nothing)
    )
    return (late + damage).cast(MONEY)


def whole_number(amount: Column) -> Column:
    """Thousands-separated text without decimals, half rounded away from zero."""
    return F.format_number(F.round(amount, 0), 0)
