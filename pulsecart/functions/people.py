"""User attributes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from pulsecart.schemas import AGE_BANDS, GENDER_LABELS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_years(birthday: Column | str, as_of: Column | str) -> Column:
    """Whole 365-day years from ``birthday`` to ``as_of``; a year is never 366 days here.

    Null when the birthday is missing or not a date. A plain string ``as_of`` is a literal date.
    """
    day = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    days = F.datediff(day, _col(birthday).try_cast("date"))
    return F.try_divide(days - days % 365, F.lit(365)).cast("int")


def age_band(age: Column | str) -> Column:
    """Under 20, 20 up to 30, 30 and over."""
    under_20, under_30, over_30 = AGE_BANDS
    a = _col(age)
    return F.when(a < 20, under_20).when(a < 30, under_30).when(a >= 30, over_30)


def gender_label(gender: Column | str) -> Column:
    """Display label of a gender code; unknown codes stay as they are."""
    labels = F.create_map(*[F.lit(x) for x in chain(*GENDER_LABELS.items())])
    return F.coalesce(F.try_element_at(labels, _col(gender)), _col(gender))
