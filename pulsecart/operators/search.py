"""Document search: filters, totals, term buckets and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pulsecart.functions import has_any_token
from pulsecart.schemas import DEFAULT_SALE_DAY, PAGE_SIZES


def matching(
    documents: DataFrame,
    terms: Mapping[str, str] | None = None,
    match: Mapping[str, str] | None = None,
) -> DataFrame:
    """Documents that equal all ``terms`` and contain a token of every ``match`` text.

    Exact terms are plain equalities, so they reach the file scan.
    """
    conditions: list[Column] = [F.col(f) == v for f, v in (terms or {}).items()]
    conditions += [has_any_token(f, text) for f, text in (match or {}).items()]
    return documents.filter(reduce(Column.__and__, conditions)) if conditions else documents


def total_hits(found: DataFrame) -> DataFrame:
    """Number of hits, whatever page is shown."""
    return found.agg(F.count("*").alias("total"))


def top_terms(found: DataFrame, field: str, metric: str | None = None, size: int = 10) -> DataFrame:
    """The most frequent values of a field, with the largest ``metric`` of each.

    Exact; equal counts are ordered by value.
    """
    aggregates = [F.count("*").alias("doc_count")]
    if metric is not None:
        aggregates.append(F.max(metric).alias(f"max_{metric}"))
    buckets = found.filter(F.col(field).isNotNull()).groupBy(field).agg(*aggregates)
    return buckets.orderBy(F.desc("doc_count"), field).limit(size)


def slice_hits(found: DataFrame, order: Sequence[str | Column], start: int, size: int) -> DataFrame:
    """Hits ``start`` to ``start + size`` of a stable order; sorts no more than those rows."""
    return found.orderBy(*order).offset(start).limit(size)


def page(found: DataFrame, order: Sequence[str | Column], number: int, size: int) -> DataFrame:
    """Page ``number``, counted from 1, of one of the offered page sizes."""
    if number < 1 or size not in PAGE_SIZES:
        raise ValueError(f"page number from 1 and page size of {PAGE_SIZES} expected")
    return slice_hits(found, order, (number - 1) * size, size)


def after(found: DataFrame, order: Sequence[str], last: Sequence, size: int) -> DataFrame:
    """The hits that follow a row, given by its values of the ``order`` columns, the last of them unique.

    Instead of counting rows to skip, it asks for keys beyond the last one shown, so the first key reaches the
    file scan and prunes the files of a table that is stored in this order. Ascending; nulls come first.
    """
    if len(order) != len(last):
        raise ValueError("a value for each order column expected")
    beyond = F.lit(False)
    for name, value in reversed(list(zip(order, last))):
        column = F.col(name)
        more = column.isNotNull() if value is None else column > F.lit(value)
        beyond = more | (column.eqNullSafe(F.lit(value)) & beyond)
    if last[0] is not None:
        beyond = (F.col(order[0]) >= F.lit(last[0])) & beyond
    return found.filter(beyond).orderBy(*order).limit(size)


def sales_of(sales: DataFrame, day: str | None = None, keyword: str | None = None) -> DataFrame:
    """Sale details of a day whose product name matches the keyword, if one is given."""
    found = sales.filter(F.col("dt") == (day or DEFAULT_SALE_DAY))
    return found.filter(has_any_token("sku_name", keyword)) if keyword else found

