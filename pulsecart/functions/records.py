"""JSON records: text to typed columns and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_BROKEN = "_corrupt"


def parse_records(df: DataFrame, schema: str | T.StructType, value: str = "value") -> DataFrame:
    """Parse a JSON text column into the fields of ``schema``; other columns are kept.

    Unknown keys are ignored. A missing text field is null and a missing number is 0. Numbers may
    arrive as JSON numbers or as texts, as change records carry all values as text. A value that
    is not a JSON object, or has text where a number belongs, keeps its source in ``_corrupt``.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    as_text = T.StructType(
        [T.StructField(f.name, T.StringType()) for f in fields]
        + [T.StructField(_BROKEN, T.StringType())]
    )
    rest = [c for c in df.columns if c != value]
    record = F.from_json(value, as_text, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    # As a generated column the record is parsed once; a plain one would be parsed again for
    # every filter that is pushed below it.
    parsed = df.select(*rest, F.col(value), F.explode(F.array(record)).alias("_r"))
    columns, bad = [], F.col("_r").isNull() | F.col(f"_r.{_BROKEN}").isNotNull()
    for f in fields:
        text = F.col(f"_r.`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            columns.append(text.alias(f.name))
        else:
            typed = text.try_cast(f.dataType)
            bad = bad | (text.isNotNull() & typed.isNull())
            columns.append(F.coalesce(typed, F.lit(0).cast(f.dataType)).alias(f.name))
    source = F.coalesce(F.col(value), F.lit(""))
    return parsed.select(*rest, *columns, F.when(bad, source).alias(_BROKEN))


def split_corrupt(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without the marker column, and the broken source texts."""
    good = parsed.filter(F.col(_BROKEN).isNull()).drop(_BROKEN)
    return good, parsed.filter(F.col(_BROKEN).isNotNull()).select(_BROKEN)


def after_image_json(columns: Column | str) -> Column:
    """After-image columns (``array<struct<name, value>>``) as one JSON object of texts.

    A name that occurs twice keeps its last value; a null value becomes an empty text.
    """
    cells = F.col(columns) if isinstance(columns, str) else columns
    names = F.transform(cells, lambda c: c["name"])
    last_only = F.filter(
        cells,
        lambda c, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), c["name"]),
    )
    unique = F.size(F.array_distinct(names)) == F.size(names)
    last = F.when(unique, cells).otherwise(last_only)
    filled = F.transform(
        last,
        lambda c: F.struct(c["name"].alias("key"), F.coalesce(c["value"], F.lit("")).alias("value")),
    )
    return F.to_json(F.map_from_entries(filled))
