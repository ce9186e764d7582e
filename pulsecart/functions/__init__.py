"""Column functions: everything here is built from Spark's own expressions."""

from pulsecart.functions.people import age_band, age_years, gender_label
from pulsecart.functions.records import after_image_json, parse_records, split_corrupt
from pulsecart.functions.text import (
    bucket_id,
    equals_text,
    has_any_token,
    price,
    tokens,
)
from pulsecart.functions.times import (
    create_parts,
    day_before,
    day_text,
    hour_spine,
    hour_text,
    seconds_in,
    time_of,
    within_days,
)

__all__ = [
    "after_image_json", "age_band", "age_years", "bucket_id", "create_parts", "day_before",
    "day_text", "equals_text", "gender_label", "has_any_token", "hour_spine", "hour_text",
    "parse_records", "price", "seconds_in", "split_corrupt", "time_of", "tokens", "within_days",
]
