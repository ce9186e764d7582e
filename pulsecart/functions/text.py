"""Texts: keys, prices, and the token match of the document search."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: what one search token is. Han characters stand alone; other letters and digits
# run together.
TOKEN_PATTERN = r"(\p{IsHan}|[\p{L}\p{N}_&&[^\p{IsHan}]]+)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-case search tokens of a text."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_PATTERN), F.lit(1))


def has_any_token(text: Column | str, wanted: str) -> Column:
    """Full-text match: at least one token of ``wanted`` is a token of ``text``.

    A wanted text without any token matches nothing.
    """
    return F.coalesce(F.arrays_overlap(tokens(text), tokens(F.lit(wanted))), F.lit(False))


def equals_text(value: Column | str, text: str) -> Column:
    """Equality that is false, not null, for a missing value."""
    return F.coalesce(_col(value) == F.lit(text), F.lit(False))


def price(text: Column | str) -> Column:
    """A price text as a number; null when it is missing or not a number."""
    return _col(text).try_cast("double")


def bucket_id(key: Column | str, epoch_ms: Column | str, bucket_seconds: int) -> Column:
    """``<key>_<number of the time bucket since the epoch>``; the bucket is a minute by default."""
    number = F.floor(_col(epoch_ms) / F.lit(1000 * bucket_seconds))
    return F.concat_ws("_", _col(key), number.cast("string"))
