"""Fill-in-middle transformation with a learned index from token ranks to character offsets.

A text of n tokens has n + 1 boundaries. A cut names a boundary by its rank; its place in characters
comes from an index of the text instead of from cutting the text to tokens once more:

1. Fit. The offsets of all boundaries, as a function of their rank, are covered from left to right by
   the longest line segments that leave no offset further than ``ERROR`` from its line (a cone of
   slopes that narrows with every boundary).
2. Residuals. The rest of every offset is stored in one byte, which the error bound makes enough.
3. Cut. The segment of a rank gives a prediction, and the stored residual corrects it exactly.

``index`` makes the index of every text, in Arrow batches; ``offset_of`` looks a rank up and
``transform`` cuts and rearranges, both in SQL functions, so an index can be stored with the texts and
serve any number of cuts (other seeds, rates or epochs) without reading tokens again.

A token is a run of characters other than white space with the white space before it; white space at
the end of a text is a token of its own. White space is U+0020 and U+0009 to U+000D.

Edge cases: null and empty texts have no tokens and stay as they are (``plain``), as do texts that
hold a mark and rows without an id. Texts of any length are worked on whole; a segment ends where a
very long token breaks the line. Repeated rows get the same cuts; an empty table gives an empty one.
Other columns pass through ``index`` and ``transform``; a column with the name of an output column is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsecart.llm.common import small_batches

ERROR = 100  # of an offset from its line, in characters; a residual takes a byte up to 127
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_STEP = 512
_INDEX = "n bigint, starts array<int>, offsets array<int>, slopes array<double>, residuals binary"


def boundaries(text: str) -> np.ndarray:
    """Offsets of the boundaries of a text, from 0 to its length."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(code):
        return np.zeros(1, dtype=np.int64)
    solid = ~((code == 0x20) | ((code >= 0x09) & (code <= 0x0D)))
    ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    return np.concatenate([[0], ends, [len(code)]])


def fit(offsets: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First ranks and slopes of the segments, and the residuals of all offsets."""
    starts, slopes, at, n = [], [], 0, len(offsets)
    while at < n:
        low, high, end, step, slope = -np.inf, np.inf, at + 1, _STEP, 0.0
        while end < n:
            part = offsets[end : end + step] - offsets[at]
            ranks = np.arange(end - at, end - at + len(part))
            lows = np.maximum(low, np.maximum.accumulate((part - error) / ranks))
            highs = np.minimum(high, np.minimum.accumulate((part + error) / ranks))
            fits = int(np.searchsorted(lows > highs, True))  # once crossed, the cone stays so
            if fits:
                low, high = lows[fits - 1], highs[fits - 1]
                slope = (low + high) / 2
                end += fits
            if fits < len(part):
                break
            step *= 2
        starts.append(at)
        slopes.append(slope)
        at = end
    starts, slopes = np.array(starts), np.array(slopes)
    segment = np.searchsorted(starts, np.arange(n), side="right") - 1
    guess = offsets[starts[segment]] + np.floor(slopes[segment] * (np.arange(n) - starts[segment])).astype(np.int64)
    return starts, slopes, offsets - guess


def index(documents: DataFrame, text: str = "text", out: str = "rank_index", error: int = ERROR) -> DataFrame:
    """Append the index of every text: n (tokens), and per segment its first rank, offset and slope, and a byte for
    the residual of each boundary (128 stands for none)."""
    if not 1 <= error <= 126:
        raise ValueError("a residual has one byte: the error must be 1 to 126")
    small_batches(documents.sparkSession)

    @F.pandas_udf(_INDEX)
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                at = boundaries(t or "")
                starts, slopes, residuals = fit(at, error)
                rows.append((len(at) - 1, starts, at[starts], slopes, (residuals + 128).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["n", "starts", "offsets", "slopes", "residuals"])

    return documents.withColumn(out, made(F.col(text)))


def offset_of(found: Column, rank: Column) -> Column:
    """Offset of a boundary by its rank: the line of its segment, put right by its residual."""
    segment = (F.size(F.filter(found["starts"], lambda s: s <= rank)) - 1).cast("int")
    ahead = rank - F.get(found["starts"], segment)
    guess = F.get(found["offsets"], segment) + F.floor(F.get(found["slopes"], segment) * ahead)
    stored = F.conv(F.hex(F.substring(found["residuals"], (rank + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (guess + stored - 128).cast("int")


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the seed and a decimal key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(
    documents: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80,
    found: str = "rank_index", out: str = "fim",
) -> DataFrame:
    """Append a struct: form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    ``percent`` of the texts are cut, ``spm_percent`` of those have the suffix first. Needs the column that
    :func:`index` appends.
    """
    whole, own = F.coalesce(F.col(text), F.lit("")), F.col(found)
    a, b, c, d = draws(F.col(key), seed)
    n = own["n"]
    first, second = offset_of(own, F.least(a % (n + 1), b % (n + 1))), offset_of(own, F.greatest(a % (n + 1), b % (n + 1)))
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    plain = F.col(key).isNull() | (whole == "") | marked | (c % 100 >= percent)
    form = F.when(plain, "plain").when(d % 100 < spm_percent, "spm").otherwise("psm")
    cut = documents.withColumn(
        out, F.struct(form.alias("form"), F.when(~plain, first).alias("first"), F.when(~plain, second).alias("second"))
    )
    form, first, second = (F.col(out)[x] for x in ("form", "first", "second"))
    prefix = F.substring(whole, F.lit(1), first)
    middle, suffix = F.substring(whole, first + 1, second - first), F.substring(whole, second + 1, F.length(whole))
    output = (
        F.when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(whole)
    )
    return cut.withColumn(
        out,
        F.struct(
            form.alias("form"), first.cast("bigint").alias("prefix_chars"),
            (second - first).cast("bigint").alias("middle_chars"), output.alias("output"),
        ),
    )


def restored(output: Column, form: Column) -> Column:
    """The text again from an output and its form. No part holds a mark, and no mark overlaps another, so the first
    place of each mark is its own."""

    def between(opened: str, closed: str) -> Column:
        start = F.instr(output, opened) + len(opened)
        return F.substring(output, start, F.instr(output, closed) - start)

    middle = F.substring(output, F.instr(output, MIDDLE) + len(MIDDLE), F.length(output))
    tail = F.when(form == "psm", between(SUFFIX, MIDDLE)).otherwise(between(SUFFIX, PREFIX))
    head = F.when(form == "psm", between(PREFIX, SUFFIX)).otherwise(between(PREFIX, MIDDLE))
    return F.when(form == "plain", output).otherwise(F.concat(head, middle, tail))
