"""Byte-level BPE encoding and decoding with the tokenizers library.

The vocabulary comes as ranks of byte strings. Every byte is written as one printable character, so
the library's BPE model, which merges characters, merges bytes. Merges follow from the ranks: the
last merge of a token joins the two parts that the lower ranks leave. Decoding reverses the byte
table, so the bytes of a character that lies in several tokens come together again.

Texts are cut where the pattern always ends a match: before a single space or line break between
two other characters, and between a letter and a following stop or comma. Each part then
gives the same ids alone as within its text; parts repeat, and their ids are remembered in a bounded
table. ``tests/llm/test_bpe.py`` holds this against the undivided text.

Edge cases: null is encoded like the empty text, to no ids. Special tokens' strings are ordinary
text. Ids outside the vocabulary decode to nothing. Lone surrogates cannot occur in Spark strings.
Other columns pass through untouched. ``ids`` are packed as little-endian unsigned 32-bit numbers;
``unpack`` turns a packed value into an array.
"""

from __future__ import annotations

import base64
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsecart.llm.common import small_batches

# Fixed value: the bytes that stand for themselves as characters in byte-level BPE vocabularies.
_PLAIN = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
# Texts with this, or with white space other than single spaces and line breaks between words, are
# cut by the pattern below; all others by plain splitting, which is faster.
_UNEVEN = re.compile(rf"(?<![{_LETTER}])[,.]|\0")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_WORD = re.compile(rf" ?[{_LETTER}]+")
_PARTS = 500_000
_LONGEST_PART = 64


def byte_characters() -> list[str]:
    """The character of each byte; bytes that are no plain characters follow from U+0100."""
    plain = {b for r in _PLAIN for b in r}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts left when only merges of lower rank than the token's are made."""
    parts, top = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], top), i) for i in range(len(parts) - 1))
        if rank >= top:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def _little(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Codec:
    """Encoder and decoder for one vocabulary file and pattern."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use all cores
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_characters()

        def shown(token: bytes) -> str:
            return "".join(chars[b] for b in token)

        merges = []
        for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
            if (pair := _last_merge(token, ranks)) is not None:
                merges.append((shown(pair[0]), shown(pair[1])))
        model = models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(Regex(pattern), "isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        # A part of letters only is one match of the pattern, so it needs no splitting.
        self.words = Tokenizer(model)
        self.shown = dict(enumerate(chars))
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _parts(text: str) -> list[str]:
        """Parts of a text. A leading mark U+0000 stands for the start of the text; a part without
        it that starts with a line break, stop or comma is whole, any other follows a space."""
        even = len(text.split()) == text.count(" ") + text.count("\n") + 1
        if not even or _UNEVEN.search(text):
            return [f"\0{p}" for p in _CUT.split(text)]
        first, *rest = text.replace("\n", " \n").replace(",", " ,").replace(".", " .").split(" ")
        return [f"\0{first}", *rest]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        known = self.known
        if len(known) >= _PARTS:
            known.clear()
        cut = [self._parts(t) if t else [] for t in texts]
        new = list({p for parts in cut for p in parts if p not in known})
        plain = [p[1:] if p[:1] == "\0" else p if p[:1] in ("\n", ",", ".") else f" {p}" for p in new]
        words = [_WORD.fullmatch(p) is not None for p in plain]
        shown = [p.encode().decode("latin-1").translate(self.shown) for p, w in zip(plain, words) if w]
        one = iter(self.words.encode_batch_fast(shown, add_special_tokens=False))
        any_ = [p for p, w in zip(plain, words) if not w]
        other = iter(self.tokenizer.encode_batch_fast(any_, add_special_tokens=False))
        for part, word in zip(new, words):
            known[part] = _little(next(one if word else other).ids)
        out = [b"".join([known[p] for p in parts]) for parts in cut]
        for part in new:
            if len(part) > _LONGEST_PART:
                del known[part]
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes | None) -> bytes:
        """The bytes of the ids, whether or not they end a character."""
        if not packed:
            return b""
        table, n = self.table, len(self.table)
        return b"".join([table[i] for i in np.frombuffer(packed, dtype="<u4").tolist() if i < n])

    def offsets(self, text: str | None, packed: bytes) -> np.ndarray:
        """Rows of start and end, in characters, of each id; a token inside a character gets that
        character."""
        if not text or not packed:
            return np.zeros((0, 2), dtype=np.int64)
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        sizes = np.array([len(self.table[i]) for i in np.frombuffer(packed, dtype="<u4").tolist()])
        ends = np.cumsum(sizes)
        return np.stack([char[ends - sizes], char[ends - 1] + 1], axis=1)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(documents: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Append the packed ids of a text column."""
    small_batches(documents.sparkSession)

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for texts in batches:
            yield pd.Series(own.encode_all(texts.tolist()), dtype=object)

    return documents.withColumn(out, ids(F.col(text)))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the bytes that the packed ids stand for."""
    small_batches(encoded.sparkSession)

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for packed in batches:
            yield pd.Series([own.decode(p) for p in packed], dtype=object)

    return encoded.withColumn(out, raw(F.col(ids)))


def offsets(
    encoded: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "offsets"
) -> DataFrame:
    """Append, for each id, the start and end of its characters in the text."""
    small_batches(encoded.sparkSession)

    @F.pandas_udf("array<array<bigint>>")
    def spans(texts: pd.Series, packed: pd.Series) -> pd.Series:
        own = codec(path, pattern)
        return pd.Series([list(map(list, own.offsets(t, p).tolist())) for t, p in zip(texts, packed)], dtype=object)

    return encoded.withColumn(out, spans(F.col(text), F.col(ids)))


def unpack(ids: Column) -> Column:
    """Packed ids as an array."""

    @F.pandas_udf("array<bigint>")
    def unpacked(packed: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(p or b"", dtype="<u4").astype(np.int64) for p in packed], dtype=object)

    return unpacked(ids)


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
