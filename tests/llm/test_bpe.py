"""Encoding against an independent encoder and exact round trips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsecart.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH, PATTERN = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


@pytest.fixture(scope="module")
def other():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def samples():
    r = random.Random(0)
    chars = [chr(i) for i in range(0x250)] + list("\u0085     　​中\U0001f600٠")
    for _ in range(4000):
        yield "".join(r.choice(chars if r.random() < 0.5 else " \n,.'\tsS1a") for _ in range(r.randrange(20)))
    yield from ["a" * 5000, " " * 300, "word " * 3000, "don't, stop. It's\n\nend", "\0, \0.", "<|endoftext|>"]


def test_ids_equal_those_of_the_other_encoder(other):
    own, texts = bpe.codec(PATH, PATTERN), list(samples())
    got = [np.frombuffer(p, "<u4").tolist() for p in own.encode_all(texts)]
    assert got == [other.encode_ordinary(t) for t in texts]


def test_decoding_restores_every_text_and_prefixes_of_bytes():
    own = bpe.codec(PATH, PATTERN)
    for text in samples():
        packed = own.encode(text)
        assert own.decode(packed) == text.encode()
        assert text.encode().startswith(own.decode(packed[: len(packed) // 8 * 4]))


def test_offsets_cover_the_text(documents):
    text = "Größe 中文 \U0001f600 it's"
    encoded = bpe.encode(documents([text, None, ""]), PATH, PATTERN)
    rows = bpe.offsets(encoded, PATH, PATTERN).select("*", bpe.unpack(F.col("ids")).alias("list")).orderBy("doc_id").collect()
    spans = rows[0]["offsets"]
    assert len(spans) == len(rows[0]["list"]) and spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a < b for a, b in spans) and all(x[0] <= y[0] <= x[1] for x, y in zip(spans, spans[1:]))
    assert [r["offsets"] for r in rows[1:]] == [[], []]


def test_odd_rows(documents):
    out = bpe.decode(bpe.encode(documents([None, "", "x" * 100_000]), PATH, PATTERN), PATH, PATTERN)
    rows = out.select("doc_id", bpe.n_ids(F.col("ids")).alias("n"), "decoded").orderBy("doc_id").collect()
    assert [r["n"] for r in rows[:2]] == [0, 0] and bytes(rows[2]["decoded"]) == b"x" * 100_000
    assert bpe.encode(documents([]).limit(0), PATH, PATTERN).count() == 0
