"""Phrase collocations by prefix-free parsing.

Texts (A-Z lowered) are split to pieces at punctuation and line ends, and pieces to words. A piece is
parsed into chunks by its content: wherever the hash of a window of ``most_words - 1`` words is divisible
by ``modulus``, the window ends one chunk and starts the next. Neighbouring chunks overlap by that window,
so every n-gram lies whole in some chunk, and equal passages give equal chunks wherever they stand.
Distinct chunks form the dictionary, with the number of times each occurs in the parse. n-grams are
counted inside the distinct chunks only, times the frequency of the chunk, and an n-gram that starts in
the closing window of a chunk is left to the next one, so overlaps count once.

Counting goes by length: single words first, then pairs, then triples. A pair can only reach the least
count if its words do, and a triple if its pairs do, so others are left out before the shuffle by a bit
filter of the frequent ones. The filter is of bounded size (``MOST_BITS``); a full one only lets more pass,
and counts stay exact. Words go by 64-bit hashes of language and word; the table of all words shows
whether two have one hash, and then other hashes are taken.

Edge cases: null and empty texts have no words. A null language is ``und``. Texts and words of any length
are read whole. Repeated rows are documents each. An empty table has no phrases. Ties in the score go by count,
then phrase. Other columns are not returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsecart.llm.common import small_batches
from pulsecart.workspace import materialise

MOST_WORDS = 3
MODULUS = 16
LEAST_BITS, MOST_BITS = 20, 26  # of a filter: 128 KB to 8 MB
_BATCH_CHUNKS, _BATCH_BYTES = 40_000, 2 << 20
# A-Z lowered, tabs to spaces, and everything that ends a piece to one mark.
_ENDS, _END = b".,;:!?\n\x0b\x0c\r", b"."
_PLAIN = bytes(
    _END[0] if b in _ENDS else 0x20 if b == 0x09 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_BLOCK_BYTES = 1 << 20
_ODD, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


class Hasher:
    """Places and 64-bit hashes of the words of a text in bytes; the hash of a mark of an end is 0.

    Hashes are polynomials of the bytes, taken for all words together, with a base by the seed. Seed 0 hashes word
    by word instead, for texts whose words make polynomials meet.
    """

    def __init__(self, seed: int):
        self.seed = seed
        self.base = xxhash.xxh3_64_intdigest(b"base", seed) | 1
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                powers = np.full(n + (n >> 3) + 1, np.uint64(base), dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First bytes, ends and hashes of the words, which spaces part. The text is worked through in blocks."""
        found, at = [], 0
        while at < len(text):
            end = text.find(b" ", at + _BLOCK_BYTES) if at + _BLOCK_BYTES < len(text) else -1
            end = len(text) if end < 0 else end
            found.append(self._block(text, at, end))
            at = end
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        return tuple(map(np.concatenate, zip(*found)))

    def _block(self, text: bytes, at: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code = np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at)
        inside = np.zeros(len(code) + 2, dtype=bool)
        np.not_equal(code, 0x20, out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if self.seed:
            self._powers(len(code))
            sums = np.zeros(len(code) + 1, dtype=np.uint64)
            np.cumsum((code + np.uint64(1)) * self.up[: len(code)], out=sums[1:])
            hashes = (sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)
            hashes = hashes * _ODD
            hashes ^= hashes >> _TURN
        else:
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in text[at:end].split(b" ") if w], dtype=np.uint64)
        hashes[hashes == 0] = 1
        hashes[(ends - starts == 1) & (code[starts] == _END[0])] = 0
        return starts + at, ends + at, hashes


def mixed(*hashes: np.ndarray) -> np.ndarray:
    """One hash of the words in each row."""
    out = np.zeros(len(hashes[0]), dtype=np.uint64)
    for h in hashes:
        out = (out + h) * _ODD
        out ^= out >> _TURN
    return out


def parse(text: bytes, hasher: Hasher, modulus: int = MODULUS, window: int = MOST_WORDS - 1) -> tuple[list[bytes], list[bytes]]:
    """Chunks of a text: those that end with their piece, and those that a window shared with the next one closes."""
    text = text.translate(_PLAIN).replace(_END, b" . ")
    begins, finishes, ids = hasher.words(text)
    ids = np.concatenate([[np.uint64(0)], ids, [np.uint64(0)]])
    ends = np.flatnonzero(ids == 0)  # pieces lie between, from 1
    starts, stops = ends[:-1] + 1, ends[1:]
    starts, stops = starts[stops > starts], stops[stops > starts]
    if not len(starts):
        return [], []
    full = np.ones(max(0, len(ids) - window + 1), dtype=bool)
    for i in range(window):
        full &= ids[i : i + len(full)] != 0
    key = mixed(*[ids[i : i + len(full)] for i in range(window)])
    opens = full & (key % np.uint64(modulus) == 0)
    opens[starts[starts < len(opens)]] = False  # a piece opens its first chunk anyway
    first = np.sort(np.concatenate([starts, np.flatnonzero(opens)]))
    piece = np.searchsorted(starts, first, side="right") - 1
    closed = np.zeros(len(first), dtype=bool)
    closed[:-1] = piece[1:] == piece[:-1]
    last = stops[piece]
    last[:-1][closed[:-1]] = first[1:][closed[:-1]] + window
    cut = lambda rows: [text[a:b] for a, b in zip(begins[first[rows] - 1].tolist(), finishes[last[rows] - 2].tolist())]
    return cut(~closed), cut(closed)


def dictionary(
    documents: DataFrame, text: str = "text", lang: str = "lang", modulus: int = MODULUS, window: int = MOST_WORDS - 1, seed: int = 1
) -> DataFrame:
    """Distinct chunks with their frequency in the parse of all texts: lang, chunk, closed, n."""
    small_batches(documents.sparkSession)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed)
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for name, t in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                by_lang.setdefault(name, []).append(t)
            for name, texts in by_lang.items():
                # A line end is the end of a piece, so no chunk reaches from one text to the next.
                for closed, found in enumerate(parse(b"\n".join(texts), hasher, modulus, window)):
                    if found:
                        counts = Counter(found)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([name] * len(counts)), pa.array(list(counts), pa.binary()),
                                pa.array(np.full(len(counts), bool(closed))), pa.array(list(counts.values()), pa.int64()),
                            ],
                            ["lang", "chunk", "closed", "n"],
                        )

    rows = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    parsed = rows.where(F.length("text") > 0).mapInArrow(chunks, "lang string, chunk binary, closed boolean, n bigint")
    return parsed.groupBy("lang", "chunk", "closed").agg(F.sum("n").alias("n"))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``_BATCH_CHUNKS`` rows, or fewer if chunks are long."""
    some, rows, size = [], 0, 0
    for batch in batches:
        some.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= _BATCH_CHUNKS or size >= _BATCH_BYTES:
            yield pa.Table.from_batches(some)
            some, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(some)


def _owned(batches: Iterator[pa.RecordBatch], seed: int, window: int) -> Iterator[tuple]:
    """For many chunks together: their text, first bytes, ends and hashes of the words (0 after each chunk), languages,
    the chunk of each word, frequencies, and whether an n-gram may start there."""
    hasher = Hasher(seed)
    for table in _tables(batches):
        chunks, lang = table["chunk"].to_pylist(), table["lang"].combine_chunks().dictionary_encode()
        of_lang = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed) for x in lang.dictionary.to_pylist()], dtype=np.uint64)
        text = b" . ".join(chunks) + b" ."
        begins, finishes, ids = hasher.words(text)
        ends = np.flatnonzero(ids == 0)
        chunk = np.repeat(np.arange(len(chunks)), np.diff(ends, prepend=-1))
        left = ends[chunk] - np.arange(len(ids))  # words of the chunk from here on
        closed = table["closed"].to_numpy()
        own = left > window * closed[chunk]
        ids = mixed(of_lang[lang.indices.to_numpy()][chunk], ids)
        ids[ids == 0] = 1
        ids[ends] = 0
        yield (text, begins, finishes), ids, table["lang"].combine_chunks(), chunk, table["n"].to_numpy(), own & (ids != 0)


def _others(text: bytes, begins: np.ndarray, finishes: np.ndarray, at: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Which of the words ``at`` differ from the words ``like``, byte by byte."""
    code, size = np.frombuffer(text, dtype=np.uint8), (finishes - begins)[at]
    other = size != (finishes - begins)[like]
    rows = np.flatnonzero(~other & (at != like))
    size = size[rows]
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    unlike = code[np.repeat(begins[at[rows]], size) + inside] != code[np.repeat(begins[like[rows]], size) + inside]
    other[np.repeat(rows, size)[unlike]] = True
    return other


def _words(chunks: DataFrame, seed: int, window: int) -> DataFrame:
    """Counts of all words: lang, word, h, n. Words that share a hash have a row each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (text, begins, finishes), ids, lang, chunk, n, own in _owned(batches, seed, window):
            at = np.flatnonzero(own)
            keys, first, back = np.unique(ids[at], return_index=True, return_inverse=True)
            sums = np.bincount(back, weights=n[chunk[at]], minlength=len(keys)).astype(np.int64)  # exact below 2 ** 53
            first = at[first]
            other = at[_others(text, begins, finishes, at, first[back])]
            if len(other):
                first, keys, sums = (np.concatenate(x) for x in ((first, other), (keys, ids[other]), (sums, n[chunk[other]])))
            words = [text[a:b] for a, b in zip(begins[first].tolist(), finishes[first].tolist())]
            columns = [lang.take(pa.array(chunk[first])), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys.view(np.int64)), pa.array(sums)], ["lang", "word", "h", "n"])

    rows = chunks.mapInArrow(count, "lang string, word binary, h bigint, n bigint")
    return rows.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")).withColumn("word", F.col("word").cast("string"))


def _grams(chunks: DataFrame, size: int, seed: int, window: int, bits: int, words: np.ndarray, pairs: np.ndarray | None) -> DataFrame:
    """Counts of the n-grams of ``size`` words whose words (and pairs) pass the filters: h1 to h``size``, n."""
    context = chunks.sparkSession.sparkContext
    shared = context.broadcast((words, pairs))
    names = [f"h{i + 1}" for i in range(size)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, together = shared.value
        for _, ids, _, chunk, n, own in _owned(batches, seed, window):
            if len(ids) <= size:
                continue
            good = passes(frequent, bits, ids) & (ids != 0)
            here = own[: len(ids) - size + 1].copy()
            for i in range(size):
                here &= good[i : i + len(here)]
            at = np.flatnonzero(here)
            if together is not None:
                for i in range(size - 1):
                    at = at[passes(together, bits, mixed(ids[at + i], ids[at + i + 1]))]
            columns = [pa.array(ids[at + i].view(np.int64)) for i in range(size)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n[chunk[at]])], [*names, "n"])

    rows = chunks.mapInArrow(count, ", ".join(f"{x} bigint" for x in [*names, "n"]))
    return rows.groupBy(*names).agg(F.sum("n").alias("n"))


def passes(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _filter(rows: DataFrame, columns: list[str], bits: int) -> np.ndarray:
    """Bit filter of the hashes in the rows: bits are put together by tasks, and only the filter itself, of
    bounded size, reaches the driver."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [batch[c].to_numpy().view(np.uint64) for c in columns]
            place = ((hashes[0] if len(hashes) == 1 else mixed(*hashes)) >> np.uint64(64 - bits)).astype(np.int64)
            yield pd.DataFrame({"word": place >> 5, "bit": np.int64(1) << (place & 31)})

    found = rows.select(*columns).mapInPandas(places, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = found.toPandas()  # at most 2 ** bits / 32 rows
    bitmap = np.zeros(1 << (bits - 5), dtype=np.uint32)
    bitmap[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return bitmap.view(np.uint8)


def counts(
    documents: DataFrame, least: int = 10, text: str = "text", lang: str = "lang", modulus: int = MODULUS
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words, pairs and triples that occur ``least`` times or more, and the number of words of each language."""
    window = MOST_WORDS - 1
    chunks = materialise(dictionary(documents, text, lang, modulus, window), "chunks")
    for seed in (1, 2, 3, 0):
        words = materialise(_words(chunks, seed, window), "words")
        if words.groupBy("h").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("words share 64-bit hashes with every seed")
    totals = words.groupBy("lang").agg(F.sum("n").cast("bigint").alias("total"))
    words = materialise(words.where(F.col("n") >= least), "frequent-words")
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * words.count()).bit_length()))
    of_words = _filter(words, ["h"], bits)
    pairs = materialise(_grams(chunks, 2, seed, window, bits, of_words, None).where(F.col("n") >= least), "pairs")
    of_pairs = _filter(pairs, ["h1", "h2"], bits)
    triples = materialise(_grams(chunks, 3, seed, window, bits, of_words, of_pairs).where(F.col("n") >= least), "triples")
    return words, pairs, triples, totals


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact: products have up to 38 digits."""
    whole = lambda x: x.cast("decimal(16,0)")
    top = (whole(a) * whole(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (whole(left) * whole(right)).cast("decimal(32,0)"))


def collocations(
    documents: DataFrame, least: int = 10, most: int = 2000, covered_percent: int = 50, text: str = "text", lang: str = "lang",
    modulus: int = MODULUS,
) -> DataFrame:
    """The ``most`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is that of its weakest cut. Phrases of which a longer one covers ``covered_percent`` or
    more are left out.
    """
    words, pairs, triples, totals = counts(documents, least, text, lang, modulus)

    def word(i: int) -> DataFrame:
        return words.select(
            F.col("h").alias(f"h{i}"), F.col("lang").alias(f"lang{i}"), F.col("word").alias(f"w{i}"), F.col("n").alias(f"f{i}")
        )

    def pair(i: int) -> DataFrame:
        return pairs.select(F.col("h1").alias(f"h{i}"), F.col("h2").alias(f"h{i + 1}"), F.col("n").alias(f"f{i}{i + 1}"))

    longer = triples.select(F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"), "n")
    longer = longer.groupBy("p.h1", "p.h2").agg(F.max("n").alias("longest"))
    twos = (
        pairs.join(longer, ["h1", "h2"], "left")
        .where(F.coalesce(F.col("longest"), F.lit(0)) * 100 < F.col("n") * covered_percent)
        .join(word(1), "h1").join(word(2), "h2")
        .select(
            F.col("lang1").alias("lang"), F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"),
            F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("n"), F.col("f1"), F.col("f2")).alias("score"),
        )
    )
    cut1, cut2 = _score(F.col("n"), F.col("f1"), F.col("f23")), _score(F.col("n"), F.col("f12"), F.col("f3"))
    threes = (
        triples.join(pair(1), ["h1", "h2"]).join(pair(2), ["h2", "h3"]).join(word(1), "h1").join(word(2), "h2").join(word(3), "h3")
        .withColumn("cut1", cut1).withColumn("cut2", cut2)
        .select(
            F.col("lang1").alias("lang"), F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"),
            F.when(F.col("cut1") <= F.col("cut2"), F.col("f1")).otherwise(F.col("f12")).alias("l"),
            F.when(F.col("cut1") <= F.col("cut2"), F.col("f23")).otherwise(F.col("f3")).alias("r"),
            F.least("cut1", "cut2").alias("score"),
        )
    )
    # Every task keeps its own best rows first, so a language comes together as bounded lists only.
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = twos.unionByName(threes).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("bigint").alias("score")
    )
