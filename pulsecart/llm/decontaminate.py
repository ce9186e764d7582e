"""Benchmark decontamination: documents that hold an item of a benchmark within an edit distance.

Texts become words (A-Z lowered; ASCII other than letters and digits separates). A document holds
an item of L words if some run of its words is within ``floor((1 - similarity) * L)`` word edits.

1. Windows. The L words from the start of such a run hold at least L minus its edits words of the item, so
   only windows of the size of an item that hold as many of the items' words are gone into. The filter is exact.
2. Embedding. A CGK random walk goes through words from a start: each step puts out the word it stands on, and a
   random bit of the step and the word says whether it moves on. Walks that start together in a window and in an
   item go on together up to an edit, and often meet again behind it, so a small edit distance becomes a small
   Hamming distance of the outputs. All words of a window and of an item are starts, as a run may lack words anywhere.
3. Bit sampling. A key is the outputs at ``SAMPLED`` steps; equal keys of a window and an item make a candidate.
   This is repeated with other bits and steps. For each size of items, edited copies of its items at the threshold
   (edits anywhere, lost heads, lost tails) measure the longest span of steps and the number of repetitions that
   find them with the target ``recall``.
4. Candidates of one item that overlap are one range; the closest run of each range comes from the exact edit
   distance, by bit-parallel dynamic programming.

Items go to the tasks in blocks of bounded size; documents stay where they are, and each document is
worked through whole, in pieces of bounded memory only if it is one of many in a batch.

Edge cases: null and empty texts hold nothing. Items without words are never found. Items with a
null text or id take no part. An item of fewer than 5 words must occur exactly. Several runs of one
item in one document give one row, the closest run and then the first. Repeated documents give rows
each; repeated item ids are items each, and rows are made distinct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsecart.llm.common import small_batches

SAMPLED = 3  # steps in a key
SHORTEST = 4  # span of steps that keys are sampled from, at least
MOST_REPEATS, TRIALS = 24, 60
LIKE = 1.1  # most and least words of the items in a group
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 4 << 20
_PIECE = 4 << 20
_SOME = 1 << 15  # hits worked on at once
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 for a separator, else the byte of the word
for _b in range(256):
    _c = chr(_b).lower() if _b < 128 else ""
    if _b >= 128 or _c.isalnum():
        _CLASS[_b] = ord(_c) if _c else _b
_powers: dict[str, np.ndarray] = {}


def _geometric(base: int, n: int, name: str) -> np.ndarray:
    """Powers of an odd number modulo 2**64."""
    known = _powers.get(name)
    if known is None or len(known) < n:
        size = max(n, 1 << 16)
        known = np.full(size, np.uint64(base & (2**64 - 1)), dtype=np.uint64)
        known[0] = 1
        _powers[name] = known = np.multiply.accumulate(known)
    return known[:n]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a text in bytes."""
    code = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    inside = np.zeros(len(code) + 2, dtype=bool)
    np.not_equal(code, 0, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(code * _geometric(_BASE, len(code), "up"), out=sums[1:])
    down = _geometric(pow(_BASE, -1, 2**64), len(code) + 1, "down")
    mixed = (sums[ends] - sums[starts]) * down[starts] * _ODD
    return mixed ^ (mixed >> np.uint64(31)), starts


def edit_end(item: list[int], words: list[int], most: int) -> tuple[int, int] | None:
    """Least distance of the item to a prefix of the words, and that prefix' length (the shortest
    such), by bit-parallel dynamic programming; None if it exceeds ``most``."""
    m = len(item)
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best = (m, 0)
    for j, w in enumerate(words[: m + most], 1):
        eq = places.get(w, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        right, left = down | (full & ~(d0 | up)), d0 & up
        distance += bool(right & top) - bool(left & top)
        right = ((right << 1) | 1) & full
        left = (left << 1) & full
        up, down = left | (full & ~(d0 | right)), d0 & right
        if distance < best[0]:
            best = (distance, j)
    return best if best[0] <= most else None


def start_distances(item: list[int], words: list[int]) -> list[int]:
    """For each start, the least distance of the item to a run of words from there, by the bit-parallel
    dynamic programming of ``edit_end``, backwards and with any end."""
    m = len(item)
    places: dict[int, int] = {}
    for i, w in enumerate(reversed(item)):
        places[w] = places.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    out = [0] * len(words)
    for s in range(len(words) - 1, -1, -1):
        eq = places.get(words[s], 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        right, left = down | (full & ~(d0 | up)), d0 & up
        distance += bool(right & top) - bool(left & top)
        right, left = (right << 1) & full, (left << 1) & full
        up, down = left | (full & ~(d0 | right)), d0 & right
        out[s] = distance
    return out


def _beyond(number: int, longest: int) -> np.ndarray:
    """Words that occur nowhere, for walks that run over an end; different for each number."""
    return np.arange(longest, dtype=np.uint64) + np.uint64((1 << 40) + number * (longest + 1))


def _joined(parts: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Word lists in one line, each with room behind it for a walk, and the place of every word."""
    line = [x for i, p in enumerate(parts) for x in (p.astype(np.uint64), _beyond(i, longest))]
    heads = np.cumsum([0, *(len(p) + longest for p in parts)])[:-1]
    return np.concatenate(line), np.concatenate([h + np.arange(len(p)) for h, p in zip(heads, parts)])


def edited(item: np.ndarray, most: int, rng: np.random.Generator, trials: int) -> list[np.ndarray]:
    """Copies of an item with ``most`` edits: anywhere, or all at its head, or all at its tail."""
    found = []
    for trial in range(trials):
        words = item.tolist()
        if trial % 6 == 4:
            words = words[most:]
        elif trial % 6 == 5:
            words = words[: len(words) - most]
        else:
            for _ in range(most):
                p = int(rng.integers(0, len(words)))
                kind = int(rng.integers(0, 3))
                if kind == 0:
                    words[p] = 1 << 50
                elif kind == 1:
                    words.insert(p, 1 << 50)
                elif len(words) > 1:
                    words.pop(p)
        found.append(np.array(words, dtype=np.uint64))
    return found


class Walk:
    """One repetition: random bits of the steps, and the sampled steps."""

    def __init__(self, rng: np.random.Generator, span: int):
        self.longest = span
        self.steps = np.sort(rng.choice(span, min(SAMPLED, span), replace=False)).tolist()
        self.odd = rng.integers(1, 1 << 62, span, dtype=np.uint64) | np.uint64(1)

    def keys(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Key of the walk from each start; the line has room for it behind every start."""
        key = np.zeros(len(at), dtype=np.uint64)
        for step in range(self.steps[-1] + 1):
            word = (line[at] + np.uint64(1)) * self.odd[step]
            if step in self.steps:
                key = (key ^ word) * _ODD
                key ^= key >> np.uint64(29)
            at = at + ((word >> np.uint64(40)) & np.uint64(1)).view(np.int64)
        return key


@dataclass
class Group:
    """Items of one size: what their windows must hold, and for each walk the sorted keys of all their words."""

    low: int
    high: int
    need: int
    known: np.ndarray
    walks: list[Walk]
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # keys, their first rows, items, places
    words: int


class Index:
    """What the tasks need to find the items of one block."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = 0.8, recall: float = 0.998, seed: int = 11):
        if not 0 < similarity <= 1:
            raise ValueError("similarity must be above 0 and at most 1")
        if not 0 < recall < 1:
            raise ValueError("recall must be between 0 and 1")
        hashed = [(i, word_hashes(t.encode())[0]) for i, t in items]
        hashed = [(i, h) for i, h in hashed if len(h)]
        self.vocabulary = np.unique(np.concatenate([h for _, h in hashed])) if hashed else np.zeros(0, dtype=np.uint64)
        self.ids = [i for i, _ in hashed]
        self.items = [np.searchsorted(self.vocabulary, h) + 1 for _, h in hashed]
        self.similarity, self.recall, self.seed = similarity, recall, seed
        self.most = [self._edits(len(t)) for t in self.items]
        self.flags = np.zeros(1 << 16, dtype=bool)
        self.flags[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        self.groups = [self._group(low, high, own) for low, high, own in self._sizes()]

    def _edits(self, size: int) -> int:
        return max(0, math.floor((1 - self.similarity) * size + 1e-9))

    def _sizes(self) -> list[tuple[int, int, list[int]]]:
        """Least and most words, and items, of each group: items of one size, or of nearly one."""
        sizes = sorted({len(t) for t in self.items})
        groups: list[tuple[int, int, list[int]]] = []
        for size in sizes:
            own = [n for n, t in enumerate(self.items) if len(t) == size]
            if groups and size <= LIKE * groups[-1][0]:
                low, _, before = groups[-1]
                groups[-1] = (low, size, before + own)
            else:
                groups.append((size, size, own))
        return groups

    def _group(self, low: int, high: int, own: list[int]) -> "Group":
        known = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        for n in own:
            known[self.items[n]] = True
        walks = self._walks(low, own)
        words = np.concatenate([self.items[n] for n in own])
        owners = np.repeat(own, [len(self.items[n]) for n in own])
        places = np.concatenate([np.arange(len(self.items[n])) for n in own])
        # Walks of an item end with it: what lies behind is another word for each.
        line, starts = _joined([self.items[n] for n in own], walks[0].longest)
        tables = []
        for walk in walks:
            keys = walk.keys(line, starts)
            order = np.argsort(keys, kind="stable")
            distinct, first = np.unique(keys[order], return_index=True)
            tables.append((distinct, np.append(first, len(order)), owners[order], places[order]))
        return Group(low, high, low - self._edits(low), known, walks, tables, len(words))

    def _walks(self, low: int, own: list[int]) -> list["Walk"]:
        """The repetitions of a group: as many as find its edited items, with the longest span of steps that does."""
        rng = np.random.default_rng([self.seed, low])
        tried = [self.items[n] for n in own[:: max(1, len(own) // 6)][:6]]
        copies = [(i, c) for i, item in enumerate(tried) for c in edited(item, self._edits(len(item)), rng, TRIALS)]
        span = low
        while True:
            walks = [Walk(rng, span) for _ in range(MOST_REPEATS)]
            item_line, item_starts = _joined(tried, span)
            of_item = np.repeat(np.arange(len(tried)), [len(t) for t in tried])
            copy_line, copy_starts = _joined([c for _, c in copies], span)
            of_copy = np.repeat(np.arange(len(copies)), [len(c) for _, c in copies])
            item_of = np.array([i for i, _ in copies])
            first = np.full(len(copies), MOST_REPEATS)
            for r, walk in enumerate(walks):
                mine = walk.keys(item_line, item_starts) ^ (of_item.astype(np.uint64) * _ODD)
                theirs = walk.keys(copy_line, copy_starts) ^ (item_of[of_copy].astype(np.uint64) * _ODD)
                hit = np.unique(of_copy[np.isin(theirs, mine)])
                first[hit] = np.minimum(first[hit], r)
            # Every item's own edited copies must be found; the worst item counts.
            needed = max(int(np.sort(first[item_of == i])[math.ceil(self.recall * (item_of == i).sum()) - 1]) for i in range(len(tried)))
            if needed < MOST_REPEATS // 2 or span <= SHORTEST:
                return walks[: min(MOST_REPEATS, 2 * needed + 1)]
            span = max(SHORTEST, span // 2)

    def _hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Candidates: items, words of the texts, and the words of the items whose keys they have."""
        n, known = len(words), words > 0
        counted = np.zeros(n + 1 + max(g.high for g in self.groups), dtype=np.int32)
        np.cumsum(known, out=counted[1 : n + 1])
        counted[n + 1 :] = counted[n]
        for group in self.groups:
            enough = counted[group.high : group.high + n] - counted[:n] >= group.need
            starts = np.flatnonzero(enough & known)
            if not len(starts):
                continue
            own = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(group.known[words], out=own[1:])
            ends = np.minimum(starts + group.high, n)
            keep = own[ends] - own[starts] >= group.need
            starts, ends = starts[keep], ends[keep]
            if not len(starts):
                continue
            # All words of the windows are starts of walks.
            cover = np.zeros(n + 1, dtype=np.int32)
            np.add.at(cover, starts, 1)
            np.add.at(cover, ends, -1)
            at = np.flatnonzero((np.cumsum(cover[:-1]) > 0) & group.known[words])
            line = np.concatenate([words.astype(np.uint64), _beyond(0, group.walks[0].longest)])
            for walk, (keys, first, owners, places) in zip(group.walks, group.tables):
                found = walk.keys(line, at)
                key = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                right = np.flatnonzero(keys[key] == found)
                # A key that many items share gives a hit for each.
                chunk = np.cumsum(first[key[right] + 1] - first[key[right]]) // _SOME
                for some in np.split(right, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1) if len(right) else ():
                    k = key[some]
                    many = first[k + 1] - first[k]
                    row = np.repeat(first[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    yield owners[row], np.repeat(at[some], many), places[row]

    def _ranges(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Document, item, first and last word (exclusive) of ranges that hold a candidate and enough words."""
        sizes, most = np.array([len(t) for t in self.items]), np.array(self.most)
        found = [np.zeros((4, 0), dtype=np.int64)]
        for n, hit, place in self._hits(words):
            doc = np.searchsorted(bounds, hit, side="right") - 1
            start = hit - place
            low, high = np.maximum(start - most[n], bounds[doc]), np.minimum(start + sizes[n] + most[n], bounds[doc + 1])
            found.append(np.unique(np.stack([n, doc, low, high]), axis=1))
        found = np.unique(np.concatenate(found, axis=1), axis=1)
        for part in np.split(found, np.flatnonzero(found[0, 1:] != found[0, :-1]) + 1, axis=1) if found.size else ():
            n, (doc, low, high) = int(part[0, 0]), part[1:]
            own, need = np.zeros(len(self.vocabulary) + 1, dtype=bool), sizes[n] - most[n]
            own[self.items[n]] = True
            width, keep = int(sizes[n] + 2 * most[n]), []
            step = max(1, (_SOME << 6) // width)
            for lo in range(0, len(low), step):
                place = low[lo : lo + step, None] + np.arange(width)
                inside = place < high[lo : lo + step, None]
                keep.append((own[words[np.minimum(place, len(words) - 1)]] & inside).sum(axis=1) >= need)
            keep = np.concatenate(keep)
            open_doc, a, b = -1, 0, 0
            for d, x, y in zip(doc[keep].tolist(), low[keep].tolist(), high[keep].tolist()):
                if d == open_doc and x <= b:
                    b = max(b, y)
                    continue
                if open_doc >= 0:
                    yield open_doc, n, a, b
                open_doc, a, b = d, x, y
            if open_doc >= 0:
                yield open_doc, n, a, b

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """Rows of text number, item number, first word, words, distance: the best of each pair."""
        raws = [t.encode() for t in texts]
        offsets = np.cumsum([0, *(len(r) + 1 for r in raws)])
        hashes, at = word_hashes(b"\n".join(raws))
        ids = np.zeros(len(hashes), dtype=np.int64)
        maybe = np.flatnonzero(self.flags[(hashes >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        right = self.vocabulary[place] == hashes[maybe]
        ids[maybe[right]] = place[right] + 1
        if not right.any():
            return []
        bounds = np.searchsorted(at, offsets)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, n, low, high in self._ranges(ids, bounds):
            item, own = self.items[n].tolist(), set(self.items[n].tolist())
            around = ids[low:high].tolist()
            # The closest run may start with a word of the item: a first word that is none is not needed.
            close = min(((d, s) for s, d in enumerate(start_distances(item, around)) if around[s] in own), default=None)
            if close is None or close[0] > self.most[n]:
                continue
            before = best.get((doc, n))
            if before is not None and before[:2] <= (close[0], low + close[1] - int(bounds[doc])):
                continue
            hit = edit_end(item, around[close[1] :], self.most[n])
            if hit is not None:
                best[doc, n] = (hit[0], low + close[1] - int(bounds[doc]), hit[1])
        return [(doc, n, start, size, distance) for (doc, n), (distance, start, size) in best.items()]


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded size together: number of the first, and the texts."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > _PIECE:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def _blocks(items: DataFrame, similarity: float, recall: float, item_key: str, item_text: str) -> Iterator[Index]:
    """Indexes of blocks of items, each of bounded size."""
    own = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    size = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("b")).first()
    blocks = max(1, math.ceil(size["n"] / BLOCK_ITEMS), math.ceil((size["b"] or 0) / BLOCK_CHARS))
    part = F.pmod(F.xxhash64("t", "i"), F.lit(blocks))
    for b in range(blocks):
        yield Index(sorted((r["i"], r["t"]) for r in own.where(part == b).collect()), similarity, recall)


def holding(
    documents: DataFrame, items: DataFrame, similarity: float = 0.8, recall: float = 0.998,
    text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> Column:
    """Condition that is true for documents that hold any item; made without a shuffle."""
    spark = documents.sparkSession
    small_batches(spark)

    def condition(index: Index) -> Column:
        shared = spark.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                own, hit = [t or "" for t in texts], np.zeros(len(texts), dtype=bool)
                for first, piece in _pieces(own) if shared.value.items else ():
                    for doc, *_ in shared.value.find(piece):
                        hit[first + doc] = True
                yield pd.Series(hit)

        return holds(F.col(text))

    found = F.lit(False)
    for index in _blocks(items, similarity, recall, item_key, item_text):
        found = found | condition(index)
    return found


def find_items(
    documents: DataFrame, items: DataFrame, similarity: float = 0.8, recall: float = 0.998,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and item found: doc_id, item_id, start_word, n_words, distance, similarity."""
    spark = documents.sparkSession
    small_batches(spark)
    kind, item_kind = documents.schema[key].dataType, items.schema[item_key].dataType
    schema = (
        f"`{key}` {kind.simpleString()}, `{item_key}` {item_kind.simpleString()}, start_word bigint, n_words bigint, "
        "distance bigint, similarity double"
    )
    rows = documents.select(F.col(key), F.col(text).alias("_text")).where(F.length("_text") > 0)
    out = None
    for index in _blocks(items, similarity, recall, item_key, item_text):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in batches:
                keys, texts, found = batch[key].tolist(), batch["_text"].tolist(), []
                for first, piece in _pieces(texts) if index.items else ():
                    for doc, n, start, words, distance in index.find(piece):
                        close = 1 - distance / len(index.items[n])
                        found.append((keys[first + doc], index.ids[n], start, words, distance, close))
                yield pd.DataFrame(found, columns=[key, item_key, "start_word", "n_words", "distance", "similarity"])

        found = rows.mapInPandas(search, schema)
        out = found if out is None else out.unionByName(found)
    return out
