"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window is one
word; it is compressed with either dictionary, and the bytes that the toxic dictionary saves more
are its advantage. A document's score comes from how many of its windows reach each of some thresholds.

- The toxic dictionary holds pieces of toxic text, words and beginnings of words, whose document counts are too
  high for chance (G statistic), the strongest last. So a word is told by a stem that it was never seen with.
  The ordinary dictionary holds the commonest ordinary words, and then the ordinary words that still compress
  better with the toxic one, found over a few rounds.
- Each window follows a fixed filler that both dictionaries hold. Without it the coder would store a
  short word as it is, since a match saves less than the smallest gain it accepts. Letters are widened
  to two characters, so that a match with a word of four or five letters is worth its own cost.
- The score is calibrated by cross-fitting: a third of the labelled rows at a time is scored by dictionaries of
  the others, and a logistic function of the counts at all thresholds, which has the labels' own prior, is
  fitted to all of them. A score of 0.5 is where precision and recall of these rows are best together. With few labelled rows, how far from chance a piece must be is chosen in the same way.
  The dictionaries that remain come from all rows.

In scripts without spaces a run of letters is one window, cut at 64 letters; its beginning counts.

Edge cases: null and empty texts have no window and get the score of a text without findings. Words
of over 64 letters are cut into windows of 64. Without labelled rows of both kinds every score is 0.
Rows of a label table that repeat count once; a document labelled both ways teaches nothing.
Other columns pass through untouched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsecart.llm.common import balanced_sample, pieces, small_batches

FILLER = "0123456789#0123456789#ABCDEFGHIJKLMNOP"
LEVEL = 19
LONGEST_WORD = 64
STEMS = (4, 8)  # letters of the beginnings of words, the last not included
_LEVELS = np.array([1, 2, 3, 4, 5, 6, 8])  # thresholds of an advantage, in bytes
_WORD = re.compile(r"[^\W\d_]{1,%d}" % LONGEST_WORD)
_CACHE_WORDS = 400_000
_cache: dict[int, dict[str, int]] = {}
_OUT = "score double, n_windows long, n_toxic_windows long, best_advantage int"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def widened(word: str) -> str:
    """Every letter twice, the second time in the other case."""
    return "".join([c + c.swapcase() for c in word])


@dataclass
class Model:
    """What the tasks need: two dictionaries, the threshold of windows that are reported, and a logistic score."""

    toxic: bytes = b""
    ordinary: bytes = b""
    threshold: int = 1
    weights: list[float] = field(default_factory=list)

    def compressors(self):
        made = []
        for content in (self.ordinary, self.toxic):
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=len(FILLER) + 8 * LONGEST_WORD, dict_size=len(content),
                strategy=zstandard.STRATEGY_BTOPT, search_log=5, hash_log=10, chain_log=15,
                format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0,
                write_dict_id=0,
            )
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=params)
            made.append(zstandard.ZstdCompressor(dict_data=words, compression_params=params))
        return made

    def advantage(self):
        """Function from a word to the bytes that the toxic dictionary saves; remembers words."""
        ordinary, toxic = self.compressors()
        known = _cache.setdefault(hash((self.toxic, self.ordinary)), {})

        def of(word: str) -> int:
            found = known.get(word)
            if found is None:
                if len(known) >= _CACHE_WORDS:
                    known.clear()
                window = f"{FILLER} {widened(word)} ".encode()
                found = len(ordinary.compress(window)) - len(toxic.compress(window))
                known[word] = found
            return found

        return of

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(features))
        z = features @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features_of(advantages: list[int]) -> list[float]:
    """For each threshold the windows that reach it, and their share (logs); and the best advantage."""
    own = np.array(advantages or [0])
    over = (own[:, None] >= _LEVELS).sum(axis=0)
    return [*np.log1p(over), *np.log1p(1000 * over / (len(advantages) + 1)), float(max(own.max(), 0))]


def pieces_of(word: str) -> list[str]:
    """A word and its beginnings, after a space."""
    return [f" {word} ", *(f" {word[:n]}" for n in range(*STEMS) if len(word) > n)]


def _dictionary(parts: list[str]) -> bytes:
    return f"{''.join(parts)}{FILLER}".encode()


def _in_full(words: list[str]) -> list[str]:
    return [f" {widened(w)}" for w in words] + [" "]


def _g(a: int, b: int, n1: int, n0: int) -> float:
    """Signed G statistic of a word found in a of n1 toxic and b of n0 ordinary documents."""
    total, n = a + b, n1 + n0
    g = 2 * sum(x * math.log(x * n / (total * m)) for x, m in ((a, n1), (b, n0)) if x)
    return g if a * n0 > b * n1 else -g


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> list[float]:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    keep = np.eye(len(w)) * ridge
    keep[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + keep, x.T @ (weight * (p - y)) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def dictionaries(
    docs: list[list[str]], y: np.ndarray, least_g: float, most_toxic: int = 1500, most_ordinary: int = 1200, rounds: int = 4,
) -> Model:
    """The two dictionaries of labelled documents, given as words."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    ordinary_words: Counter = Counter()
    for doc, label in zip(docs, y.tolist()):
        own = set(doc)
        seen[label].update({p for w in own for p in pieces_of(w)})
        if not label:
            ordinary_words.update(own)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        return Model()
    g = {p: _g(a, seen[0][p], n1, n0) for p, a in seen[1].items() if a >= 3}
    told = sorted((p for p in g if g[p] >= least_g), key=lambda p: (g[p], p))[-most_toxic:]
    if not told:
        return Model()
    known = set(told)
    toxic = _dictionary([" " + widened(p.strip(" ")) + (" " if p.endswith(" ") else "") for p in told])
    ordinary = sorted(ordinary_words, key=lambda w: (ordinary_words[w], w))[-most_ordinary:]
    model, mined = Model(toxic, _dictionary(_in_full(ordinary))), []
    for _ in range(rounds):
        of = model.advantage()
        worse = [w for w in ordinary_words if of(w) >= 1 and known.isdisjoint(pieces_of(w))]
        if not worse:
            break
        mined += sorted(worse, key=lambda w: (of(w) * ordinary_words[w], w))[-800:]
        model = Model(toxic, _dictionary(_in_full(ordinary + mined)))
    return model


def _advantages(model: Model, docs: list[list[str]]) -> list[list[int]]:
    of = model.advantage() if model.toxic else lambda w: 0
    return [[of(w) for w in doc] for doc in docs]


def _cut(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Log-odds from which on a row is better called toxic: where precision and recall are best together (F1)."""
    order = np.argsort(-p, kind="stable")
    right, called = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * right / (called + (weight * y).sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = 0  # equal scores are called together
    at = int(f1.argmax())
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    middle = float(np.clip((p[order][at] + below) / 2, 1e-6, 1 - 1e-6))
    return math.log(middle / (1 - middle))


def train(
    texts: list[str], labels: list[int], prior: float | None = None, least_g: float = 20.0, few: int = 1000, folds: int = 3,
) -> Model:
    """Train on texts in memory. ``prior`` is the share of toxic rows outside the sample. With fewer than ``few`` rows
    other values of ``least_g`` are tried too."""
    docs = [words_of(t) for t in texts]
    y = np.array(labels, dtype=int)
    if y.size == 0 or y.min() == y.max():
        return Model()
    fold = np.zeros(len(y), dtype=int)
    for label in (0, 1):  # each fold has its share of both
        rows = np.flatnonzero(y == label)
        fold[rows] = np.arange(len(rows)) % folds
    share = y.mean()
    prior = share if prior is None else prior
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    best = None
    for least in (least_g,) if len(y) >= few else (least_g, 0.7 * least_g, 0.45 * least_g):
        found: list[list[int]] = [[]] * len(y)
        for k in range(folds):
            rest, kept = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            model = dictionaries([docs[i] for i in rest], y[rest], least)
            for i, own in zip(kept, _advantages(model, [docs[i] for i in kept])):
                found[i] = own
        x = np.array([features_of(f) for f in found])
        mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        w = np.array(_logistic((x - mean) / spread, y, weight, ridge=3.0))
        p = 1 / (1 + np.exp(-np.clip(np.hstack([np.ones((len(x), 1)), (x - mean) / spread]) @ w, -30, 30)))
        loss = -(weight * np.log(np.where(y == 1, p, 1 - p))).mean()
        if best is None or loss < best[0]:
            plain = np.array([a for f, label in zip(found, y) if not label for a in f] or [0])
            threshold = next((t for t in range(2, 12) if (plain >= t).mean() <= 1e-4), 12)
            shift = _cut(p, y, weight) + float((w[1:] * mean / spread).sum())
            best = (loss, least, threshold, [float(w[0]) - shift, *(w[1:] / spread).tolist()])
    _, least, threshold, weights = best
    model = dictionaries(docs, y, least)
    model.threshold, model.weights = threshold, weights
    return model


def fit(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    cap: int = 1500, piece: int = 1000, most_pieces: int = 8,
) -> Model:
    """Train on a bounded sample: about ``cap`` documents of each label, each with at most
    ``most_pieces`` pieces of ``piece`` characters spread over the text."""
    spark = documents.sparkSession
    one = (
        labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
        .where(F.col("_label").isin(0, 1) & F.col("_key").isNotNull())
        .groupBy("_key").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other"))
        .where(F.col("_label") == F.col("_other")).drop("_other")
    )
    counts = {r["_label"]: r["count"] for r in one.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return Model()
    chosen = balanced_sample(one, "_label", "_key", cap)
    rows = (
        documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
        .where(F.col("_text").isNotNull())
        .join(F.broadcast(chosen), "_key")  # about cap rows of each label
        .select("_key", "_label", F.array_join(pieces(F.col("_text"), piece, most_pieces), " ").alias("_text"))
        .toPandas().drop_duplicates("_text").sort_values("_key")
    )
    small_batches(spark)
    order = rows.sample(frac=1.0, random_state=7)
    return train(order["_text"].tolist(), order["_label"].tolist(), counts[1] / (counts[0] + counts[1]))


def score(documents: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Append a struct column: score, n_windows, n_toxic_windows, best_advantage."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_OUT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        of = model.advantage() if model.toxic else lambda w: 0
        for texts in batches:
            x, counts = [], []
            for t in texts:
                found = [of(w) for w in words_of(t)]
                x.append(features_of(found))
                counts.append((len(found), sum(a >= model.threshold for a in found), max(found, default=0)))
            n, over, best = zip(*counts) if counts else ((), (), ())
            yield pd.DataFrame(
                {"score": model.score(np.array(x).reshape(-1, 2 * len(_LEVELS) + 1)), "n_windows": n, "n_toxic_windows": over, "best_advantage": best}
            )

    return documents.withColumn(out, judge(F.col(text)))
