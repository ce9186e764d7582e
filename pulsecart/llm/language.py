"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the character n-grams of its lower-cased letters, with one mark between
words; their hashes choose rows of an embedding table, the rows are averaged over the whole text,
and a linear layer with a softmax gives the languages. Table and layer are trained by stochastic
gradient descent in numpy on a bounded sample. Afterwards a temperature is fitted on rows kept out
of the training, and the rejection threshold is the confidence that all but ``MISSED`` of the
rightly named kept rows reach, never above ``HIGHEST``.

Since the layer is linear, a subword's embedding times the layer is one row of scores per language,
so a prediction adds up the scores of two n-grams per character and nothing else.

Edge cases: null texts and texts without a letter are ``und`` with score 0, and rejected. Without
labelled rows every text is ``und``. One learned language gives it to every text with letters. Other
columns pass through untouched.
"""

from __future__ import annotations

import regex
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsecart.llm.common import balanced_sample, pieces, small_batches

UNKNOWN = "und"
SIZES = (2, 3)
BUCKETS = 1 << 16
DIMENSIONS = 16
MISSED, HIGHEST = 0.001, 0.5
_CHUNK = 1 << 20
_LETTERS = regex.compile(r"\p{L}+")  # letters by Unicode category: no superscripts, fractions or letter-like numbers
_OUT = "lang string, score double, rejected boolean"


def subwords(text: str) -> np.ndarray:
    """Buckets of all n-grams of the text."""
    words = _LETTERS.findall(text.lower())
    if not words:
        return np.zeros(0, dtype=np.int64)
    marked = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    found, rolled = [], np.zeros(len(marked), dtype=np.uint64)
    for size in range(1, max(SIZES) + 1):
        n = len(marked) - size + 1
        if n <= 0:
            break
        rolled = rolled[:n] * np.uint64(0x9E3779B97F4A7C15) + marked[size - 1 : size - 1 + n] + np.uint64(size)
        if size in SIZES:
            mixed = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((mixed >> np.uint64(40)) & np.uint64(BUCKETS - 1))
    return np.concatenate(found).astype(np.int64)


@dataclass
class Model:
    """Scores of each bucket for each language, and the calibration."""

    languages: list[str] = field(default_factory=list)
    scores: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), dtype=np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray | None:
        """Mean score of all subwords, or null for a text without a letter."""
        total, n = np.zeros(len(self.languages)), 0
        for at in range(0, len(text), _CHUNK):  # bounds the memory that a long text takes
            found = subwords(text[at : at + _CHUNK])
            total += np.ones(len(found), dtype=np.float32) @ self.scores.take(found, axis=0)
            n += len(found)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        logits = self.logits(text) if text and self.languages else None
        if logits is None:
            return UNKNOWN, 0.0, True
        p = _softmax(logits[None, :] / self.temperature)[0]
        i = int(p.argmax())
        return self.languages[i], float(p[i]), bool(p[i] < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], languages: list[str], epochs: int = 6, least_steps: int = 6000, rate: float = 4.0, seed: int = 3) -> Model:
    """Train on texts in memory. A fifth of them calibrates."""
    names = sorted(set(languages))
    rows = [(s, names.index(y)) for t, y in zip(texts, languages) if len(s := subwords(t))]
    if not rows:
        return Model()
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    kept = set(order[: len(rows) // 5].tolist()) if len(rows) >= 50 else set()
    learn = [rows[i] for i in range(len(rows)) if i not in kept]
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, len(names)), dtype=np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    epochs = max(epochs, -(-least_steps // len(learn)))
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            buckets, y = learn[i]
            if len(buckets) > 300:  # a random part of the text for each step
                buckets = buckets[rng.integers(0, len(buckets), rng.integers(20, 300))]
            mean = table[buckets].mean(axis=0)
            error = _softmax((mean @ layer + bias)[None, :])[0]
            error[y] -= 1.0
            step = np.float32(rate * (1 - done / steps) * 0.1)
            back = layer @ error
            layer -= step * np.outer(mean, error)
            bias -= step * 0.1 * error
            np.subtract.at(table, buckets, (step / len(buckets) * back * 3)[None, :])
            done += 1
    model = Model(names, (table @ layer).astype(np.float32), bias.astype(float))
    _calibrate(model, [rows[i] for i in kept] or rows)
    return model


def _calibrate(model: Model, rows: list[tuple[np.ndarray, int]]) -> None:
    z = np.array([model.scores[s].mean(axis=0, dtype=np.float64) + model.bias for s, _ in rows])
    y = np.array([c for _, c in rows])
    loss = {t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.05, 5, 40)}
    model.temperature = float(min(loss, key=loss.get))
    p = _softmax(z / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    model.threshold = min(HIGHEST, float(right[int(MISSED * len(right))])) if len(right) else 0.0


def fit(
    rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    cap: int = 1000, piece: int = 250, most_pieces: int = 8, most_languages: int = 200,
) -> Model:
    """Train on a bounded sample: about ``cap`` rows of each language, fewer if there are more than
    ``most_languages``, each with at most ``most_pieces`` pieces of ``piece`` characters spread over the text."""
    rows = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).where(
        F.col("_text").isNotNull() & F.col("_lang").isNotNull() & F.col("_key").isNotNull()
    )
    sample = (
        balanced_sample(rows, "_lang", "_key", cap, most_languages)
        .select("_key", "_lang", F.array_join(pieces(F.col("_text"), piece, most_pieces), " ").alias("_text"))
        .toPandas().drop_duplicates("_text").sort_values("_key")
    )
    return train(sample["_text"].tolist(), sample["_lang"].tolist())


def identify(documents: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """Append a struct column: lang, score, rejected."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_OUT)
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score", "rejected"])

    return documents.withColumn(out, named(F.col(text)))
