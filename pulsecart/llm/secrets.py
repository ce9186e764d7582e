"""Secret scan by assignment-aware lexing.

Source and configuration text is read as pairs of a name and a literal: ``name = "x"``,
``name: x``, ``"name": "x"``, ``name := x``, ``name => x``, ``export NAME=x``. Constants are
propagated: a literal bound to a plain name counts for the names it is assigned to later
(``k = "x"`` and then ``password = k``), through ``+`` of literals and names too. A literal is
scored by the sensitivity of the names it reaches and by how little it looks like a word or a
placeholder; literals of ``LEAST`` or more are findings of kind ``literal``.

Three patterns with fixed meaning are found besides: ``assign``, ``access`` and ``hex``.

Spans count code points, end exclusive; a literal's span is that of its characters, without quotes,
where they are written. A span that a fixed pattern already has is not repeated as a literal.

Edge cases: null and empty texts have no spans. Names of any length and texts of any length are
read whole, in time that grows with the text, whatever is joined to what. Other columns pass through untouched.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsecart.llm.common import small_batches

KINDS = ("assign", "access", "hex", "literal")
LEAST = 0.6

# The three base patterns. A run of 32 or more hex digits is what is left of all runs
# when short ones are dropped; the same holds for access keys of 16 or more.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}", re.A)
_HEX = re.compile(r"[0-9a-f]{32,}", re.A)

# How far a part of a name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "private": 0.5, "key": 0.5,
    "bearer": 0.8, "signature": 0.5, "salt": 0.5, "pin": 0.4, "session": 0.4, "access": 0.3,
}
PLACEHOLDERS = {"changeme", "example", "password", "secret", "token", "none", "null", "true", "false", "todo", "xxxxxxxx"}

_LONGEST_PLACEHOLDER = max(map(len, PLACEHOLDERS))
MOST_CHARS = 256

# A name is read to its end and never given back, so that long ones take linear time.
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_VALUE = r"\"[^\"\n]*\"|'[^'\n]*'|[A-Za-z0-9+/_.=\-]+"
# A name before an operator; the lookbehind keeps a match from starting inside a word.
_PAIR = re.compile(rf"""(?<![A-Za-z0-9_.\-])["']?({_NAME})["']?(?:\[["']?({_NAME})["']?\])?[ \t]*(?::=|=>|=(?!=)|:(?![:/]))[ \t]*""", re.A)
_TERM = re.compile(rf"({_VALUE})(?:[ \t]*\+[ \t]*(?=[\"'A-Za-z_]))?", re.A)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.A)


def name_weight(name: str) -> float:
    """Sensitivity of a target name, 0 to 1, by its parts and by neighbouring parts together."""
    parts = [p.lower() for p in _PART.findall(name)]
    joined = parts + [a + b for a, b in zip(parts, parts[1:])]
    found = [SENSITIVE[p] for p in joined if p in SENSITIVE]
    return min(1.0, max(found) + 0.15 * (len(found) - 1)) if found else 0.0


@dataclass(slots=True)
class Value:
    """What the weight of a value needs, so that a joined value costs as much as its parts' characters differ."""

    length: float  # a float, as a value joined to itself over and over has no bound
    shares: dict[str, float]  # of the characters; those beyond MOST_CHARS different ones count as one
    digit: bool
    alpha: bool
    space: bool
    text: str | None  # kept as long as it may be a placeholder

    @classmethod
    def of(cls, text: str) -> "Value":
        counts = Counter(text)
        if len(counts) > MOST_CHARS:
            rest = sum(n for _, n in counts.most_common()[MOST_CHARS:])
            counts = Counter(dict(counts.most_common(MOST_CHARS))) + Counter({"": rest})
        return cls(
            len(text), {c: n / len(text) for c, n in counts.items()}, any(c.isdigit() for c in text),
            any(c.isalpha() for c in text), any(c.isspace() for c in text), text if len(text) <= _LONGEST_PLACEHOLDER else None,
        )

    def __add__(self, other: "Value") -> "Value":
        if not self.length or not other.length:
            return self if self.length else other
        length = min(self.length + other.length, 1e300)
        a = self.length / (self.length + other.length)
        shares = {c: p * a for c, p in self.shares.items()}
        for c, p in other.shares.items():
            c = c if c in shares or len(shares) <= MOST_CHARS else ""
            shares[c] = shares.get(c, 0.0) + p * (1 - a)
        short = self.text is not None and other.text is not None and length <= _LONGEST_PLACEHOLDER
        return Value(
            length, shares, self.digit or other.digit, self.alpha or other.alpha, self.space or other.space,
            self.text + other.text if short else None,
        )

    def weight(self) -> float:
        """How much it looks like a secret: long, of many different characters, no placeholder."""
        if self.length < 8 or (self.text or "").lower() in PLACEHOLDERS or self.space:
            return 0.0
        entropy = -sum(p * math.log2(p) for p in self.shares.values() if p)
        return min(1.0, entropy / 3.2) * (0.4 + 0.6 * (self.digit + self.alpha) / 2)


def value_weight(value: str) -> float:
    """How much a literal looks like a secret."""
    return Value.of(value).weight()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def literals(text: str) -> list[tuple[int, int, float]]:
    """Literals with the score of the most sensitive name that each reaches.

    A value is a literal or is joined from earlier values, which stay as they are when their name is bound
    anew. So values form a graph whose arcs lead to earlier ones, with one arc for each term in the text:
    scores are handed down along it once, at the end, and time is linear in the text.
    """
    bound: dict[str, int] = {}
    parts: list[tuple[int, ...]] = []  # of each value; none for a literal
    places: list[tuple[int, int]] = []
    known: dict[int, Value] = {}
    scores: dict[int, float] = {}

    def value_of(number: int) -> Value:
        open_values = [number]
        while open_values:
            top = open_values[-1]
            missing = [p for p in parts[top] if p not in known]
            if missing:
                open_values += missing
                continue
            open_values.pop()
            if top not in known:
                joined = [known[p] for p in parts[top]]
                known[top] = functools.reduce(operator.add, joined) if joined else Value.of(text[slice(*places[top])])
        return known[number]

    def added(own: tuple[int, ...], place: tuple[int, int] = (0, 0)) -> int:
        parts.append(own)
        places.append(place)
        return len(parts) - 1

    at = 0
    while (pair := _PAIR.search(text, at)) is not None:
        at = pair.end()
        name = pair[2] or pair[1]
        terms: list[int] = []
        pos = at
        while (term := _TERM.match(text, pos)) is not None:
            value, start = term[1], term.start(1)
            if value[0] in "\"'":
                terms.append(added((), (start + 1, start + len(value) - 1)))
            elif value in bound:
                terms.append(bound[value])
            else:
                terms.append(added((), (start, start + len(value))))
            pos = term.end()
            if pos == term.end(1):  # no plus sign follows
                break
        # A bare word may itself be the next name (a: b: c); quoted values are passed over.
        if terms and text[at : at + 1] in "\"'":
            at = pos
        if not terms:
            continue
        bound[name] = number = terms[0] if len(terms) == 1 else added(tuple(terms))
        if (weight := name_weight(name)) > 0:
            scores[number] = max(scores.get(number, 0.0), weight * value_of(number).weight())
    best: dict[tuple[int, int], float] = {}
    for number in range(len(parts) - 1, -1, -1):
        score = scores.get(number)
        if score is None:
            continue
        for part in parts[number]:
            scores[part] = max(scores.get(part, 0.0), score)
        start, end = places[number]
        if end > start:
            # A value without quotes is read again where it is itself a name; the best reading counts.
            best[start, end] = max(best.get((start, end), 0.0), score)
    return [(a, b, s) for (a, b), s in best.items()]


def all_spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """All spans by start, then kind: start, end, kind and score."""
    if not text:
        return []
    found = [(a, b, k, 1.0) for a, b, k in base_spans(text)]
    if "=" in text or ":" in text:
        taken = {(a, b) for a, b, _, _ in found}
        found += [(a, b, "literal", s) for a, b, s in literals(text) if s >= LEAST and (a, b) not in taken]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan(documents: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Append an array of spans: start, end, kind, score."""
    small_batches(documents.sparkSession)

    @F.pandas_udf("array<struct<start:int,end:int,kind:string,score:double>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                [[{"start": a, "end": b, "kind": k, "score": s} for a, b, k, s in all_spans(t)] for t in texts], dtype=object
            )

    return documents.withColumn(out, spans(F.col(text)))


def redact(documents: DataFrame, text: str = "text", secrets: str = "secrets", mark: str = "[secret]") -> DataFrame:
    """Replace every found span of the text by a mark; spans that overlap become one mark."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts, found):
            if t is None or spans is None or len(spans) == 0:
                out.append(t)
                continue
            parts, at, end = [], 0, -1
            for a, b in sorted((s["start"], s["end"]) for s in spans):
                if a >= end:
                    parts += [t[at:a], mark] if a > end or end < 0 else []
                end = max(end, b)
                at = end
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    small_batches(documents.sparkSession)
    return documents.withColumn(
        text, F.when(F.size(secrets) > 0, cleaned(F.col(text), F.col(secrets))).otherwise(F.col(text))
    )


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
