"""License scan by an exact set-similarity join, in DataFrame functions only.

A text block is a line; its set is its distinct words. A block has a template's label if it holds at
least ``threshold`` of the template's distinct words. All such blocks are found, and only these:

- Words are ordered by the number of blocks of the whole table that hold them, rarest first. Words of
  no template cannot add to a containment and are left out of the sets.
- Length filter: a block with fewer template words than the least number needed is out.
- Prefix filter: of the needed words at least one is among the template's first
  ``size - needed + 1`` words, and among the block's likewise. Blocks and templates are joined on
  these prefix words.
- Positional filter: a first common word at places i and j leaves room for
  ``1 + min(rest of the block, rest of the template)`` common words; fewer than needed is out.
- The pairs left are verified on the whole sets.

License texts are mostly wrapped, so runs of words are searched besides, whatever line breaks and
comment marks lie between: a text has a template's label too if some run of its words, at most as long
as the template divided by ``threshold``, holds as many of the template's words. A run's words are
words of its text, so the texts that hold enough anywhere are found by the same filters, with the whole
text as the block, and their runs are then tried from every template word on.

The templates are a parameter and their words travel in the plan; ``MOST_WORDS`` bounds them.

Sentences of different licenses may differ by a word or two, so that one holds enough words of the other. A template
may therefore name words that a block or run must hold besides (those that tell its license), and words that it must
not hold (those of a license whose name contains its own). Where one line holds both such licenses, the longer name
counts, and the shorter one is left to the phrases.

Each text is cut to words once. Of these only the template words are kept, by line and by place; they are counted
for the order, and lines and runs are both read from them. Texts without any of the prefix words are passed over.

Fixed phrases are found besides, as consecutive words of the whole text.

Edge cases: null texts are empty, with no words. A very long line is one block; a text of one line has
no other runs. Repeated rows get
the same result each; rows that share an id but not the text are kept apart. The result has the id
and its own columns only, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsecart.workspace import materialise

MOST_WORDS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Separators are ASCII characters other than letters and digits.
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Sentences by which well-known licenses are granted or named; the words that tell each from others;
# and words of licenses whose names contain its own.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License", ("mit",)),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
     ("gnu", "general", "public"), ("lesser", "library", "affero")),
    ("gpl", "Licensed under the GNU General Public License, version 3", ("gnu", "general", "public"), ("lesser", "library", "affero")),
    ("lgpl", "Licensed under the GNU Lesser General Public License", ("gnu", "lesser")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("attribution",),
     ("noncommercial", "sharealike", "noderivatives", "noderivs")),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("nc",), ("sa", "nd")),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("sa",), ("nc",)),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
Template = tuple  # label and sentence, then words that must stand with it, and words that must not


def lowered(text: Column) -> Column:
    """A-Z lowered; other letters stay. A text of ASCII characters only goes by the function for those."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_in(low: Column) -> Column:
    """Words of a lowered text in order."""
    return F.array_remove(F.split(low, _SEPARATORS), "")


def count_words(text: Column) -> Column:
    """Number of words: each, with what stands before it, becomes one character."""
    marks = "".join(c for c in map(chr, range(128)) if re.fullmatch(_SEPARATORS, c))
    each = F.regexp_replace(text, F.lit(f"{_SEPARATORS[:-1]}*+{_WORDS}+"), F.lit("x"))
    return F.length(F.rtrim(each, F.lit(marks))).cast("long")


def has_phrase(low: Column, phrases: dict[str, str] = PHRASES) -> Column:
    """True for lowered texts that may have a phrase."""
    ends = "|".join(p.rpartition(" ")[0].rpartition(" ")[2] + _SEPARATORS + p.rpartition(" ")[2] for p in phrases)
    any_last = F.lit(False)
    for last in sorted({p.rpartition(" ")[2] for p in phrases}):
        any_last = any_last | F.contains(low, F.lit(last))
    return any_last & low.rlike(f"(?:{ends})")


def places_in(words: Column, phrases: dict[str, str] = PHRASES) -> Column:
    """All places of the phrases among the words: an array of word number and label; none for null."""
    none = F.array().cast("array<struct<at:int,label:string>>")

    def places(phrase: str, label: str) -> Column:
        first, *rest = phrase.split(" ")

        def here(w: Column, i: Column) -> Column:
            fits = w == first
            for n, word in enumerate(rest, 1):
                fits = fits & F.coalesce(F.get(words, i + n) == word, F.lit(False))
            return F.when(fits, i)

        found = F.filter(F.transform(words, here), lambda i: i.isNotNull())
        return F.transform(found, lambda i: F.struct(i.cast("int").alias("at"), F.lit(label).alias("label")))

    return F.coalesce(F.concat(*[places(p, n) for p, n in phrases.items()]), none)


class _Index:
    """Templates as sets of words, the order of the words, and the join of blocks with templates."""

    def __init__(self, templates: list[Template], threshold: float):
        lower = str.maketrans(_UPPER, _LOWER)
        found = [(t, re.findall(_WORDS, t[1].translate(lower))) for t in templates]
        found = [(t, words) for t, words in found if words]
        self.labels = [t[0] for t, _ in found]
        self.sets = [sorted(set(words)) for _, words in found]
        self.named = [sorted(t[2]) if len(t) > 2 else [] for t, _ in found]
        self.unless = [sorted(t[3]) if len(t) > 3 else [] for t, _ in found]
        self.known = sorted({w for own in (*self.sets, *self.named, *self.unless) for w in own})
        if not 0 < len(self.known) <= MOST_WORDS:
            raise ValueError(f"templates must hold 1 to {MOST_WORDS} different words")
        self.needed = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        # Words that a run may have: every needed share of the template, with others between.
        self.reach = [math.ceil(len(words) / min(1.0, max(threshold, 0.1)) - 1e-9) for _, words in found]
        self.order = {w: i for i, w in enumerate(self.known)}

    def _prefixes(self) -> list[list[int]]:
        """Ranks of the prefix words of each template."""
        ranked = [sorted(self.order[w] for w in s) for s in self.sets]
        return [r[: len(r) - need + 1] for r, need in zip(ranked, self.needed)]

    def cut(self, documents: DataFrame, key: tuple[str, ...], text: str) -> DataFrame:
        """Texts cut to words: key, n_words, places (of the phrases), lines (distinct template words of each) and hits
        (places of template words; none in a text of one line).

        Each step is read more than once by the next, so that Spark takes it once for a text.
        """
        known = lambda w: w.isin(self.known)
        low = documents.select(*key, lowered(F.col(text)).alias("low"))
        by_line = low.select(*key, has_phrase(F.col("low")).alias("named"), F.transform(F.split("low", "\n"), words_in).alias("by_line"))
        in_order = by_line.select(*key, "named", "by_line", F.flatten("by_line").alias("words"))
        at = F.transform("words", lambda w, i: F.when(known(w), F.struct(i.alias("at"), w.alias("word"))))
        found = in_order.select(
            *key, F.size("words").cast("long").alias("n_words"), F.when(F.col("named"), F.col("words")).alias("words"),
            F.transform("by_line", lambda own: F.array_distinct(F.filter(own, known))).alias("lines"),
            F.when(F.size("by_line") > 1, F.filter(at, lambda x: x.isNotNull())).alias("hits"),
        )
        return found.select(*key, "n_words", places_in(F.col("words")).alias("places"), "lines", "hits")

    def texts(self, cut: DataFrame) -> DataFrame:
        """Cut texts with a prefix word of some template: no other text can hold one."""
        starts = {i for p in self._prefixes() for i in p}
        prefix = [w for w, i in self.order.items() if i in starts]
        return cut.where(F.exists("lines", lambda own: F.exists(own, lambda w: w.isin(prefix))))

    def lines(self, cut: DataFrame, key: tuple[str, ...]) -> DataFrame:
        """Key, block (line number) and distinct template words of each line of cut texts."""
        return cut.select(*key, F.posexplode("lines").alias("block", "words"))

    def rank_by(self, blocks: DataFrame) -> None:
        """Order the words by the number of blocks that hold them, rarest first."""
        counts = {
            r["word"]: r["count"]
            for r in blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect()
        }
        self.order = {w: i for i, w in enumerate(sorted(self.known, key=lambda w: (counts.get(w, 0), w)))}

    def pairs(self, blocks: DataFrame, kept: list[str]) -> DataFrame:
        """Blocks (with ``words``) and templates that hold enough common words: the kept columns, ranks and the
        template's columns, once for each pair."""
        index = []
        for n, (s, prefix) in enumerate(zip(self.sets, self._prefixes())):
            own = (sorted(self.order[w] for w in s), s, self.reach[n], self.named[n], self.unless[n])
            index += [(r, self.labels[n], n, j, self.needed[n], *own) for j, r in enumerate(prefix)]
        template_rows = blocks.sparkSession.createDataFrame(
            index,
            "rank int, label string, template int, j int, need int, template_ranks array<int>, template_words array<string>, reach int, "
            "named array<string>, unless array<string>",
        )
        starts, least = sorted({r[0] for r in index}), min(self.needed)
        in_order = F.array(*[F.lit(w) for w in sorted(self.order, key=self.order.get)])
        ranked = (
            blocks.where(F.size("words") >= least)
            .where(F.exists("words", lambda w: w.isin([w for w, i in self.order.items() if i in set(starts)])))
            .select(
                *kept, "words",
                F.array_sort(F.transform("words", lambda w: (F.array_position(in_order, w) - 1).cast("int"))).alias("ranks"),
            )
        )
        prefix = F.slice(F.col("ranks"), 1, F.size("ranks") - (least - 1))
        placed = F.filter(
            F.transform(prefix, lambda r, i: F.struct(r.alias("rank"), i.alias("i"))), lambda x: x["rank"].isin(starts)
        )
        common = F.array_intersect("ranks", "template_ranks")
        return (
            ranked.select(*kept, "words", "ranks", F.explode(placed).alias("p"))
            .select(*kept, "words", "ranks", F.col("p.rank").alias("rank"), F.col("p.i").alias("i"))
            .join(template_rows, "rank")
            .where(
                1 + F.least(F.size("ranks") - F.col("i") - 1, F.size("template_ranks") - F.col("j") - 1) >= F.col("need")
            )
            # A pair is met at each common word of both prefixes; the first one stands for it.
            .where((F.size(common) >= F.col("need")) & (F.array_min(common) == F.col("rank")))
            .where(F.size(F.array_except("named", "words")) == 0)
        )

    def blocks(self, lines: DataFrame, key: tuple[str, ...]) -> DataFrame:
        common = F.size(F.array_intersect("ranks", "template_ranks"))
        return (
            self.pairs(lines, [*key, "block"])
            .where(~F.arrays_overlap("unless", "words"))
            .select(*key, "block", "label", "template", (common / F.size("template_ranks")).alias("containment"))
            .distinct()
        )

    def runs(self, texts: DataFrame, key: tuple[str, ...]) -> DataFrame:
        texts = texts.where(F.col("hits").isNotNull()).select(*key, "hits")
        pairs = self.pairs(texts.withColumn("words", F.array_distinct(F.col("hits.word"))), [*key, "hits"])
        both = F.concat("template_words", "named", "unless")
        own = F.filter("hits", lambda x: F.array_contains(both, x["word"]))

        def held(x: Column, i: Column) -> Column:
            near = F.filter(F.slice(F.col("own"), i + 1, F.col("reach")), lambda y: y["at"] < x["at"] + F.col("reach"))
            words = F.array_distinct(F.transform(near, lambda y: y["word"]))
            right = (F.size(F.array_except("named", words)) == 0) & ~F.arrays_overlap("unless", words)
            return F.when(right, F.size(F.array_intersect("template_words", words))).otherwise(0)

        # As rows of their own: a condition on them would be pushed below, and try all runs of a text again for each word.
        most = F.filter(F.array(F.array_max(F.transform("own", held))), lambda n: n >= F.col("need"))
        return (
            pairs.select(*key, "label", "template", "template_words", "need", "reach", "named", "unless", own.alias("own"))
            .select(*key, "label", "template", F.size("template_words").alias("size"), F.explode(most).alias("most"))
            .select(*key, "label", "template", (F.col("most") / F.col("size")).alias("containment"))
        )


def find_blocks(
    documents: DataFrame, templates: list[Template] = TEMPLATES, threshold: float = 0.8,
    key: tuple[str, ...] = ("doc_id",), text: str = "text",
) -> DataFrame:
    """Blocks that hold a template: the key columns, block (line number), label, template, containment."""
    index = _Index(templates, threshold)
    lines = index.lines(index.cut(documents, key, text), key)
    index.rank_by(lines)
    return index.blocks(lines, key)


def find_runs(
    documents: DataFrame, templates: list[Template] = TEMPLATES, threshold: float = 0.8,
    key: tuple[str, ...] = ("doc_id",), text: str = "text",
) -> DataFrame:
    """Texts of several lines in which a run of words holds a template: the key columns, label, template, and the
    containment of the best run."""
    index = _Index(templates, threshold)
    cut = index.cut(documents, key, text)
    index.rank_by(index.lines(cut, key))
    return index.runs(index.texts(cut), key)


def scan(
    documents: DataFrame, templates: list[Template] = TEMPLATES, threshold: float = 0.8,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: id, n_words, places (of the phrases), labels and score of the templates that lines hold,
    and wrapped_labels and wrapped_score of those that runs of words across lines hold."""
    own = documents.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    index, keys = _Index(templates, threshold), (key, "_hash")
    # Texts are cut to words once; rows, order, lines and runs are all read from that.
    cut = materialise(index.cut(own, keys, "_text"), "license-words")
    rows = cut.select(*keys, "n_words", "places")
    index.rank_by(index.lines(cut, keys))
    texts = index.texts(cut)
    lines = index.lines(texts, keys)
    columns = [*keys, "label", "containment"]
    held = index.blocks(lines, keys).select(*columns, F.lit(False).alias("wrapped")).unionByName(
        index.runs(texts, keys).select(*columns, F.lit(True).alias("wrapped"))
    )

    def labels(wrapped: Column) -> Column:
        return F.sort_array(F.collect_set(F.when(wrapped, F.col("label"))))

    def score(wrapped: Column) -> Column:
        return F.max(F.when(wrapped, F.col("containment")))

    found = held.groupBy(F.col(key).alias("_key"), F.col("_hash").alias("_own")).agg(
        labels(~F.col("wrapped")).alias("template_labels"), score(~F.col("wrapped")).alias("score"),
        labels(F.col("wrapped")).alias("wrapped_labels"), score(F.col("wrapped")).alias("wrapped_score"),
    )
    joined = rows.join(found, rows[key].eqNullSafe(found["_key"]) & (rows["_hash"] == found["_own"]), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        key, "n_words", "places",
        F.coalesce("template_labels", none).alias("template_labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("wrapped_labels", none).alias("wrapped_labels"), F.coalesce("wrapped_score", F.lit(0.0)).alias("wrapped_score"),
    )
