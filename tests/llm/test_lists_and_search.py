"""License blocks, URL lists and top-k search against plain Python."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from pulsecart.llm import licenses, search, urls

WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def license_texts():
    r = random.Random(6)
    pool = [w for t in licenses.TEMPLATES for w in t[1].split()] + ["the", "of", "prose", "éa", "MIT", "license", "mit-license", "lesser", "affero", "sa", "nc"]
    texts = [None, "", "...", "MIT LICENSE\nmit\tlicense mit. License", "Apache apache License", "general-public license", "x " * 30_000]
    for _ in range(300):
        own = r.choice(licenses.TEMPLATES)[1].split()
        for _ in range(r.randrange(5)):
            own[r.randrange(len(own))] = r.choice(pool)
        texts.append(" ".join(r.choices(pool, k=8)) + "\n" + " ".join(own) + r.choice(["", "\n\nend", " more words"]))
    return texts


def told(template, words):
    """Whether the words name the template's license and no longer name."""
    named, unless = [*template[2:], (), ()][:2]
    return set(named) <= words and not set(unless) & words


def test_license_scan_equals_plain_python(documents):
    texts = license_texts()
    sets = [(t, set(re.findall(WORDS, lowered(t[1])))) for t in licenses.TEMPLATES]
    got = licenses.scan(documents(texts)).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        words = re.findall(WORDS, lowered(text))
        places = sorted(
            (i, label) for p, label in licenses.PHRASES.items() for i in range(len(words))
            if words[i : i + len(p.split())] == p.split()
        )
        best = {}
        for line in (text or "").split("\n"):
            own = set(re.findall(WORDS, lowered(line)))
            for template, t in sets:
                c = len(own & t)
                if c >= math.ceil(0.8 * len(t) - 1e-9) and told(template, own):
                    best[template[0]] = max(best.get(template[0], 0), c / len(t))
        assert row["n_words"] == len(words)
        assert sorted((p["at"], p["label"]) for p in row["places"]) == places
        assert row["template_labels"] == sorted(best)
        assert row["score"] == max(best.values(), default=0.0)


def test_licenses_of_odd_tables(documents, make):
    assert licenses.scan(documents([]).limit(0)).count() == 0
    rows = [(1, "Released under the MIT License"), (1, "none"), (None, "MIT License"), (1, "none")]
    got = licenses.scan(make(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, len(r["places"]), len(r["template_labels"])) for r in got) == [(0, 1, 0), (1, 0, 0), (1, 0, 0), (1, 1, 1)]


MIT = """# Permission is hereby granted, free of charge, to any person obtaining
# a copy of this software and associated documentation files (the "Software"), to deal"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this */"""
GPL = """  This program is free software: you can redistribute it and/or modify
  it under the terms of the GNU General Public License as published by"""
BSD = """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that"""


def test_licenses_wrapped_over_lines(documents):
    scattered = MPL.replace(" ", " word" * 12 + "\n")  # all the words, but nowhere near each other
    got = licenses.scan(documents([MIT, MPL, GPL, BSD, ISC, "prose\n" * 5000 + BSD, scattered])).orderBy("doc_id").collect()
    assert [r["wrapped_labels"] for r in got] == [["mit"], ["mpl"], ["gpl"], ["bsd"], ["isc"], ["bsd"], []]
    assert [r["wrapped_score"] == 1.0 for r in got] == [True] * 6 + [False]


def test_license_runs_equal_plain_python(documents):
    texts = license_texts()
    got = licenses.scan(documents(texts)).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        words, want = re.findall(WORDS, lowered(text)), {}
        for template in licenses.TEMPLATES:
            own = re.findall(WORDS, lowered(template[1]))
            reach, whole, c = math.ceil(len(own) / 0.8 - 1e-9), set(own), 0
            for i in range(len(words)):
                near = set(words[i : i + reach])
                if told(template, near) and words[i] in whole | set(template[2] if len(template) > 2 else ()):
                    c = max(c, len(whole & near))
            if "\n" in (text or "") and c >= math.ceil(0.8 * len(whole) - 1e-9):
                want[template[0]] = max(want.get(template[0], 0), c / len(whole))
        assert row["wrapped_labels"] == sorted(want)
        assert row["wrapped_score"] == max(want.values(), default=0.0)


CONFUSABLE = [
    ("Licensed under the GNU General Public License, version 3", ["gpl"]),
    ("Licensed under the GNU Lesser General Public License", ["lgpl"]),
    ("Licensed under the GNU Lesser General Public License, version 3", ["lgpl"]),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", []),
    ("Licensed under CC BY-NC 4.0", ["cc-by-nc"]), ("Licensed under CC BY-SA 4.0", ["cc-by-sa"]), ("Licensed under CC BY-NC-SA 4.0", []),
    ("Released under the MIT License", ["mit"]), ("Released under the BSD License", []), ("Released under the Apache License", []),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", ["cc-by"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", []),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["mit"]),
]


def test_a_sentence_of_one_license_has_no_other_label(documents):
    texts = [t for t, _ in CONFUSABLE]
    got = licenses.scan(documents(texts)).orderBy("doc_id").collect()
    assert [r["template_labels"] for r in got] == [labels for _, labels in CONFUSABLE]
    # The same over lines, with other words around that belong to templates.
    wrapped = ["of the software and the terms\n" * 3 + t.replace(" ", "\n", 3) + "\nof the work" for t in texts]
    got = licenses.scan(documents(wrapped)).orderBy("doc_id").collect()
    assert [r["wrapped_labels"] for r in got] == [labels for _, labels in CONFUSABLE]


def test_word_counts(documents):
    texts = ["", "...", "a", " a", "a ", "-a-b-", "é ü", "x\x7fy", "a\nb\n"]
    counted = documents(texts).select("doc_id", licenses.count_words(F.col("text")).alias("n")).orderBy("doc_id").collect()
    assert [r["n"] for r in counted] == [len(re.findall(WORDS, t)) for t in texts]


BLOCK, ALLOW = [("net", "/"), ("example.com", "/de/"), ("a.b.example.org", "/x")], [("example.net", "/en/"), ("org", "/fr/")]


def url_samples():
    r = random.Random(7)
    hosts = ["example.net", "www.Example.net", "net", "anet", "example.com", "x.example.com", "q.org", "a.b.example.org", "bad-ads.example.io", "z.io", "", "a..net"]
    paths = ["", "/", "/en/", "/en", "/de/1", "/fr/a?b", "/x/y#z", "/xyz", "?q=/en/", "#/de/", "/ü/ñ"]
    yield from [None, "", "no scheme/net/", "://", "http://", "ftp://net/a://b/"]
    for _ in range(400):
        yield r.choice(["http", "https", ""]) + "://" + r.choice(hosts) + r.choice(paths)


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lowered(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(-len(h + p), h + p, v) for rules, v in ((BLOCK, "block"), (ALLOW, "allow")) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = min(fits)[1:] if fits else (None, "block" if re.search(r"(^|[.-])ads([.-]|$)", host) else "allow")
    return host, path, rule, verdict


def judged(make, limit=None):
    pages = make([(i, u) for i, u in enumerate(url_samples())], "page_id bigint, url string").withColumn("host", F.lit("clash"))
    rules = "host string, path string"
    return urls.judge(pages, make(BLOCK * 2, rules), make(ALLOW, rules), F.col("host").rlike(r"(^|[.-])ads([.-]|$)"))


def test_verdicts_equal_plain_python(make):
    got = judged(make).orderBy("page_id").collect()
    for row, url in zip(got, url_samples(), strict=True):
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == plain_verdict(url), url


CLASHES = ["_host", "_path", "_keys", "_block", "_allow", "_named", "__URL", "rest"]


def test_columns_of_any_name_pass_through(make, monkeypatch):
    pages = make([(i, u) for i, u in enumerate(url_samples())], "page_id bigint, url string")
    pages = pages.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    rules, named = "host string, path string", F.col("host").rlike(r"(^|[.-])ads([.-]|$)")
    for bits in (urls.MOST_BITS, 0):
        monkeypatch.setattr(urls, "MOST_BITS", bits)
        got = urls.judge(pages, make(BLOCK * 2, rules), make(ALLOW, rules), named).orderBy("page_id").collect()
        for row, url in zip(got, url_samples(), strict=True):
            assert (row["host"], row["path"], row["rule"], row["verdict"]) == plain_verdict(url)
            assert [row[c] for c in CLASHES] == [f"own {c}" for c in CLASHES]


def test_a_list_too_large_for_the_plan_is_joined(make, monkeypatch):
    want = sorted(judged(make).collect(), key=lambda r: r["page_id"])
    monkeypatch.setattr(urls, "MOST_BITS", 0)
    assert sorted(judged(make).collect(), key=lambda r: r["page_id"]) == want


def test_a_cascade_is_exact_for_its_universe(spark):
    universe = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("key % 7 = 0")
    test = urls.build_cascade(listed, universe)
    assert len(test.levels) > 1
    wrong = universe.where(test.has(F.col("key")) != (F.col("key") % 7 == 0))
    assert wrong.count() == 0
    assert urls.build_cascade(listed.limit(0), universe).levels == []


def test_empty_pages(make):
    rules = "host string, path string"
    pages = make([], "page_id bigint, url string")
    assert urls.judge(pages, make(BLOCK, rules), make([], rules)).count() == 0


def vectors():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 24))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=24)).tolist()) for i in range(500)]
    rows += [(500, None), (501, []), (502, [1.0, None]), (503, [float("nan")] * 24), (504, [float("inf")] * 24), (None, rows[0][1])]
    rows += [(600, rows[0][1]), (601, rows[0][1]), (700, [0.5, -0.5]), (800, [0.0] * 24)]
    return rows


def test_top_k_equals_plain_python(make, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)  # several blocks of queries
    rows = vectors()
    good = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in sorted(good):
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q)[:10]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(found)]
    got = search.top_k(make(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0, k=10)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_top_k_of_small_tables(make):
    schema = "vec_id bigint, embedding array<float>"
    assert search.top_k(make([], schema), F.col("vec_id") == 1).count() == 0
    two = search.top_k(make([(1, [1.0]), (2, [2.0])], schema), F.col("vec_id") == 1).collect()
    assert [tuple(r) for r in two] == [(1, 1, 2, 1024 * 2048)]


def test_texts_are_read_once_and_runs_are_tried_once(spark, documents, tmp_path):
    folder = str(tmp_path / "texts")
    documents([MIT, "prose " + GPL, "an MIT\nlicense", ISC.upper()]).write.parquet(folder)
    stored = spark.read.parquet(folder)
    assert not [f for f in licenses.scan(stored).inputFiles() if folder in f]
    plan = licenses.find_runs(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_max(transform(") == 1
