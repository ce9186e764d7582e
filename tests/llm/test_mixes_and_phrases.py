"""Fill-in-middle, source mixing and collocations against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import check
from pulsecart.llm import fim, mixing, phrases, queries

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", "\t\n \x0b", "a", " a ", "a b c \x1f d", "é 😀 ß\n", "x <P> y", "<M>", "one two  three\n\nfour ", "w " * 40_000, "long" * 60_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(key, text):
    tokens = TOKENS.findall(text or "")
    digest = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    a, b, c = ("".join(x) for x in (tokens[:low], tokens[low:high], tokens[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text or ""
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(tokens), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def fim_texts():
    r = random.Random(11)
    words = ["a", "bc", "déf", "<", "<P", "S>", "😀", "x" * 300]
    return ODD + ["".join(r.choice(words) + r.choice([" ", "  ", "\n", "\t "]) for _ in range(r.randrange(1500))) for _ in range(60)]


@pytest.mark.parametrize("error", [1, 7, fim.ERROR, 126])
def test_cuts_equal_plain_python(documents, error):
    texts = fim_texts()
    rows = fim.transform(fim.index(documents(texts, first=0), error=error))
    restored = fim.restored(F.col("fim.output"), F.col("fim.form"))
    for row in rows.select("doc_id", "rank_index.n", "fim.*", restored.alias("restored")).collect():
        want = plain_fim(row["doc_id"], texts[row["doc_id"]])
        assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["output"]) == want
        assert row["restored"] == (texts[row["doc_id"]] or "")


def test_every_boundary_is_stored_within_the_error():
    r = np.random.default_rng(3)
    for sizes in ([1], r.integers(1, 9, 5000), r.integers(1, 9, 2000) ** 4, np.r_[np.ones(3000), 10**7, np.ones(3000)], [5] * 4000):
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        for error in (1, 100):
            starts, slopes, residuals = fim.fit(offsets, error)
            assert np.abs(residuals).max() <= error + 1
            segment = np.searchsorted(starts, np.arange(len(offsets)), side="right") - 1
            guess = offsets[starts[segment]] + np.floor(slopes[segment] * (np.arange(len(offsets)) - starts[segment])).astype(np.int64)
            assert (guess + residuals == offsets).all()
    assert len(fim.fit(np.arange(100_000) * 5, 100)[0]) == 1  # one line covers it


def test_every_rank_is_found_by_the_index(documents):
    text = " ".join("y" * (1 + i * i % 37) for i in range(3000)) + "  "
    rows = fim.index(documents([text])).select("rank_index", F.explode(F.sequence(F.lit(0), F.col("rank_index.n"))).alias("rank"))
    got = {r["rank"]: r["at"] for r in rows.select("rank", fim.offset_of(F.col("rank_index"), F.col("rank")).alias("at")).collect()}
    assert [got[i] for i in range(len(got))] == fim.boundaries(text).tolist()


def test_fim_of_odd_tables(documents, make):
    assert fim.transform(fim.index(documents([]).limit(0))).count() == 0
    rows = make([(None, "a b c")] * 2 + [(3, "a b")] * 2, "doc_id bigint, text string").withColumn("fim", F.lit("clash"))
    got = fim.transform(fim.index(rows)).select("doc_id", "fim.*").collect()
    assert len(got) == 4 and [r["form"] for r in got if r["doc_id"] is None] == ["plain"] * 2
    assert len({tuple(r) for r in got if r["doc_id"] == 3}) == 1
    with pytest.raises(ValueError):
        fim.index(rows, error=127)


# -- mixing --------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1)):
    """Shares by repeated dealing of what full sources cannot take."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in full)
        rest = left - sum(2 * sizes[s] for s in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


MIXED = "doc_id bigint, text string, source string"


def mixed_rows(r, counts):
    rows, n = [], 0
    for source, count in counts.items():
        for _ in range(count):
            rows.append((n, " ".join(["w"] * r.choice([0, 1, 3, 3, 3, 50, r.randrange(400)])), source))
            n += 1
    return rows


@pytest.mark.parametrize("counts", [{"a": 400, "b": 60, "c": 5, None: 30}, {"b": 3, "é": 500, "z": 20, "zz": 1, "zzz": 40}, {None: 70}])
@pytest.mark.parametrize("cell", [mixing.CELL, 7])
def test_mix_comes_near_the_targets(make, counts, cell):
    rows = mixed_rows(random.Random(12), counts)
    docs = make(rows, MIXED)
    got = mixing.sample(docs, cell=cell).collect()
    assert sorted(r["doc_id"] for r in got) == [d for d, _, _ in rows]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken, longest = plain_targets(sizes), Counter(), max(len(t.split()) for _, t, _ in rows)
    for r in got:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
        expected = want[r["source"]] / max(1, sizes[r["source"]])
        assert r["copies"] in (int(expected), int(expected) + 1) or expected == 2
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * longest
    again = {(r["doc_id"], r["copies"]) for r in mixing.sample(docs.repartition(5), cell=cell).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}


def test_cells_do_not_change_the_mix(make):
    docs = make(mixed_rows(random.Random(2), {"a": 300, "b": 100}), MIXED)
    one, many = ({tuple(r) for r in mixing.sample(docs, cell=c).collect()} for c in (mixing.CELL, 3))
    assert one == many


def test_mix_of_odd_tables(make, documents):
    assert mixing.sample(make([], MIXED)).count() == 0
    rows = [(1, None, "a"), (None, "x y", "a"), (None, "x y", None), (1, "x", "a"), (1, "x", "a"), (2, " \n", None)]
    got = mixing.sample(make(rows, MIXED)).collect()
    assert len(got) == 6 and sum(r["size"] for r in got) == 6
    assert {r["copies"] for r in mixing.sample(make([(1, None, "a"), (2, "", None)], MIXED)).collect()} == {0}


def test_emitted_documents(make):
    docs = make(mixed_rows(random.Random(5), {"a": 40, "b": 10}), MIXED)
    sampled = mixing.sample(docs)
    mix = mixing.emit(docs, sampled)
    assert mix.columns == [*docs.columns, "copy"]
    assert mix.count() == sampled.agg(F.sum("copies")).first()[0]
    assert mix.select("doc_id", "copy").distinct().count() == mix.count()


def test_word_counts(documents):
    texts = [t for t in fim_texts() if t is not None]
    got = documents(texts, first=0).select("doc_id", mixing.n_words(F.col("text")).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in enumerate(texts)}


# -- collocations --------------------------------------------------------------------------------


def lowered(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def plain_collocations(rows, most=2000):
    f, n = Counter(), Counter()
    for t, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= 10}
    covered = {}
    for p, a in candidates.items():
        if len(p) == 4:
            for q in (p[:3], (p[0], *p[2:])):
                covered[q] = max(covered.get(q, 0), a)
    found = {}
    for p, a in candidates.items():
        if 100 * covered.get(p, 0) >= 50 * a:
            continue
        cuts = [(1_000_000 * a * a // (f[p[: k + 1]] * f[p[0], *p[k + 1 :]]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        found.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[p[0], *p[k + 1 :]]))
    return [
        (lang, i, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, rows in found.items() for i, (score, a, phrase, left, right) in enumerate(sorted(rows)[:most], 1)
    ]


def phrase_rows():
    r = random.Random(13)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "ß", "A", "a b", "😀", "-", "'"]
    rows = [(None, "en"), ("", None), (" .,;\n", "en"), ("the the the the " * 3000, "fr"), ("big apple pie. " * 12, None), ("one", "en")]
    for i in range(150):
        words = [r.choice(vocabulary[: 8 + 15 * (i % 3)]) for _ in range(r.randrange(60))]
        rows.append(("".join(w + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for w in words), r.choice(["en", "fr", None])))
    return rows + [("A copied passage of several words, twice over. " * 3, "en")] * 40


@pytest.mark.parametrize("modulus", [1, 2, phrases.MODULUS, 1000])
def test_collocations_equal_plain_counts(make, modulus):
    rows = phrase_rows()
    got = phrases.collocations(make(rows, "text string, lang string").withColumn("n", F.lit("clash")), modulus=modulus).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_collocations(rows))


def test_collocations_with_a_full_filter_and_few_rows(make, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", 6)
    monkeypatch.setattr(phrases, "MOST_BITS", 6)
    rows = phrase_rows()
    got = phrases.collocations(make(rows, "text string, lang string"), most=5).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_collocations(rows, most=5))
    assert phrases.collocations(make([], "text string, lang string")).count() == 0


def test_chunks_cover_every_ngram_once():
    r = random.Random(1)
    text = ". ".join(" ".join(f"w{r.randrange(12)}" for _ in range(r.randrange(30))) for _ in range(200))
    for modulus in (1, 2, 5):
        ended, shared = phrases.parse(text.encode(), phrases.Hasher(1), modulus)
        found = Counter()
        for chunk, closed in [(c, 0) for c in ended] + [(c, 1) for c in shared]:
            w = chunk.decode().split(" ")
            for i in range(len(w) - 2 * closed):
                found.update(tuple(w[i : i + k]) for k in (1, 2, 3) if i + k <= len(w))
        want = Counter()
        for piece in text.split("."):
            w = piece.split()
            for k in (1, 2, 3):
                want.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        assert found == want


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_hashes_of_words(seed, monkeypatch):
    monkeypatch.setattr(phrases, "_BLOCK_BYTES", 50)
    r = random.Random(seed)
    words = [("".join(r.choice("abé") for _ in range(r.randrange(1, 9))), ".")[r.randrange(9) == 0].encode() for _ in range(3000)] + [b"x" * 500]
    text = b" " + b"  ".join(words) + b" "
    begins, finishes, ids = phrases.Hasher(seed).words(text)
    assert [text[a:b] for a, b in zip(begins, finishes)] == words
    assert len(set(zip(ids.tolist(), words))) == len(set(words)) == len(set(ids.tolist()))
    assert all((h == 0) == (w == b".") for h, w in zip(ids, words))
    assert [len(x) for x in phrases.Hasher(seed).words(b"")] == [0, 0, 0]


def test_words_of_one_hash_are_counted_with_another(make):
    """Two words whose polynomials are equal for every odd base."""
    b, d = "a", "b"
    for _ in range(11):
        b, d = b + d, d + b
    rows = [(f"x {b} y. x {d} y. " * 12, "en")]
    assert phrases.Hasher(1).words(b.encode())[2] == phrases.Hasher(1).words(d.encode())[2]
    got = phrases.collocations(make(rows, "text string, lang string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_collocations(rows))


def test_large_counts_stay_exact(spark):
    a, left, right = 3 * 10**13 + 1, 5 * 10**13 + 7, 9 * 10**13 + 11
    row = spark.range(1).select(phrases._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row["s"] == 10**6 * a * a // (left * right)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_mixing", "op13_collocations"])
def test_queries_have_sql(name):
    assert name in queries.SQL and name in queries.QUERIES and check
