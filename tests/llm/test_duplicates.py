"""Near-duplicates, repeated substrings and benchmark items against brute force."""

import os
import random
import re

import numpy as np
import pytest

from pulsecart import workspace
from pulsecart.llm import decontaminate, neardup, substrings, suffixes

ODD = [None, "", " \t\n", "one", "one", "one two", "One  TWO", "a b c d e f g", "w " * 30_000]


def words(r, n, kinds=400):
    return [f"w{r.randrange(kinds)}" for _ in range(n)]


def edited(r, base, n):
    out = list(base)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def plain_components(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return [len(s) for s in sets], label


def near_texts():
    r = random.Random(8)
    base = words(r, 120)
    texts = [" ".join(edited(r, base, r.randrange(8))) for _ in range(150)]  # a large group of near copies
    texts += [" ".join(base)] * 40  # and of exact ones
    passage = words(r, 40)
    texts += [" ".join(words(r, 60) + passage + words(r, 60)) for _ in range(60)]  # a shared passage
    for _ in range(40):
        own = words(r, 80)
        texts += [" ".join(own), " ".join(edited(r, own, r.randrange(6)))]
    r.shuffle(texts)
    return ODD + texts


@pytest.mark.parametrize("small", [800, 20])
def test_components_equal_brute_force(documents, monkeypatch, small):
    """Also with small nodes, so that large nodes branch again and are dealt into blocks."""
    monkeypatch.setattr(neardup, "SMALL", small)
    texts = near_texts()
    got = neardup.classes(documents(texts, first=0), words=4, percent=80).orderBy("doc_id").collect()
    sizes, label = plain_components(texts, 4, 80)
    assert [r["n_shingles"] for r in got] == sizes
    assert [r["component_id"] for r in got] == label
    assert [r["kept"] for r in got] == [i == x for i, x in enumerate(label)]


def test_near_duplicates_of_odd_rows(make):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e"), (3, None)]
    got = neardup.classes(make(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [
        (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True),
    ]
    assert neardup.classes(make([], "doc_id bigint, text string")).count() == 0


def test_steps_write_few_files(spark, documents, monkeypatch):
    """Two for each core here, also where shuffles have many partitions that are not put together."""
    folders, made = [], workspace.run_folder
    monkeypatch.setattr(workspace, "run_folder", lambda s, label: folders.append((label, made(s, label))) or folders[-1][1])
    monkeypatch.setattr(neardup, "SMALL", 20)
    texts, changed = near_texts(), {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in changed}
    try:
        for name, value in changed.items():
            spark.conf.set(name, value)
        got = neardup.classes(documents(texts, first=0), words=4, percent=80).orderBy("doc_id").collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert [r["component_id"] for r in got] == plain_components(texts, 4, 80)[1]
    most = 2 * spark.sparkContext.defaultParallelism
    assert most < 40 and {"edges", "labels", "links", "groups", "nodes"} <= {label for label, _ in folders}
    files = [(len([f for f in os.listdir(folder) if f.endswith(".parquet")]), label) for label, folder in folders if label != "across"]
    assert max(files)[0] <= most, files


def test_suffix_array_and_common_prefixes():
    r = random.Random(3)
    for _ in range(150):
        k, n = r.choice([1, 2, 3]), r.randrange(1, 500)
        s = [r.randint(1, k) for _ in range(n)]
        if r.random() < 0.4:
            s = (s[: r.randint(1, 30)] * n)[:n]
        s.append(0)
        sa = suffixes.suffix_array(np.array(s))
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        room = len(s) - 1 - np.arange(len(s))
        common = suffixes.common_prefixes(np.array(s), sa, room)
        for a, b in zip(sa.tolist(), sa[1:].tolist()):
            want = 0
            while max(a, b) + want < len(s) - 1 and s[a + want] == s[b + want]:
                want += 1
            assert common[b] == want


def plain_cut(texts, length):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            piece = raw[s : s + length]
            if piece in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(piece)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone) if not g)))
    return out


@pytest.mark.parametrize("length", [100, 30])
def test_substrings_equal_brute_force(documents, length):
    r = random.Random(length)
    parts = [" ".join(words(r, 30, 60)) + "é" for _ in range(8)] + ["ab" * 90, "a" * 400, "\n" * 150]
    texts = [None, "", "short", *("".join(r.choice(parts) + r.choice(["", "x", "  "]) for _ in range(r.randrange(9))) for _ in range(120))]
    found = substrings.remove(substrings.find(documents(texts), length)).orderBy("doc_id").collect()
    got = [(r["cut"]["n_bytes"], r["cut"]["n_removed"], r["cut"]["n_spans"], bytes(r["cut"]["kept"])) for r in found]
    assert got == plain_cut(texts, length)


@pytest.mark.parametrize("shard", [500, 20_000])
def test_substrings_of_crowded_anchors(documents, monkeypatch, shard):
    """A phrase in many different surroundings: equal to brute force, also with copies and with windows that repeat."""
    monkeypatch.setattr(substrings, "SHARD", shard)
    r = random.Random(shard)
    phrase = "the boilerplate phrase of sixty bytes that many documents do"
    texts = [" ".join(words(r, 25)) + phrase + " ".join(words(r, 25)) for _ in range(300)]
    texts += [t[r.randrange(40) :] for t in texts[:60]] + texts[:20] + [phrase + "é" * 60 + phrase + "é" * 60]
    r.shuffle(texts)
    found = substrings.remove(substrings.find(documents(texts))).orderBy("doc_id").collect()
    got = [(r["cut"]["n_bytes"], r["cut"]["n_removed"], r["cut"]["n_spans"], bytes(r["cut"]["kept"])) for r in found]
    assert got == plain_cut(texts, 100)


def test_crowded_anchors_are_dealt_to_many_tasks(spark, make, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD", 5_000)
    found = make([(h, (5 << 8) | 81) for h in [7] * 100 + [8] * 3], "hash bigint, window bigint")
    crowded = substrings._crowded(found, 100)
    assert [r["hash"] for r in crowded.collect()] == [7]
    rows = [(h, bytes([i % 50, h]) * 60, i, 0, 120) for h in (7, 8) for i in range(100)]
    fragments = spark.createDataFrame(rows, "hash bigint, fragment binary, doc bigint, start bigint, bytes bigint")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = substrings._dealt(fragments, crowded).selectExpr("*", "spark_partition_id() AS part").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert len({r["part"] for r in dealt if r["hash"] == 7}) > 5 and len({r["part"] for r in dealt if r["hash"] == 8}) == 1
    assert all(len({r["part"] for r in dealt if (r["hash"], r["fragment"]) == x}) == 1 for x in {(r["hash"], r["fragment"]) for r in dealt})


def test_substrings_of_odd_rows(make):
    line = "x y z " * 40
    rows = [(None, line), (3, line), (3, line), (4, line), (5, None)]
    found = substrings.remove(substrings.find(make(rows, "doc_id bigint, text string"))).collect()
    assert len(found) == 5
    gone = {r["doc_id"]: r["cut"]["n_removed"] for r in found}
    assert gone[None] == 0 and gone[4] == len(line) and gone[5] == 0
    assert substrings.remove(substrings.find(make([], "doc_id bigint, text string"))).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_edit_end_equals_the_full_table():
    r = random.Random(2)
    for _ in range(1500):
        a = [r.randrange(4) for _ in range(r.randint(1, 9))]
        b = [r.randrange(4) for _ in range(r.randrange(15))]
        most = r.randrange(5)
        row = plain_distance(a, b[: len(a) + most])
        want = (min(row), row.index(min(row)))
        assert decontaminate.edit_end(a, b, most) == (want if want[0] <= most else None)


def test_items_are_found_up_to_the_distance(documents, make):
    r = random.Random(5)
    items = [words(r, r.randint(12, 50), 300) for _ in range(60)]
    table = make([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "..."), (None, "x")], "item_id bigint, text string")
    texts, want = [], []
    for i, item in enumerate(items * 3):
        own = list(item)
        for _ in range(r.randint(0, len(item) // 5)):
            p = r.randrange(len(own))
            kind = r.randrange(3)
            if kind == 0:
                own[p] = f"n{p}"
            elif kind == 1:
                own.insert(p, f"m{p}")
            else:
                own.pop(p)
        texts.append(" ".join(words(r, 40, 300) + [w.upper() + "," for w in own] + words(r, 20, 300)))
        want.append((i + 1, i % len(items)))
    texts += [None, "", " ".join(words(r, 3000, 300))]
    found = decontaminate.find_items(documents(texts), table).collect()
    pairs = {(x["doc_id"], x["item_id"]) for x in found}
    assert len([w for w in want if w in pairs]) >= 0.98 * len(want)
    for x in found:  # each row is confirmed by the full table
        own = re.findall(r"[a-z0-9]+", texts[x["doc_id"] - 1].lower())[x["start_word"] : x["start_word"] + x["n_words"]]
        item = items[x["item_id"]]
        assert plain_distance(item, own)[-1] == x["distance"] <= len(item) // 5
    held = documents(texts).where(decontaminate.holding(documents(texts), table)).select("doc_id").collect()
    assert {r["doc_id"] for r in held} == {d for d, _ in pairs}


def test_start_distances_equal_the_full_table():
    r = random.Random(3)
    for _ in range(500):
        a, b = [r.randrange(4) for _ in range(r.randint(1, 9))], [r.randrange(4) for _ in range(r.randrange(15))]
        want = [min(plain_distance(a, b[s:])) for s in range(len(b))]
        assert decontaminate.start_distances(a, b) == want


@pytest.mark.parametrize("size", [5, 6, 9, 12, 19, 30, 59, 120, 200])
def test_every_item_within_the_distance_is_found(size):
    """Recall by item length, with lost heads, lost tails and scattered edits at the threshold."""
    r = random.Random(size)
    items = [words(r, size, 150) for _ in range(12)]
    index, most = decontaminate.Index([(i, " ".join(t)) for i, t in enumerate(items)]), size // 5
    texts, owners = [], []
    for n, item in enumerate(items):
        for kind in ("head", "tail", "spread", "random"):
            own = list(item)
            if kind == "head":
                own = own[most:]
            elif kind == "tail":
                own = own[: size - most]
            elif kind == "spread":
                for e in range(most):
                    own[(2 * e + 1) * size // (2 * most)] = f"x{e}"
            else:
                for e in range(most):
                    p = r.randrange(len(own))
                    own[p : p + r.randrange(2)] = [f"y{e}"] * r.randrange(2)
            texts.append(" ".join(words(r, 25, 150) + own + words(r, 25, 150)))
            owners.append(n)
    found = {(d, n): (start, length, distance) for d, n, start, length, distance in index.find(texts)}
    assert all((d, n) in found for d, n in enumerate(owners))
    for d, n in list(enumerate(owners))[:12]:  # and the closest run, the first of such, as by brute force
        own, best = texts[d].split(), None
        for s in range(len(own)):
            if own[s] in items[n]:
                row = plain_distance(items[n], own[s : s + size + most])
                if best is None or min(row) < best[2]:
                    best = (s, row.index(min(row)), min(row))
        assert found[d, n] == best


def test_less_recall_takes_fewer_walks():
    r = random.Random(2)
    items = [(i, " ".join(words(r, 40, 400))) for i in range(30)]
    few, many = (decontaminate.Index(items, recall=x) for x in (0.5, 0.998))
    assert sum(len(g.walks) for g in few.groups) < sum(len(g.walks) for g in many.groups)
    texts = [t for _, t in items]
    assert {(d, n) for d, n, *_ in few.find(texts)} == {(i, i) for i in range(30)}  # what is unchanged is always found
    for recall in (0, 1):
        with pytest.raises(ValueError):
            decontaminate.Index(items, recall=recall)


def test_measured_recall_by_length():
    """Edited copies among other words: at least 0.9 for every length, whatever is edited."""
    rng = np.random.default_rng(4)
    for size in (5, 7, 11, 16, 24, 48, 59, 100, 200):
        items = [words(random.Random(f"{size} {i}"), size, 2000) for i in range(20)]
        index, found, due = decontaminate.Index([(i, " ".join(t)) for i, t in enumerate(items)]), 0, 0
        for i, item in enumerate(items):
            for copy in decontaminate.edited(np.arange(size), size // 5, rng, 12):
                own = [item[k] if k < size else "other" for k in copy.tolist()]
                text = " ".join(["before"] * 9 + own + ["behind"] * 9)
                due += 1
                found += any(n == i for _, n, *_ in index.find([text]))
        assert found >= 0.9 * due, (size, found, due)


def test_no_items_and_no_documents(documents, make):
    none = make([], "item_id bigint, text string")
    assert decontaminate.find_items(documents(["a b c"]), none).count() == 0
    assert decontaminate.find_items(documents([]).limit(0), make([(1, "a b")], "item_id bigint, text string")).count() == 0



def test_prefix_doubling_sorts_shared_places_only(monkeypatch):
    r = np.random.default_rng(3)
    s = np.concatenate([np.append(1, r.permutation(4000) + 2), np.full(600, 1), [0]]).astype(np.int64)
    sizes, argsort = [], np.argsort
    monkeypatch.setattr(suffixes.np, "argsort", lambda x, **k: sizes.append(len(x)) or argsort(x, **k))
    got = suffixes._doubled(s)
    assert got.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert sum(sizes) < 3 * len(s)


def test_long_common_prefixes_are_compared_by_words(monkeypatch):
    r = np.random.default_rng(4)
    own = r.integers(2, 200, 3000)
    s = np.concatenate([own, [1], own, [1, 0]])
    steps, flatnonzero = [], np.flatnonzero
    sa = suffixes.suffix_array(s)
    room = np.concatenate([np.arange(3000, -1, -1), np.arange(3000, -1, -1), [0]])

    class Counted(np.ndarray):
        def __getitem__(self, at):
            steps.append(1)
            return super().__getitem__(at)

    common = suffixes.common_prefixes(s.view(Counted), sa, room)
    rank = np.argsort(sa)
    for i in (0, 5, 2999, 3001, 3500):
        before = sa[rank[i] - 1]
        most = min(room[i], room[before])
        equal = next((k for k in range(most) if s[i + k] != s[before + k]), most)
        assert common[i] == equal
    assert len(steps) < 2000
