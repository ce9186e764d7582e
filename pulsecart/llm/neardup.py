"""Near-duplicates by a chosen-path set similarity join over word shingles.

1. Each document becomes the set of its distinct shingles of ``words`` words (hashed to 64 bits) and a
   signature of ``TOKENS`` minwise tokens. Documents with equal sets are one class, and its smallest id
   stands for it; only these representatives go on.
2. Independent trees: at a node, one or two positions of the signature are chosen by a hash of the
   node, 1 / similarity of them on average, and a document goes to one child for each, named by its
   token there. A node of one document ends. A node of up to ``SMALL`` documents is compared
   exhaustively by signatures. A larger one branches again, up to ``DEEPEST`` times; what is still
   large then is compared in blocks of ``SMALL``, other ones in each tree.
3. Documents of a node that may be linked (by signature, with a wide margin) form a group. Groups are
   confirmed on the full sets, made again from the texts: documents not yet connected are compared,
   and one link per merge is kept.
4. Links give components. In a node that stayed large, documents outside its main component then meet
   all its documents, in blocks, by 3; so no link is lost to the blocks.
5. Copies take their representative's component.

A pair at the threshold shares a node in one tree with probability 0.84, and 0.6 three levels down; with
``TREES`` trees it is missed with a probability below 1e-6, and below 1e-3 three levels down.

Edge cases: null and empty texts and texts without words have an empty set and are linked with
nothing. With fewer words than a shingle has, the whole sequence is the one shingle. Rows with a null
id are never linked, have a null component and are kept. Rows that share an id count as one document
that has all their texts. Other columns are left out of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsecart.llm.common import small_batches
from pulsecart.llm.components import components
from pulsecart.workspace import materialise, write_tasks

TOKENS, TREES, SMALL, DEEPEST, OWN_GROUP = 64, 8, 800, 4, 256
#: Documents to a task, and rows of nodes of one document on average: by these the files of a step are few.
EACH, NODES = 20_000, 8
_MARGIN = 0.2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_MULTIPLIERS = np.random.default_rng(17).integers(1, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)
# White space that ends a word, and A-Z lowered.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += np.uint64(0x20)
_powers: dict[int, np.ndarray] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), np.uint64(base % (1 << 64)), dtype=np.uint64)
        known[0] = 1
        _powers[base] = known = np.multiply.accumulate(known)
    return known[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[raw] + np.uint64(1)) * _geometric(_BASE, len(raw)), out=sums[1:])
    one = _mix((sums[ends] - sums[starts]) * _geometric(pow(_BASE, -1, 1 << 64), len(raw) + 1)[starts])
    n = min(words, len(one))
    rolled = np.full(len(one) - n + 1, np.uint64(n), dtype=np.uint64)
    for i in range(n):
        rolled = _mix(rolled * _ODD + one[i : len(one) - n + 1 + i])
    return np.unique(rolled)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least value of each of the hash functions."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[lo : lo + 2048, None] * _MULTIPLIERS).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _features(documents: DataFrame, words: int, key: str, text: str) -> DataFrame:
    small_batches(documents.sparkSession)

    @F.pandas_udf("n_shingles bigint, print binary, tokens array<int>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t, words) for t in texts]
            yield pd.DataFrame(
                {
                    "n_shingles": [len(s) for s in sets],
                    "print": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "tokens": [signature(s) if len(s) else None for s in sets],
                }
            )

    return documents.select(F.col(key).alias("doc"), made(F.col(text)).alias("f")).select("doc", "f.*")


def _children(node: Column, similarity: float) -> Column:
    """Names of the nodes below a node that a document with ``tokens`` goes to."""

    def child(n: int) -> Column:
        at = F.pmod(F.xxhash64(node, F.lit(n)), F.lit(TOKENS)).cast("int")
        return F.xxhash64(node, at, F.get("tokens", at))

    second = F.pmod(F.xxhash64(node, F.lit(0)), F.lit(1 << 20)) < int((1 / similarity - 1) * (1 << 20))
    return F.when(second, F.array_distinct(F.array(child(1), child(2)))).otherwise(F.array(child(1)))


def _nodes(points: DataFrame, similarity: float, tasks: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of doc and node for all nodes of 2 to SMALL documents and for blocks of larger ones; and
    rows of doc, node and size for the larger ones, if there are any."""
    roots = F.array(*[F.xxhash64(F.lit("tree"), F.lit(t)) for t in range(TREES)])
    active = points.select("doc", "tokens", F.explode(roots).alias("node"))
    ended, large = [], None
    for depth in range(1, DEEPEST + 1):
        below = active.select("doc", F.explode(_children(F.col("node"), similarity)).alias("node")).distinct()
        below = materialise(below, "nodes", tasks)
        sizes = below.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        sized = materialise(below.join(sizes, "node"), "sized-nodes", tasks)
        ended.append(sized.where(F.col("size") <= SMALL).select("doc", "node"))
        large = sized.where(F.col("size") > SMALL)
        if large.isEmpty():
            large = None
            break
        active = large.select("doc", "node").join(points, "doc")
    if large is not None:
        block = F.pmod(F.xxhash64("doc", "node"), F.ceil(F.col("size") / SMALL))
        ended.append(large.select("doc", F.xxhash64("node", block).alias("node")))
    out = ended[0]
    for more in ended[1:]:
        out = out.union(more)
    return out, large


def _across(large: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of doc and node that bring together what blocks of a large node have kept apart.

    In each large node, one component has most documents. Those of other components are the queries:
    in blocks of a quarter of SMALL they meet all documents of the node in blocks of three quarters,
    so no node is larger than SMALL. Documents of the main component need not meet each other.
    """
    known = large.join(found.withColumnRenamed("node", "doc"), "doc", "left").select(
        "doc", "node", "size", F.coalesce("component", "doc").alias("component")
    )
    counts = known.groupBy("node", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("node").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("all")).select(
        "node", F.col("m.component").alias("main"), (F.col("all") - F.col("m.n")).alias("others")
    )
    rows = known.join(main, "node").where("others > 0")
    ask, all_ = F.ceil(F.col("others") / (SMALL // 4)).cast("int"), F.ceil(F.col("size") / (3 * SMALL // 4)).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    mine = lambda n, seed: F.pmod(F.xxhash64("doc", "node", F.lit(seed)), n).cast("int")
    asking = rows.where("component <> main").select("doc", "node", mine(ask, 1).alias("a"), F.explode(every(all_)).alias("b"))
    asked = rows.select("doc", "node", F.explode(every(ask)).alias("a"), mine(all_, 2).alias("b"))
    return asking.union(asked).select("doc", F.xxhash64("node", "a", "b").alias("node")).distinct()


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component of each of n places under links between a and b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _groups(frames: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """From rows sorted by node: group and doc for documents that may be linked within a node."""

    def found(nodes: np.ndarray, docs: np.ndarray, marks: np.ndarray) -> pd.DataFrame:
        ones, others, lag = [], [], 1
        alive = np.arange(len(nodes))
        while True:
            alive = alive[alive + lag < len(nodes)]
            alive = alive[nodes[alive] == nodes[alive + lag]]
            if not len(alive):
                break
            for lo in range(0, len(alive), 1 << 16):
                some = alive[lo : lo + (1 << 16)]
                close = some[(marks[some] == marks[some + lag]).sum(axis=1) >= least]
                ones.append(close)
                others.append(close + lag)
            lag += 1
        if not ones:
            return pd.DataFrame({"group": [], "doc": []})
        a, b = np.concatenate(ones), np.concatenate(others)
        label = _least_labels(len(nodes), a, b)
        member = np.unique(np.concatenate([a, b]))
        leader = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(leader, label[member], docs[member])
        size = np.bincount(label[member], minlength=len(nodes))[label[member]]
        group = np.where(size <= OWN_GROUP, leader[label[member]], nodes[member])
        return pd.DataFrame({"group": group, "doc": docs[member]}).drop_duplicates()

    rest = None
    for frame in frames:
        rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if len(rest) < 4 * SMALL:
            continue
        nodes = rest["node"].to_numpy()
        cut = int(np.searchsorted(nodes, nodes[-1]))
        if cut:
            head, rest = rest.iloc[:cut], rest.iloc[cut:].reset_index(drop=True)
            yield found(head["node"].to_numpy(), head["doc"].to_numpy(), np.frombuffer(b"".join(head["marks"]), dtype=np.int16).reshape(-1, TOKENS))
    if rest is not None and len(rest):
        yield found(rest["node"].to_numpy(), rest["doc"].to_numpy(), np.frombuffer(b"".join(rest["marks"]), dtype=np.int16).reshape(-1, TOKENS))


def links_within(docs: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect the same documents as all pairs with 100 * common >= percent * union do."""
    n = len(docs)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros(int(shingle.max()) + 1, dtype=bool)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    comp, links = np.arange(n), []
    for i in range(n):
        other = comp != comp[i]
        other &= (100 * sizes >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes)
        if not other.any():
            continue
        own = shingle[begin[i] : begin[i + 1]]
        has[own] = True
        common = np.bincount(owner, weights=has[shingle], minlength=n).astype(np.int64) if n > 2 else np.array(
            [has[shingle[begin[j] : begin[j + 1]]].sum() for j in range(n)]
        )
        has[own] = False
        for j in np.flatnonzero(other & (100 * common >= percent * (sizes + sizes[i] - common))):
            if comp[j] != comp[i]:
                links.append((docs[i], docs[j]))
                comp[comp == comp[j]] = comp[i]
    return links


def _confirmed(frames: Iterator[pd.DataFrame], words: int, percent: int) -> Iterator[pd.DataFrame]:
    """From rows sorted by group: the links between documents of each group."""
    group, docs, sets = None, [], []
    for frame in frames:
        out = []
        for g, d, t in zip(frame["group"].tolist(), frame["doc"].tolist(), frame["text"].tolist()):
            if g != group:
                out += links_within(docs, sets, percent)
                group, docs, sets = g, [], []
            docs.append(d)
            sets.append(shingles(t, words))
        yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")
    yield pd.DataFrame(links_within(docs, sets, percent), columns=["u", "v"], dtype="int64")


def classes(
    documents: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: the id, n_shingles, component_id and kept."""
    spark = documents.sparkSession
    features = materialise(_features(documents, words, key, text), "shingle-features")
    tasks = write_tasks(spark, features.count(), EACH)
    first = features.where("doc is not null and n_shingles > 0").groupBy("print").agg(F.min("doc").alias("rep"))
    first = materialise(first, "first-of-class", tasks)  # read anew, so that the join can split a hot class
    members = materialise(
        features.join(first, "print", "left").select(
            "doc", "n_shingles", "rep", F.when(F.col("doc") == F.col("rep"), F.col("tokens")).alias("tokens")
        ),
        "shingle-classes", tasks,
    )
    points = members.where("tokens is not null").select(F.col("doc").cast("bigint").alias("doc"), "tokens")
    nodes, large = _nodes(points, percent / 100, tasks)
    marks = points.select("doc", _packed(F.col("tokens")).alias("marks"))
    least = int((percent / 100 - _MARGIN) * TOKENS)
    texts = documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where(F.length("text") > 0)

    def links(nodes: DataFrame, tasks: int) -> DataFrame:
        placed = nodes.join(marks, "doc").repartition("node").sortWithinPartitions("node")
        groups = materialise(
            placed.select("node", "doc", "marks").mapInPandas(lambda f: _groups(f, least), "group bigint, doc bigint").distinct(),
            "groups", tasks,
        )
        # Groups grow with the documents, so they are never broadcast, however small they look here.
        gathered = groups.hint("merge").join(texts, "doc").repartition("group").sortWithinPartitions("group", "doc")
        confirmed = gathered.select("group", "doc", "text").mapInPandas(
            lambda f: _confirmed(f, words, percent), "u bigint, v bigint"
        )
        return materialise(confirmed, "links", write_tasks(spark, groups.count(), EACH))

    first_links = links(nodes, tasks)
    found = components(first_links)
    if large is not None:
        across = materialise(_across(large, found), "across")  # may have many more rows than there are documents
        rows = across.count()
        if rows:
            found = components(first_links.union(links(across, write_tasks(spark, rows, NODES * EACH))))
    kind = documents.schema[key].dataType
    joined = members.join(found, members["rep"] == found["node"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce(F.col("component").cast(kind), F.col("rep"), F.col("doc")))
    return joined.select(
        F.col("doc").alias(key), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )


def _packed(tokens: Column) -> Column:
    """The low 16 bits of each token, as bytes."""

    @F.pandas_udf("binary")
    def low(batch: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(t, dtype=np.int32).astype(np.int16).tobytes() for t in batch], dtype=object)

    return low(tokens)
