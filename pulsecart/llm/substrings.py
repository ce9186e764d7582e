"""Removal of repeated substrings by suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a row with a
smaller id, or earlier in the same row. Matches never cross rows.

1. Each window of ``length`` bytes has an anchor: the least hash among its short substrings, the
   leftmost of equal ones. Equal windows have equal anchors at the same place, wherever they are.
   Only anchors whose hash occurs again can have repeated windows; repeats within a batch of rows are
   seen there, and one of them is compared with the other batches.
2. The bytes that the windows of such an anchor cover are cut out as a fragment. Fragments go to
   shards by their anchor's hash, so equal windows meet in one shard. Equal fragments follow each
   other in sorted order: all but the earliest are repeats altogether.
3. For the anchors with different fragments a suffix array of a shard's fragments is induced, common
   prefixes are computed, and suffixes that share ``length`` bytes or more are one set, of which all
   but the earliest repeat.
4. The repeats of each row are merged to runs and taken out.

Shards are worked off in blocks of ``SHARD`` bytes; fragments with one anchor hash stay together, unless
they may be more than ``SHARD`` bytes. Such crowded hashes are counted before the fragments are dealt. Their
fragments are dealt by hash and content, so equal ones still meet; the windows of the different ones
meet by a 128-bit cryptographic hash of their bytes, one for each block, and all but the earliest repeat.

Edge cases: null and empty texts have no bytes. Texts shorter than ``length`` lose nothing. Rows with a
null id take no part: they lose nothing, and nothing is removed because of them. Ids are to be
unique; of rows that share one, all are cut by the runs found in any of them. Other columns are left
out of the result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsecart.llm.common import small_batches
from pulsecart.llm.suffixes import common_prefixes, suffix_array
from pulsecart.workspace import materialise, run_folder

SHARD = 2 << 20
ANCHOR = 20  # bytes of the substrings whose hashes are compared
BUCKETS = 1 << 16  # of anchor hashes, for a first count
_CHUNK = 4 << 20
_OPEN = 50_000  # windows of crowded hashes held at once
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = np.uint64(0x100000001B3)


def rolling(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of each substring of ``size`` bytes, by doubling."""
    out, width, total = None, 1, 0
    n = len(raw) - size + 1
    step, factor = raw.astype(np.uint64) + np.uint64(1), _FACTOR
    while True:  # step holds hashes of substrings of ``width`` bytes
        if size & width:
            if out is None:
                out, total = step[:n].copy(), width
            else:
                out = out * factor + step[total : total + n]
                total += width
        if width * 2 > size:
            break
        step = step[: len(step) - width] * factor + step[width:]
        width, factor = width * 2, np.uint64(pow(int(factor), 2, 1 << 64))
    out = (out ^ (out >> np.uint64(31))) * _ODD
    return out ^ (out >> np.uint64(29))


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows: hash, place, first and last window start that has the anchor."""
    found = []
    n = len(raw) - length + 1
    for lo in range(0, max(n, 0), _CHUNK):  # bounds the memory that a long text takes
        part = raw[lo : min(lo + _CHUNK, n) + length - 1]
        hashes = rolling(part, ANCHOR)
        width = length - ANCHOR + 1
        # The place is in the low bits, so the leftmost of equal hashes is least.
        keyed = (hashes & ~np.uint64((1 << 23) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        pad = -len(keyed) % width
        blocks = np.append(keyed, np.full(pad, np.iinfo(np.uint64).max)).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(keyed) - width + 1
        place = (np.minimum(back[:count], ahead[width - 1 : width - 1 + count]) & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], count) - 1
        found.append((hashes[place[first]], place[first] + lo, first + lo, last + lo))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)


def _anchor_rows(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Rows of hash, doc, window (first start, and number of starts, in one number), again, asks.

    ``again``: the hash occurs more than once in the batch. ``asks``: the row stands for its hash in
    the batch. Rows that neither occur again nor ask do not exist.
    """
    for frame in frames:
        hashes, docs, windows = [], [], []
        for doc, text in zip(frame["doc"].tolist(), frame["text"].tolist()):
            h, _, first, last = anchors(_bytes(text), length)
            hashes.append(h)
            docs.append(np.full(len(h), doc, dtype=np.int64))
            windows.append((first << 8) | (last - first + 1))
        if not hashes or not sum(map(len, hashes)):
            continue
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        h = h[order]
        fresh = np.append(True, h[1:] != h[:-1])
        size = np.diff(np.append(np.flatnonzero(fresh), len(h)))
        yield pd.DataFrame(
            {
                "hash": h.view(np.int64), "doc": np.concatenate(docs)[order], "window": np.concatenate(windows)[order],
                "again": np.repeat(size > 1, size), "asks": fresh,
            }
        )


def _fragments(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Cut the windows out of the texts: hash, fragment, doc, start, bytes.

    Of equal fragments in a batch the earliest goes to its shard. The others are repeats whatever the
    shard holds; they have no fragment and go anywhere, so a hot anchor does not gather them.
    """
    for frame in frames:
        frame = frame.sort_values("doc", kind="stable")
        out = {"hash": [], "fragment": [], "doc": [], "start": [], "bytes": []}
        seen: set[tuple[int, bytes]] = set()
        for doc, text, windows in zip(frame["doc"].tolist(), frame["text"].tolist(), frame["windows"].tolist()):
            raw = _bytes(text)
            whole = raw.tobytes()
            w = np.sort(np.asarray(windows, dtype=np.int64))
            first, hashes = w >> 8, _hash_of(raw, w >> 8, length).view(np.int64)
            for h, a, n in zip(hashes.tolist(), first.tolist(), (w & 255).tolist()):
                fragment = whole[a : a + n - 1 + length]
                fresh = (h, fragment) not in seen
                if fresh:
                    seen.add((h, fragment))
                out["hash"].append(h if fresh else doc)
                out["fragment"].append(fragment if fresh else None)
                out["start"].append(a)
                out["bytes"].append(len(fragment))
            out["doc"] += [doc] * len(w)
        yield pd.DataFrame(out)


def _hash_of(raw: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Anchor hash of the windows that start at the given places."""
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    h, _, starts, _ = anchors(raw, length)
    return h[np.searchsorted(starts, first)]


def repeats(fragments: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts, as doc and place, that repeat an earlier window of these fragments."""
    sizes = np.array([len(f) for f in fragments])
    raw = np.frombuffer(b"\0".join(fragments) + b"\0\0", dtype=np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    text = raw.astype(np.int64) + 2
    text[ends] = 1
    text[-1] = 0
    owner = np.repeat(np.arange(len(fragments)), sizes + 1)
    inner = np.arange(len(owner)) - np.repeat(ends - sizes, sizes + 1)
    room = np.append(sizes[owner] - inner, 0)
    sa = suffix_array(text)
    # Within the room there are bytes only, no marks.
    shared = common_prefixes(raw, sa, room)[sa] >= length
    # Sets of suffixes that share a prefix of the length.
    label = np.cumsum(~shared)
    in_set = shared | np.append(shared[1:], False)
    at = sa[in_set]
    label = label[in_set]
    doc, place = docs[owner[at]], starts[owner[at]] + inner[at]
    if not len(at):
        return doc, place
    # The earliest of each set by doc and place; the sets follow each other.
    fresh = np.append(True, label[1:] != label[:-1])
    first = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    leads = doc == np.minimum.reduceat(doc, first)[group]
    reach = np.where(leads, place, np.iinfo(np.int64).max)
    leads &= place == np.minimum.reduceat(reach, first)[group]
    one = np.flatnonzero(leads)
    later = np.ones(len(at), dtype=bool)
    later[one[np.append(True, group[one][1:] != group[one][:-1])]] = False
    return doc[later], place[later]


def _runs(docs: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> pd.DataFrame:
    """Merge ranges of each doc that touch or overlap."""
    order = np.lexsort((lows, docs))
    d, lo, hi = docs[order], lows[order], highs[order]
    if not len(d):
        return pd.DataFrame({"doc": d, "low": lo, "high": hi})
    fresh_doc = np.append(True, d[1:] != d[:-1])
    # Running maximum of ends within a doc: ends are shifted so that docs cannot mix.
    shift = np.cumsum(fresh_doc) * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + shift)
    fresh = fresh_doc | np.append(True, lo[1:] + shift[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    return pd.DataFrame({"doc": d[first], "low": lo[first], "high": np.maximum.reduceat(hi + shift, first) - shift[first]})


def _removals(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pd.DataFrame]:
    """From fragments sorted by hash, fragment, doc and start: ranges of bytes to remove. Ranges with a key are windows
    of crowded hashes, to be removed if an equal key is earlier."""
    block, own, size, open_hash, last = [], [], 0, None, None
    whole: list[tuple[int, int, int]] = []
    windows: dict[bytes, tuple[int, int]] = {}  # earliest of the windows held

    def opened() -> pd.DataFrame:
        docs = np.array([w[0] for w in windows.values()], dtype=np.int64)
        lows = np.array([w[1] for w in windows.values()], dtype=np.int64)
        return pd.DataFrame({"doc": docs, "low": lows, "high": lows + length, "key": list(windows)})

    def solved() -> pd.DataFrame:
        docs = np.array([b[1] for b in block], dtype=np.int64)
        starts = np.array([b[2] for b in block], dtype=np.int64)
        doc, place = repeats([b[0] for b in block], docs, starts, length) if block else (docs, starts)
        more = np.array(whole, dtype=np.int64).reshape(-1, 3)
        found = _runs(np.append(doc, more[:, 0]), np.append(place, more[:, 1]), np.append(place + length, more[:, 2]))
        return found.assign(key=None)

    def ranges() -> pd.DataFrame:
        nonlocal whole
        more, whole = np.array(whole, dtype=np.int64), []
        return _runs(more[:, 0], more[:, 1], more[:, 2]).assign(key=None)

    def close() -> None:
        """Windows that are equal have one anchor at one place in them, so an anchor with a single
        fragment has no windows to compare."""
        nonlocal size
        if len(own) > 1:
            block.extend(own)
            size += sum(len(f) for f, _, _ in own)
        own.clear()

    for batch in batches:
        for h, f, d, s, n, crowded in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("hash", "fragment", "doc", "start", "bytes", "crowded"))):
            if f is None or (h == open_hash and f == last):
                whole.append((d, s, s + n))
                continue
            if h != open_hash:
                close()
                if size > SHARD:
                    yield solved()
                    block, size, whole = [], 0, []
                open_hash = h
            last = f
            if not crowded:
                own.append((f, d, s))
                continue
            for i in range(len(f) - length + 1):
                key, here = hashlib.blake2b(f[i : i + length], digest_size=16).digest(), (d, s + i)
                known = windows.setdefault(key, here)
                if known is not here:
                    windows[key], later = min(known, here), max(known, here)
                    whole.append((later[0], later[1], later[1] + length))
            if len(windows) > _OPEN:
                yield opened()
                windows.clear()
            if len(whole) > 200_000:
                yield ranges()
        if len(whole) > 200_000:
            yield ranges()
    close()
    yield solved()
    if windows:
        yield opened()


def _removal_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """:func:`_removals` on Arrow batches: fragments are many and short, and frames of them are dear."""
    layout = pa.schema([("doc", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("key", pa.binary())])
    for found in _removals(batches, length):
        yield pa.RecordBatch.from_pandas(found, schema=layout, preserve_index=False)


def _crowded(found: DataFrame, length: int) -> DataFrame:
    """Anchor hashes whose fragments may be more than ``SHARD`` bytes together, equal ones included.

    Buckets of hashes are counted first, so few hashes are shuffled."""
    sizes = found.select("hash", (F.col("window").bitwiseAND(255) + length - 1).alias("bytes"))
    bucket = F.pmod(F.xxhash64("hash"), F.lit(BUCKETS))
    full = sizes.groupBy(bucket.alias("bucket")).agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > SHARD)
    full = materialise(full.select("bucket"), "buckets")
    counted = sizes.withColumn("bucket", bucket).join(full, "bucket", "left_semi").groupBy("hash").agg(F.sum("bytes").alias("bytes"))
    return materialise(counted.where(F.col("bytes") > SHARD).select("hash", F.lit(True).alias("crowded")), "crowded")


def _dealt(fragments: DataFrame, crowded: DataFrame) -> DataFrame:
    """Fragments by hash, those of crowded hashes by hash and content."""
    marked = fragments.join(crowded, "hash", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    by = F.when(F.col("crowded"), F.xxhash64("fragment")).otherwise(0)
    return marked.repartition("hash", by).sortWithinPartitions("hash", "fragment", "doc", "start")


def find(documents: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the id, text and ``runs``, the byte ranges to remove, in order."""
    spark = documents.sparkSession
    if not ANCHOR <= length <= ANCHOR + 200:
        raise ValueError(f"length must be from {ANCHOR} to {ANCHOR + 200}")
    small_batches(spark)
    rows = documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    # One copy of the texts by id serves both joins that follow, without another shuffle of texts.
    name = f"texts_{uuid.uuid4().hex[:12]}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.repartition(parts, "doc").write.bucketBy(parts, "doc").sortBy("doc")
        .option("path", run_folder(spark, "texts")).option("compression", "zstd").format("parquet").saveAsTable(name)
    )
    texts = spark.table(name)
    # The files stay where they are, and this frame knows them; only the name goes from the catalog.
    spark.sql(f"DROP TABLE {name}")
    layout = "hash bigint, doc bigint, window bigint, again boolean, asks boolean"
    anchored = texts.where(F.col("doc").isNotNull() & (F.octet_length("text") >= length)).mapInPandas(
        lambda f: _anchor_rows(f, length), layout
    )
    folder = run_folder(spark, "anchors")
    anchored.write.option("compression", "zstd").parquet(folder)
    found = spark.read.schema(layout).parquet(folder)
    asking = found.where("asks").select("hash", "doc", "window", "again")
    same = Window.partitionBy("hash").orderBy("doc")
    elsewhere = F.lag("doc").over(same).isNotNull() | F.lead("doc").over(same).isNotNull()
    across = asking.withColumn("elsewhere", elsewhere).where("elsewhere and not again").select("doc", "window")
    windows = found.where("again").select("doc", "window").union(across)
    by_doc = windows.groupBy("doc").agg(F.collect_list("window").alias("windows"))
    fragments = (
        texts.join(by_doc, "doc")
        .select("doc", "text", "windows")
        .mapInPandas(lambda f: _fragments(f, length), "hash bigint, fragment binary, doc bigint, start bigint, bytes bigint")
    )
    removed = materialise(
        _dealt(fragments, _crowded(found, length))
        .mapInArrow(lambda f: _removal_rows(f, length), "doc bigint, low bigint, high bigint, key binary"),
        "removals",
    )
    earlier = F.row_number().over(Window.partitionBy("key").orderBy("doc", "low"))
    equal = removed.where("key is not null").withColumn("number", earlier).where("number > 1")
    runs = removed.where("key is null").select("doc", "low", "high").union(equal.select("doc", "low", "high"))
    runs = runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("runs"))
    joined = texts.join(runs, "doc", "left")
    return joined.select(F.col("doc").cast(documents.schema[key].dataType).alias(key), "text", "runs")


def remove(found: DataFrame, text: str = "text", runs: str = "runs") -> DataFrame:
    """Append ``cut``: n_bytes, n_removed, the merged spans and the bytes that are kept."""
    small_batches(found.sparkSession)

    @F.pandas_udf("n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    def cut(texts: pd.Series, all_runs: pd.Series) -> pd.DataFrame:
        out = []
        for t, own in zip(texts, all_runs):
            whole = _bytes(t).tobytes()
            parts, at, spans, gone = [], 0, 0, 0
            end = -1
            for r in own if own is not None else ():
                low, high = r["low"], r["high"]
                if low > end:
                    spans += 1
                    parts.append(whole[at:low])
                    gone += high - low
                    at = end = high
                elif high > end:
                    gone += high - end
                    at = end = high
            out.append((len(whole), gone, spans, b"".join([*parts, whole[at:]])))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return found.withColumn("cut", cut(F.col(text), F.col(runs)))
