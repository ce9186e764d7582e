"""URL filters by Bloom filter cascades, in DataFrame functions only.

A list is a set of keys; a key is a host, or a host with the beginning of a path. The keys that a
url can have are the suffixes of its host by labels, each with the path's beginnings of the lengths
that occur in the lists. All keys of all urls are the universe. Level 0 of a cascade is a Bloom
filter of the listed keys; level 1 holds the keys of the universe that level 0 takes for listed by
mistake, level 2 the listed keys that level 1 takes for those, and so on until no mistake is left.
A key of the universe is listed if the first level that lacks it is an odd one. This is exact for
the universe, and no url is joined with a list.

The bits of a cascade grow with the list and the logarithm of universe over list. They travel in the
plan up to ``MOST_BITS``; a larger list is looked up by a join on the universe's keys instead.

Edge cases: null urls and urls without ``://`` have an empty host and path and match nothing. A path
must start with the rule's path as it is written; an empty path fits no rule with a path. Repeated
urls and repeated rules change nothing. Among rules of equal length the smaller text wins. Other columns
pass through, but for ones named like the four results, which are replaced.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsecart.workspace import materialise

MOST_BITS = 1 << 26
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_keys(host: Column, path: Column, lengths: list[int], depth: int) -> Column:
    """Keys of a url: the whole host and its suffixes of up to ``depth`` labels, each with the
    beginnings of the path that have one of the lengths."""
    labels = F.split(host, r"\.")
    short = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(depth), F.size(labels))),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    suffixes = F.array_distinct(F.concat(F.array(host), short))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(
        F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substring(path, F.lit(1), n))))
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


@dataclass
class Level:
    """One Bloom filter: its words of 64 bits, its bit and hash counts, and the number of its seed."""

    words: list[int]
    bits: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed * 64 + j)), F.lit(self.bits)) for j in range(self.hashes)]

    def has(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")  # folded into one constant
        test = F.lit(True)
        for at in self.positions(key):
            test = test & (F.getbit(F.get(words, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
        return test


def build_level(keys: DataFrame, n: int, hashes: int, seed: int) -> Level:
    """Bloom filter of a column ``key`` with about n values."""
    bits = max(64, math.ceil(n * hashes / math.log(2)))
    level = Level([], bits, hashes, seed)
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("at"))
    rows = (
        at.groupBy(F.floor(F.col("at") / 64).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")).alias("bits"))
        .collect()
    )
    level.words = [0] * (bits // 64 + 1)
    for row in rows:
        level.words[row["word"]] = row["bits"]
    return level


@dataclass
class Cascade:
    levels: list[Level]

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(self.levels[i].has(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer if self.levels else F.lit(False)


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 0) -> Cascade | None:
    """Cascade of the listed keys that occur in the universe; both have one column ``key`` of distinct
    values. None if its first level would exceed ``MOST_BITS``."""
    mine = materialise(listed.join(universe, "key", "left_semi"), "listed")
    n, everything = mine.count(), universe.count()
    if n == 0:
        return Cascade([])
    hashes = max(1, math.ceil(math.log2(max(2.0, everything / n))))
    if n * hashes / math.log(2) > MOST_BITS:
        return None
    levels, inside, outside = [], mine, universe.join(mine, "key", "left_anti")
    while n:
        level = build_level(inside, n, hashes if not levels else 1, seed + len(levels))
        levels.append(level)
        wrong = materialise(outside.where(level.has(F.col("key"))), "mistaken")
        inside, outside, n = wrong, inside, wrong.count()
    return Cascade(levels)


def judge(
    pages: DataFrame, block: DataFrame, allow: DataFrame, listed_hosts: Column | None = None, url: str = "url",
) -> DataFrame:
    """Append host, path, rule and verdict.

    ``block`` and ``allow`` are rules with columns host and path; the longest rule that fits decides.
    Where none fits, a url is blocked if its host is one for which ``listed_hosts``, a condition on a
    column ``host``, is true; these hosts are a third list.
    """
    rules = {n: r.select(F.concat("host", "path").alias("key"), "host", "path").distinct() for n, r in (("block", block), ("allow", allow))}
    shape = rules["block"].union(rules["allow"]).agg(
        F.collect_set(F.length("path")).alias("lengths"), F.max(F.size(F.split("host", r"\."))).alias("depth")
    ).first()
    lengths, depth = sorted({0, *shape["lengths"]}), shape["depth"] or 1
    host, path = host_and_path(F.col(url))
    seen = pages.select(host.alias("_host"), path.alias("_path"))
    universe = materialise(
        seen.select(F.explode(url_keys(F.col("_host"), F.col("_path"), lengths, depth)).alias("key")).distinct(), "universe"
    )
    lists = {n: r.select("key") for n, r in rules.items()}
    if listed_hosts is not None:
        hosts = seen.select(F.col("_host").alias("host")).where(F.col("host") != "").distinct()
        lists["named"] = hosts.where(listed_hosts).select(F.col("host").alias("key"))
    tests = {n: build_cascade(keys, universe, seed=100 * i) for i, (n, keys) in enumerate(lists.items())}

    # Columns of its own have names that the pages do not have.
    mark = "_"
    while any(c.lower().startswith(mark) for c in pages.columns):
        mark += "_"
    own = url_keys(F.col(f"{mark}host"), F.col(f"{mark}path"), lengths, depth)
    out = pages.withColumns({f"{mark}host": host, f"{mark}path": path}).withColumn(f"{mark}keys", own)
    for name in ("block", "allow", "named"):
        test = tests.get(name, Cascade([]))
        if test is not None:
            out = out.withColumn(f"{mark}{name}", F.filter(f"{mark}keys", test.has))
        else:
            out = _looked_up(out, lists[name], url, mark, f"{mark}{name}")

    def ranked(found: str, verdict: str) -> Column:
        return F.transform(
            F.col(f"{mark}{found}"), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("rule"), F.lit(verdict).alias("verdict"))
        )

    best = F.array_min(F.concat(ranked("block", "block"), ranked("allow", "allow")))
    otherwise = F.when(F.size(f"{mark}named") > 0, "block").otherwise("allow")
    return out.select(
        *[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")],
        F.col(f"{mark}host").alias("host"), F.col(f"{mark}path").alias("path"), best["rule"].alias("rule"),
        F.coalesce(best["verdict"], otherwise).alias("verdict"),
    )


def _looked_up(pages: DataFrame, keys: DataFrame, url: str, mark: str, out: str) -> DataFrame:
    """The same by joins, for a list too large for the plan: distinct urls, their keys, the list."""
    rows = pages.select(F.col(url).alias(f"{mark}url"), F.col(f"{mark}keys").alias("keys")).distinct()
    found = (
        rows.select(f"{mark}url", F.explode("keys").alias("key")).join(keys, "key", "left_semi")
        .groupBy(f"{mark}url").agg(F.collect_set("key").alias(out))
    )
    joined = pages.join(found, pages[url] == found[f"{mark}url"], "left").drop(f"{mark}url")
    return joined.withColumn(out, F.coalesce(out, F.array().cast("array<string>")))
