"""URL filters by a cascade of Bloom filters: exact membership without joins.

Keys of a URL are its host, every parent domain of the host with two labels or more, and host/path. Level 0 holds the listed keys; level 1
the keys of the corpus that aren't listed but pass level 0; level 2 the listed keys that pass level 1, and so on until nothing passes wrongly. A
key's first level that lacks it decides, and the answer is exact for every key in the corpus's complete key universe. Building looks
at all distinct keys of the corpus; filtering tests bits only. A list of more than SHARD_KEYS keys is cut into shards by hash, each with a
cascade that fits in memory, and rows pass them one after another.

Defined results. A null or empty URL, or one without a host, has no keys and is never blocked. Case, port, user, query and fragment don't matter, nor do a dot
at the end of the host or slashes at the end of the path. Listed keys are read in the same way, so they may have a scheme, a port or a final slash; they may repeat, and null ones are ignored; an empty list blocks nothing. URLs of any
length are read whole. Repeated rows are kept. Only page_id and url are read by flag(); filter_pages() keeps all columns. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, free_name, table

#: A list of unwanted sites; any other list is a parameter.
LISTED = (
    "spam-farm.example.org", "cheap-pills.example.com", "casino-win.example.net", "free-prizes.example.com", "adult-cams.example.net", "malware-host.example.org",
    "clickbait.example.com", "link-farm.example.net", "fake-news.example.org", "torrent-hub.example.com", "phish-bank.example.net", "tiontion.example.net", "m.theron.example.net",
)
FIRST_RATE, NEXT_RATE, SHARD_KEYS, MOST_LEVELS = 0.01, 0.5, 2_000_000, 200
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def keys(url: Column) -> Column:
    """All keys of a URL, the host first."""
    low = F.lower(F.coalesce(url.cast("string"), F.lit("")))
    host = F.regexp_replace(F.regexp_extract(low, HOST, 1), r"\.+$", "")
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_replace(F.regexp_extract(low, PATH, 1), "/+$", "")
    whole = F.when(path != "", F.array(F.concat(host, path))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(parents, whole))


def listed_key(key: Column) -> Column:
    """A listed key as URLs' keys are: in lower case, without scheme, user, port, query, fragment, the host's last dot and the path's last slash."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.trim(key)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?", ""), r"[?#].*$", "")
    host, path = F.regexp_replace(F.substring_index(low, "/", 1), r"(:[0-9]*)?$", ""), F.regexp_extract(low, "^[^/]*(/.*)$", 1)
    return F.concat(F.regexp_replace(host, r"\.+$", ""), F.regexp_replace(path, "/+$", ""))


def hashes(key: Column) -> Column:
    """128 bits of a key."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class Bloom:
    def __init__(self, h1: np.ndarray, h2: np.ndarray, rate: float, level: int) -> None:
        n = max(1, len(h1))
        self.size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.k, self.level = max(1, round(self.size / n * math.log(2))), level
        bits = np.zeros(self.size, bool)
        for at in self._places(h1, h2):
            bits[at] = True
        self.bits = np.packbits(bits, bitorder="little")

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
        for i in range(self.k):
            x = (a ^ np.uint64(self.level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) + b * np.uint64(self.level * 31 + i + 1)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            yield ((x ^ (x >> np.uint64(29))) % np.uint64(self.size)).astype(np.int64)


    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for at in self._places(h1, h2):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def decide(levels: list[Bloom], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: whether the number of levels it passes in a row is odd."""
    listed, left = np.zeros(len(h1), bool), np.arange(len(h1))
    for level in levels:
        left = left[level.has(h1[left], h2[left])]
        listed[left] = ~listed[left]
    return listed


def _passing(level: Bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(level.has(b.column(1).to_numpy(), b.column(2).to_numpy())))

    return run


def build(universe: DataFrame, size: int, listed: DataFrame, shard: int = 0, shards: int = 1) -> list[Bloom]:
    """The cascade for the listed keys of a shard over all keys of the corpus; both have the columns key, h1 and h2."""
    own = F.pmod("h1", F.lit(shards)) == shard
    r = listed.filter(own).toArrow()
    if not r.num_rows:
        return []
    name = r["key"].to_pylist()
    r1, r2 = r["h1"].to_numpy(), r["h2"].to_numpy()
    # what passes level 0 wrongly comes to the driver: a larger universe gets a sharper filter, so that it stays within SHARD_KEYS
    levels = [Bloom(r1, r2, min(FIRST_RATE, SHARD_KEYS / max(1, size)), 0)]
    passed = universe.filter(own).mapInArrow(_passing(levels[0]), universe.schema)
    known = set(name)
    wrong1, wrong2 = [], []
    for batch in _batches(passed):
        no = [i for i, k in enumerate(batch["key"].to_pylist()) if k not in known]
        wrong1.append(batch["h1"].to_numpy()[no])
        wrong2.append(batch["h2"].to_numpy()[no])
    s1, s2 = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (wrong1, wrong2))
    inside, outside = (s1, s2), (r1, r2)  # keys that pass all levels so far and shouldn't, and those that then may be taken for them
    while len(inside[0]):
        if len(levels) == MOST_LEVELS:
            raise ValueError("keys with the same 128 bits can't be told apart")
        levels.append(Bloom(*inside, NEXT_RATE, len(levels)))
        hit = levels[-1].has(*outside)
        inside, outside = (outside[0][hit], outside[1][hit]), inside
    return levels


def _batches(df: DataFrame) -> Iterator[pa.Table]:
    t = df.toArrow()
    for i in range(0, t.num_rows, 1 << 16):
        yield t.slice(i, 1 << 16)


def _keyed(df: DataFrame) -> DataFrame:
    return df.filter("key IS NOT NULL AND key <> ''").select("key").distinct().withColumn("h", hashes(F.col("key"))).select("key", "h.h1", "h.h2")


def _blocked(levels: list[Bloom], shard: int, shards: int):
    """Over an array of a row's key hashes: whether one of them is listed. Only that column goes through Python."""

    @F.arrow_udf("boolean")
    def run(held: pa.Array) -> pa.Array:
        flat, n = held.flatten(), np.asarray(held.value_lengths().fill_null(0), np.int64)
        h1, h2 = flat.field("h1").to_numpy(zero_copy_only=False), flat.field("h2").to_numpy(zero_copy_only=False)
        hit = decide(levels, h1, h2) & (h1 % shards == shard)  # a cascade knows its own shard's universe only
        total = np.concatenate(([0], np.cumsum(hit)))
        end = np.cumsum(n)
        return pa.array(total[end] > total[end - n])

    return run


def _levels(pages: DataFrame, listed: DataFrame) -> list[tuple[list[Bloom], int, int]]:
    universe = cut(_keyed(pages.select(F.explode(keys(F.col("url"))).alias("key"))))
    rows = cut(_keyed(listed.select(listed_key(F.col("key").cast("string")).alias("key"))))
    shards = max(1, math.ceil(rows.count() / SHARD_KEYS))
    size = universe.count()
    out = [(build(universe, size, rows, s, shards), s, shards) for s in range(shards)]
    drop(universe)
    drop(rows)
    return out


def _any_listed(rows: DataFrame, held: str, pages: DataFrame, listed: DataFrame) -> Column:
    out = F.lit(False)
    for cascade in _levels(pages, listed):
        out = out | _blocked(*cascade)(F.col(held))
    return out


def flag(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, url, host and whether the page is blocked, for every row."""
    at = keys(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.transform(at, hashes).alias("keys"))
    host = F.coalesce(F.try_element_at(keys(F.col("url")), F.lit(1)), F.lit(""))
    return rows.select("page_id", "url", host.alias("host"), _any_listed(rows, "keys", pages, listed).alias("blocked"))


def filter_pages(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of pages that aren't blocked, with all columns."""
    held = free_name(pages, "__keys")
    rows = pages.withColumn(held, F.transform(keys(F.col("url")), hashes))
    return rows.filter(~_any_listed(rows, held, pages, listed)).drop(held)


def listed_sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in LISTED], "key string")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag(table(spark, sf_dir, "pages"), listed_sites(spark))


SQL = rf"""
WITH listed(k) AS (VALUES {', '.join(f"('{k}')" for k in LISTED)}),
a AS (SELECT CAST(page_id AS BIGINT) AS page_id, url, regexp_replace(regexp_extract(lower(coalesce(url, '')), '{HOST}', 1), '\.+$', '') AS host,
  regexp_replace(regexp_extract(lower(coalesce(url, '')), '{PATH}', 1), '/+$', '') AS path FROM pages)
SELECT page_id, url, host, EXISTS (SELECT 1 FROM listed WHERE host <> '' AND (host = k OR ends_with(host, '.' || k) OR host || path = k)) AS blocked FROM a"""
