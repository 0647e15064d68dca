"""URL rules, and exact membership of listed keys by a Bloom filter cascade.

Level 0 holds the listed keys; level 1 holds the other keys of the corpus that
level 0 wrongly claims; level 2 the listed keys that level 1 claims, and so on
until a level claims none. Over the universe it was built from the answer is
exact, with no join when urls are judged.

Keys are dealt to shards by hash and each shard has its own cascade, so no
filter grows beyond a bound; shards are judged in blocks of a bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import scramble, settle

#: Keys of a shard at most (on average), and bytes of filters that one pass broadcasts at most.
SHARD_KEYS, PASS_BYTES = 4_000_000, 32_000_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no '://'."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(host + path of the longest rule that fits or null, its action). A rule fits its host and all subdomains."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


class Cascade:
    """Filters of some shards: levels[shard] is a list of (bits as bytes, number of hashes)."""

    def __init__(self, levels: dict[int, list[tuple[bytes, int]]], n_shards: int):
        self.levels = {s: [(np.frombuffer(b, np.uint8), k) for b, k in x] for s, x in levels.items()}
        self.n_shards = n_shards

    def has(self, keys: np.ndarray) -> np.ndarray:
        """keys: 64-bit hashes. True for listed ones, False for others and for shards that are not here."""
        out = np.zeros(len(keys), bool)
        shards = shard_of(keys, self.n_shards)
        for s, levels in self.levels.items():
            left = np.flatnonzero(shards == s)
            inside = False  # what is known of the keys that are left
            for level, (bits, k) in enumerate(levels):
                hit = claims(bits, k, keys[left], level)
                out[left[~hit]] = inside
                left, inside = left[hit], not inside
            out[left] = inside
        return out


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (scramble(keys ^ np.uint64(0xA5A5)) % np.uint64(n)).astype(np.int64)


def positions(k: int, keys: np.ndarray, level: int, n_bits: int) -> Iterator[np.ndarray]:
    a = scramble(keys + np.uint64(2 * level + 1))
    b = scramble(a ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for i in range(k):
        yield ((a + np.uint64(i) * b) >> np.uint64(1)) % np.uint64(n_bits)


def claims(bits: np.ndarray, k: int, keys: np.ndarray, level: int) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for p in positions(k, keys, level, 8 * len(bits)):
        hit &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return hit


def _fill(level: int, rate: float):
    """applyInArrow over one shard's keys of a level: its filter."""

    def make(table: pa.Table) -> pa.Table:
        keys = np.asarray(table["h"].combine_chunks()).view(np.uint64)
        n_bits = 8 * math.ceil(max(64, -len(keys) * math.log(rate) / math.log(2) ** 2) / 8)
        k = max(1, round(n_bits / max(1, len(keys)) * math.log(2))) if rate < 0.5 else 1
        k = min(k, 16)
        bits = np.zeros(n_bits, np.uint8)
        for p in positions(k, keys, level, n_bits):
            bits[p] = 1
        data = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "level": pa.array([level], pa.int32()), "k": pa.array([k], pa.int32()), "bits": pa.array([data], pa.binary())})

    return make


def _judge(df: DataFrame, spark, filters: list[tuple[int, int, int, bytes]], n_shards: int, only_level: int | None = None) -> DataFrame:
    """Adds hit to (h, ...): membership by the whole cascade, or the claim of one level."""
    grouped: dict[int, list[tuple[bytes, int]]] = {}
    for s, _, k, b in sorted(filters):
        grouped.setdefault(s, []).append((b, k))
    sent = spark.sparkContext.broadcast((grouped, n_shards))
    schema = ", ".join([*(f"{c} {t}" for c, t in df.dtypes if c != "hit"), "hit boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, n = sent.value
        cascade = Cascade(levels, n)
        for batch in batches:
            h = np.asarray(batch.column(batch.schema.get_field_index("h"))).view(np.uint64)
            if only_level is None:
                hit = cascade.has(h)
            else:
                hit, shards = np.zeros(len(h), bool), shard_of(h, n)
                for s, x in cascade.levels.items():
                    own = np.flatnonzero(shards == s)
                    hit[own] = claims(x[0][0], x[0][1], h[own], only_level)
            if "hit" in batch.schema.names:
                hit = hit | np.asarray(batch.column(batch.schema.get_field_index("hit")), bool)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, c in enumerate(batch.schema.names) if c != "hit"), pa.array(hit)], names=[*(c for c in batch.schema.names if c != "hit"), "hit"])

    return df.mapInArrow(run, schema)


def _passes(filters: DataFrame) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """The filters in blocks of shards of at most PASS_BYTES (a shard's own are bounded by SHARD_KEYS)."""
    sizes = filters.groupBy("shard").agg(F.sum(F.length("bits")).alias("n")).orderBy("shard").collect()
    at = 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end]["n"] <= PASS_BYTES):
            total += sizes[end]["n"]
            end += 1
        yield [tuple(r) for r in filters.where(F.col("shard").between(sizes[at]["shard"], sizes[end - 1]["shard"])).select("shard", "level", "k", "bits").collect()]
        at = end


def build(universe: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame | None, int]:
    """Filters (shard, level, k, bits) for the keys (h bigint: 64-bit hashes) of listed within universe, and the number of shards.

    universe and listed hold a row a key. None if no key is listed.
    """
    spark = universe.sparkSession
    keys = settle(universe.select("h", F.lit(False).alias("listed")).unionByName(listed.select("h", F.lit(True).alias("listed"))).groupBy("h").agg(F.max("listed").alias("listed")), "cascade-keys")
    n_all, n_in = keys.agg(F.count("*"), F.coalesce(F.sum(F.col("listed").cast("long")), F.lit(0))).first()
    if not n_in:
        return None, 1
    n_shards = max(1, math.ceil(n_all / shard_keys))

    def sharded(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shard_of(np.asarray(b.column(0)).view(np.uint64), n_shards), pa.int32())], names=["h", "shard"])

        return df.select("h").mapInArrow(run, "h bigint, shard int")

    inside, outside = keys.where("listed"), keys.where(~F.col("listed"))
    rate = min(0.5, max(1e-4, 0.7 * n_in / max(1, n_all - n_in)))
    level, made = 0, []
    while True:
        filters = settle(sharded(inside).groupBy("shard").applyInArrow(_fill(level, rate if level == 0 else 0.5), "shard int, level int, k int, bits binary"), f"cascade-level{level}")
        made.append(filters)
        claimed = None
        for block in _passes(filters):
            one = _judge(outside.select("h"), spark, block, n_shards, level).where("hit").select("h")
            claimed = one if claimed is None else claimed.unionByName(one)
        claimed = settle(claimed, f"cascade-claims{level}")
        if claimed.isEmpty():
            break
        inside, outside, level = claimed, inside.select("h"), level + 1
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out, n_shards


def listed_urls(pages: DataFrame, key: Column, listed: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """pages with a boolean column hit: its key is one of listed's (column key string), by the cascade over pages' own keys.

    A null key is not listed. Repeated rows and keys change nothing; an empty
    pages or listed table gives no hits. pages must have no column h or hit.
    """
    spark = pages.sparkSession
    hashed = pages.withColumn("h", F.coalesce(F.when(key.isNotNull(), F.xxhash64(key)), F.lit(0)))
    filters, n_shards = build(hashed.select("h").where(F.col("h") != 0).distinct(), listed.where(F.col("key").isNotNull()).select(F.xxhash64("key").alias("h")).distinct(), shard_keys)
    out = hashed.withColumn("hit", F.lit(False))
    for block in _passes(filters) if filters is not None else ():
        out = _judge(out, spark, block, n_shards)
    return out.withColumn("hit", F.col("hit") & (F.col("h") != 0)).drop("h")
