"""Importance resampling towards a target set: hashed word n-grams score texts, a distributed LSD radix sort ranks them.

Texts are cut once, into the bucket numbers of their features, which are kept
as a narrow table; corpus and target counts, weights and scores all come from
that table by array look-ups. The ranking never sorts rows by comparison: each
pass deals rows by one digit of a composite key, stable within blocks of the
places before, and takes destinations from global prefix sums of the digits'
counts.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import arrow_map, discard, lower_ascii, settle
from barloom.llm.decontaminate import WORD

#: Buckets of features.
BUCKETS = 10_000
#: Bits of a digit of the radix sort: 2,048 values, so that a pass's totals are a small table.
DIGIT_BITS = 11
#: Least and greatest number of rows of a block.
BLOCK_ROWS = 1 << 12, 1 << 20


def _zero_byte_tables(longest: int) -> np.ndarray:
    """[n, j, b]: what byte b at place j of a CRC-32 register becomes after n zero bytes; the register is linear in them."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # differences: the register's own table
    out = np.zeros((longest, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, longest):
        out[n] = step[out[n - 1] & 0xFF] ^ (out[n - 1] >> 8)
    return out


class WordCodes(dict):
    """Numbers of words, with the CRC-32 of each word and of the word and a space; joined words' sums follow by array look-ups."""

    MOST, LONGEST = 400_000, 64

    def __init__(self) -> None:
        self.zeros = _zero_byte_tables(self.LONGEST)
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.raw: list[bytes] = []
        self.sums = np.zeros((3, 0), np.uint32)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.raw)
        self.raw.append(word.encode("utf-8", "surrogatepass"))
        return n

    def _tables(self) -> np.ndarray:
        """(crc of the word, crc of word and space, bytes) of every word."""
        new = self.raw[self.sums.shape[1] :]
        if new:
            add = np.array([[zlib.crc32(w), zlib.crc32(w + b" "), len(w)] for w in new], np.uint32).T
            self.sums = np.concatenate([self.sums, add], axis=1)
        return self.sums

    def features(self, texts: list[list[str]], buckets: int) -> list[np.ndarray]:
        """Of each word list the buckets of its words, then of its pairs of neighbours, as uint16 or uint32."""
        if len(self) >= self.MOST:
            self._reset()
        counts = [len(t) for t in texts]
        ids = np.fromiter((self[w] for t in texts for w in t), np.int64, sum(counts))
        word, spaced, size = self._tables()
        one = word[ids]
        first, second = ids[:-1], ids[1:]
        n = size[second].astype(np.int64)
        c, k = spaced[first], np.minimum(n, self.LONGEST - 1)
        pair = self.zeros[k, 0, c & 0xFF] ^ self.zeros[k, 1, (c >> 8) & 0xFF] ^ self.zeros[k, 2, (c >> 16) & 0xFF] ^ self.zeros[k, 3, c >> 24] ^ one[1:]
        for i in np.flatnonzero(n >= self.LONGEST):  # rare long words
            pair[i] = zlib.crc32(self.raw[second[i]], int(c[i]))
        kind = np.uint16 if buckets <= 1 << 16 else np.uint32
        one, pair = (one % buckets).astype(kind), (pair % buckets).astype(kind)
        out, at = [], 0
        for m in counts:
            out.append(np.concatenate([one[at : at + m], pair[at : at + max(0, m - 1)]]))
            at += m
        return out


def feature_rows(docs: DataFrame, keep: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """(keep..., n_words bigint, features binary): the buckets of a text's words and word pairs, repeats kept, as packed numbers.

    Null and empty texts have none. docs must have the columns of keep and text.
    """

    def make():
        codes = WordCodes()

        def step(rows: pa.RecordBatch, words: list) -> dict:
            cut = [WORD.findall(lower_ascii(t)) if t else [] for t in words]
            return {"n_words": pa.array([len(w) for w in cut], pa.int64()), "features": pa.array([x.tobytes() for x in codes.features(cut, buckets)], pa.binary())}

        return step

    return arrow_map(docs.select(*keep, "text"), make, "n_words bigint, features binary", keep=keep)


def _packed(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and where each row's begin, with the end last."""
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)
    return data, (ends - ends[0]) // np.dtype(kind).itemsize


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows: a vector a task, summed by bucket; `buckets` numbers reach the driver."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(_packed(b.column(0), kind)[0], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["bucket", "n"])

    summed = rows.select("features").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target and corpus shares, floored, of each bucket."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int, seed: int) -> int:
    """Thousandths of a Gumbel number drawn from the id's hash, floored."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """feature_rows() with doc_id, as (doc_id, n_words, n_features, weight, score); score is null where doc_id is."""
    kind = np.uint16 if len(gains) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = _packed(b.column(2), kind)
            sums = np.concatenate([[0], np.cumsum(gains[data])])
            n = np.diff(at)
            weight = (sums[at[1:]] - sums[at[:-1]]) // np.maximum(n, 1)
            ids = b.column(0).to_pylist()
            score = [None if i is None else int(w) + gumbel(i, seed) for i, w in zip(ids, weight, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(weight, pa.int64()), pa.array(score, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return rows.select("doc_id", "n_words", "features").mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """One stable counting-sort pass: rows with block and digit get the place that the pass sends them to.

    Within a block rows keep the order of the columns `order`; blocks follow each other by number.
    """
    counts = settle(rows.groupBy("block", "digit").agg(F.count("*").alias("n")), "digits")
    total = counts.groupBy("digit").agg(F.sum("n").alias("all"))  # at most 2,048 rows
    before = total.select("digit", (F.sum("all").over(Window.orderBy("digit")) - F.col("all")).alias("start"))
    own = F.sum("n").over(Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.join(F.broadcast(before), "digit").select("block", "digit", (F.col("start") + F.coalesce(own, F.lit(0))).alias("base"))
    names = [c for c in rows.columns if c not in ("block", "digit", "place")]

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pa.array(np.lexsort([left.column(c).to_numpy() for c in reversed(order)])))
        digit = left.column("digit").to_numpy()
        base = np.zeros(1 << DIGIT_BITS, np.int64)
        base[right.column("digit").to_numpy()] = right.column("base").to_numpy()
        by = np.argsort(digit, kind="stable")
        count = np.bincount(digit, minlength=1 << DIGIT_BITS)
        to = np.empty(len(digit), np.int64)
        to[by] = np.arange(len(digit)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(base, count)
        return pa.table([*(left.column(c) for c in names), pa.array(to)], names=[*names, "place"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names) + ", place bigint"
    out = settle(rows.groupBy("block").cogroup(bases.groupBy("block")).applyInArrow(place, schema), "places")
    discard(counts)
    return out


def radix_places(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, all of whose columns are bigint and not null, with place: 0 for the least by keys (the first counts most), dense.

    A least-significant-digit radix sort over the composite of the keys: one
    pass for each digit that the keys' ranges need, each pass one shuffle of the
    rows by block. Rows equal in all keys lie side by side, ordered by their
    other columns. An empty table stays empty.
    """
    span = rows.agg(F.count("*").alias("rows"), *(f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max))).first()
    size = min(BLOCK_ROWS[1], max(BLOCK_ROWS[0], span["rows"] // 512))
    passes = [(k, s) for k in reversed(keys) for s in range(0, int((span[f"max_{k}"] or 0) - (span[f"min_{k}"] or 0)).bit_length(), DIGIT_BITS)] or [(keys[0], 0)]
    names, out = rows.columns, None
    for k, shift in passes:
        least, most = span[f"min_{k}"] or 0, span[f"max_{k}"] or 0
        up = F.col(k) - F.lit(least) if most - least < 1 << 63 else F.col(k).bitwiseXOR(F.lit(-(1 << 63)))  # from 0 on, or in unsigned order
        digit = F.shiftrightunsigned(up, shift).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int")
        if out is None:
            block = F.pmod(F.xxhash64(*names), F.lit(max(1, span["rows"] // size)))
            out = _dealt(rows.withColumns({"block": block, "digit": digit}), [*keys, *(c for c in names if c not in keys)])
        else:
            last = out
            out = _dealt(last.withColumns({"block": F.expr(f"place div {size}"), "digit": digit}), ["place"])
            discard(last)
    return out


def importance_ranks(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), all bigint, a row for each row of docs.

    A feature is a word or a pair of neighbouring words, A-Z lower-cased, hashed
    by CRC-32 into buckets; a bucket's gain compares its share in target with
    that in docs; weight is the floored mean gain of a text's features and score
    adds a Gumbel number of the id's hash, so that the highest scores are a draw
    without replacement by weight. Of the rows with at least least_words words,
    `percent` in a hundred are drawn (floored) and ranked from 1 by score, then
    smaller doc_id; all others have a null rank.

    Null and empty texts have no features and a weight of 0; a null doc_id has
    no hash, so its score and rank are null and it is not among the rows drawn
    from; repeated rows count each and take neighbouring ranks; an empty target
    leaves smoothed shares; an empty docs gives no rows. Other columns are not read.
    """
    rows = settle(feature_rows(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")), keep=("doc_id",), buckets=buckets), "features")
    wanted = feature_rows(target.select(target["text"].alias("text")), buckets=buckets)
    gains = bucket_gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets))
    got = settle(scored(rows, gains, seed), "scores")
    discard(rows)
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    down = radix_places(got.where(able).select(F.negative("score").alias("low"), "doc_id", "n_features", "n_words", "weight"), ["low", "doc_id"])
    drawn = got.where(able).count() * percent // 100
    ranked = down.select("doc_id", "n_words", "n_features", "weight", F.negative("low").alias("score"), F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    return ranked.unionByName(got.where(~able).withColumn("rank", F.lit(None).cast("bigint")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """The drawn rows of docs with all their columns, as importance_ranks() draws them; copies of a drawn doc_id with the same text stay together."""
    drawn = importance_ranks(docs, target, percent, least_words, seed, buckets).where("rank is not null")
    kept = drawn.select(F.col("doc_id").alias("_drawn_id")).distinct()
    return docs.join(kept, docs["doc_id"].cast("bigint") == kept["_drawn_id"], "left_semi")
