"""Removal of word runs that an earlier document has, by compressed FM-indexes of shards.

Texts are reduced to the spans around content-chosen anchors whose key the
corpus has twice (anchors.py); of equal spans the first document's is indexed and
the last document's asks, and equal anchors meet in one shard. The Burrows-Wheeler transform of a shard's spans over word ids is
kept in a wavelet matrix of packed bits, beside the counts of ids and, as 32-bit
ranks, the document of each row; neither text nor suffix array stays. The words
of the spans that ask then stream through the index, which holds them only if they
have no equal: backward search from the end of each window extends the match until
it has its full length, or nothing but the window itself is left, and the least document of the matched range tells who has it first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.anchors import FIRST, FOUND_SQL, LAST, RANGES_SQL, Plan, found_windows, groups, identified, merged, repeated
from barloom.llm.common import WORD, steps

#: Words of a repeated window; words of an anchor; bytes of word hashes of one index.
WINDOW, GRAM, SHARD = 50, 8, 3_000_000


class WaveletMatrix:
    """rank over a sequence of ids below 2**levels, in packed bits."""

    def __init__(self, ids: np.ndarray, levels: int):
        self.n, self.levels = len(ids), levels
        self.bits, self.before, self.zeros = [], [], []
        for level in reversed(range(levels)):
            bit = (ids >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.pad(packed, (0, 16 - len(packed) % 8)).view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            ids = np.concatenate([ids[bit == 0], ids[bit == 1]])

    def down(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix [0, at) of the sequence ends among the occurrences of each id."""
        for k, level in enumerate(reversed(range(self.levels))):
            word, rest = at >> 6, (at & 63).astype(np.uint64)
            ones = self.before[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << rest) - np.uint64(1)))
            at = np.where((ids >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def follow(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the sequence has each id at its place, and, where it has, what down() gives for the place."""
        same = np.ones(len(at), bool)
        for k, level in enumerate(reversed(range(self.levels))):
            word, rest = self.bits[k][at >> 6], (at & 63).astype(np.uint64)
            ones = self.before[k][at >> 6] + np.bitwise_count(word & ((np.uint64(1) << rest) - np.uint64(1)))
            bit = ((ids >> level) & 1).astype(bool)
            same &= ((word >> rest) & np.uint64(1)).astype(bool) == bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return same, at


def sorted_suffixes(symbols: np.ndarray, n_symbols: int, n_ends: int) -> np.ndarray:
    """Order of the suffixes of spans, each of which ends with 0, by prefix doubling; each end is a symbol of its own."""
    n, ends = len(symbols), symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + n_ends - 1)
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        pair = rank * (n + n_symbols + 2) + ahead
        order = np.argsort(pair)
        new = np.ones(n, bool)
        new[1:] = pair[order][1:] != pair[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order
        step *= 2


class FMIndex:
    """Backward search over spans of symbols from 1 on; value: an integer of each span, of which least() gives the least in a range."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, value: np.ndarray):
        """symbols: the spans one after the other, each followed by 0."""
        self.n = len(symbols)
        order = sorted_suffixes(symbols, n_symbols, len(value))
        self.values, rank = np.unique(value, return_inverse=True)
        self.documents = rank.astype(np.int32)[(np.cumsum(symbols == 0) - (symbols == 0))[order]]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))])
        self.wavelet = WaveletMatrix(symbols[order - 1], max(1, int(n_symbols).bit_length()))  # before suffix 0 lies the last end
        self.base = self.wavelet.down(np.arange(n_symbols + 1), np.zeros(n_symbols + 1, np.int64))

    def extend(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with id, then what [low, high) begin with."""
        both = self.wavelet.down(np.concatenate([ids, ids]), np.concatenate([low, high]))
        shift = self.below[ids] - self.base[ids]
        return both[: len(ids)] + shift, both[len(ids) :] + shift

    def statistics(self, words: np.ndarray, ends: np.ndarray, most: int, need: np.ndarray | int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streamed words: of each place in ends the length, at most `most`, of the longest run up
        to it that occurs `need` times or more in the index, and the range of the runs of full length."""
        length, need = np.full(len(ends), most), np.broadcast_to(need, len(ends))
        alive = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        for k in range(most):
            ids = words[ends[alive] - 1 - k]
            one = high - low == 1  # a single row needs one descent
            if one.any():
                many = np.flatnonzero(~one)
                one = np.flatnonzero(one)
                same, at = self.wavelet.follow(ids[one], low[one])
                at = at + (self.below[ids[one]] - self.base[ids[one]])
                wide = self.extend(ids[many], low[many], high[many])
                low, high = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                low[one], high[one] = at, at + same
                low[many], high[many] = wide
            else:
                low, high = self.extend(ids, low, high)
            more = high - low >= need[alive]
            length[alive[~more]] = k
            alive, low, high = alive[more], low[more], high[more]
            if not len(alive):
                break
        return length, low, high

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least value of the spans of each range, not empty."""
        return self.values[range_least(self.documents, low, high)]


def range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of each range [low, high), not empty."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    table, k = values, 0
    while len(low):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k)])
        if k == level.max():
            return out
        table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
        k += 1
    return out


def covered(table: pa.Table, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, windows within them and the least document of each window of an asking span that an earlier document has, sorted; for spans of whole keys."""
    spans = [np.frombuffer(u, np.uint64) for u in table["units"].to_pylist()]
    n, copy, least = (np.asarray(table[c].combine_chunks()).astype(np.int64) for c in ("n", "copy", "least"))
    sizes = np.fromiter(map(len, spans), np.int64, len(spans))
    ids, names = pd.factorize(np.concatenate(spans))
    ids = ids.astype(np.int32) + 1
    of = np.repeat(np.arange(len(spans)), sizes)
    held = np.flatnonzero(copy != LAST)  # in the index
    words = np.zeros(int((sizes[held] + 1).sum()), np.int32)
    own = ids[(copy != LAST)[of]]
    words[np.arange(len(own)) + np.repeat(np.arange(len(held)), sizes[held])] = own
    index = FMIndex(words, len(names), least[held])
    asking = np.flatnonzero(copy != FIRST)
    rows = np.repeat(asking, n[asking])
    windows = np.arange(len(rows)) - np.repeat(np.cumsum(n[asking]) - n[asking], n[asking])
    begins = np.cumsum(sizes) - sizes
    length, low, high = index.statistics(ids, begins[rows] + windows + plan.window, plan.window, np.where(copy[rows] == LAST, 1, 2))
    full = length == plan.window
    first = least[rows]  # a shorter match is no other document's
    first[full] = index.least(low, high)
    hit = np.flatnonzero(first < least[rows])
    return rows[hit], windows[hit], first[hit]


def _match(spans: DataFrame, plan: Plan) -> DataFrame:
    partitions = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, SHARD):
            rows, windows, least = covered(table, plan)
            if len(rows):
                yield found_windows(table, rows, windows, least)

    return spans.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(run, FOUND_SQL)


def _words_removed(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(rid, ranges of words) for identified() rows."""
    return repeated(docs, Plan(window, gram, True, True), _match).groupBy("rid").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def cut_words(text: str | None, ranges: list | None) -> tuple[int, list[dict], str | None]:
    """Number of words, disjoint removed ranges and the text without them, white space around them left."""
    if not ranges:
        return len(WORD.findall(text)) if text else 0, [], text
    places = [m.span() for m in WORD.finditer(text)]
    a, b = merged(np.array([x["from"] for x in ranges], np.int64), np.array([x["to"] for x in ranges], np.int64))
    out, at = [], 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        out.append(text[at : places[x][0]])
        at = places[y - 1][1]
    return len(places), [{"from": x, "to": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)], "".join([*out, text[at:]])


def _cutting(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for got, words in steps(batches):
        at = got.schema.get_field_index
        cut = [cut_words(t, r) for t, r in zip(words, got.column(at("ranges")).to_pylist(), strict=True)]
        made = [pa.array([c[0] for c in cut], pa.int64()), pa.array([c[1] for c in cut], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array([c[2] for c in cut], pa.string())]
        yield pa.RecordBatch.from_arrays([*(got.column(at(c)) for c in keep), *made], names=[*keep, "n_words", "spans", "kept"])


def remove_earlier(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, spans of removed words, kept text) of each row.

    A word is removed if a window of `window` words that covers it also starts
    in a document with a smaller doc_id; windows are judged on the input. Null
    texts have no words and stay null. A null doc_id counts as greater than all
    others. Rows with one doc_id do not count as earlier than each other.
    """
    rows = identified(docs)
    return rows.join(_words_removed(rows, window, gram), "rid", "left").select("doc_id", "text", "ranges").mapInArrow(lambda b: _cutting(b, ["doc_id"]), f"doc_id bigint, n_words bigint, spans {RANGES_SQL}, kept string")


def without_earlier(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs, with all its columns, with the words that remove_earlier() removes cut from text; rows left without words go if they had some."""
    rows = identified(docs)
    own = docs.select(F.struct("*").alias("row"), F.xxhash64(docs["doc_id"].cast("long"), docs["text"]).alias("rid"), docs["text"].alias("text"))
    kind = own.schema["row"].dataType
    made = T.StructType([own.schema["row"], *T.StructType.fromDDL(f"n_words bigint, spans {RANGES_SQL}, kept string").fields])
    cut = own.join(_words_removed(rows, window, gram), "rid", "left").mapInArrow(lambda b: _cutting(b, ["row"]), made)
    left = F.aggregate("spans", F.col("n_words"), lambda n, s: n - (s["to"] - s["from"]))
    return cut.where((left > 0) | (F.size("spans") == 0)).select(*(F.col("kept").alias(f.name) if f.name == "text" else F.col("row")[f.name].alias(f.name) for f in kind.fields))
