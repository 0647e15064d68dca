"""Repeated windows of a corpus by content-chosen anchors: what suffix and FM-index buckets share.

A window is W consecutive units (bytes or words) of a text. Its anchor is the
leftmost of its K-unit grams with the least hash, so equal windows have equal
anchors at equal offsets. A run is a longest sequence of windows with one
anchor; its units are its span, and its key is the anchor gram's hash. So two
equal windows lie in spans of one key, at equal distances from the anchor, and
only keys that the corpus has twice can hold repetitions.

1. Each map batch of texts asks once for each (key, span) it has, with how often
   it has it and the least and greatest id of its texts, and keeps a list of its
   own runs.
2. For each key that the corpus has twice, the units of its different spans are
   sent, of a span that it has more than once two witnesses: the one of the least
   document and the one of the greatest.
3. The caller's matcher (sorted suffixes or an FM-index) says which windows of
   each span are repeated, and in which least document. It is told no numbers:
   that a span is repeated it finds by comparing the witnesses' units.
4. The answers go to every batch that asked and from there to the texts.

All that is removed comes from step 3; equal (key, span) pairs, 128 bits, share
an answer. A key with very many different spans is
split: its spans are cut into segments of windows, each dealt by the longer core
of units that all windows of the segment share; a core that still has very many
segments is dealt by whole windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WordHashes, scramble, settle, steps, window_hashes, words_of

#: Units of a batch's texts, about; spans of a key, or segments of a core, beyond which it is split; units handled at once.
BATCH_UNITS, SPLIT_SPANS, PIECE = 4_000_000, 2_000, 1_000_000
#: An id greater than all others, for rows without one; less than all others: covers whatever the reader's id is.
NO_ID, ANY_ID = np.iinfo(np.int64).max, np.iinfo(np.int64).min


class Plan(NamedTuple):
    """Windows of `window` units with anchors of `gram` units; units are bytes or words.

    earlier: a window counts as repeated if it also starts in a document with a
    smaller id; otherwise if it starts anywhere else.
    """

    window: int
    gram: int
    words: bool
    earlier: bool

    @property
    def reach(self) -> int:
        """Grams of a window, less one: the greatest offset of an anchor."""
        return self.window - self.gram


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k bytes, k a multiple of 8."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | (x[width:] << np.uint64(8 * width))
    m = len(x) - (k // 8 - 1) * 8
    out = np.zeros(m, np.uint64)
    for i in range(k // 8):
        out = (out ^ x[i * 8 : i * 8 + m]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return scramble(out)


def anchors_of(grams: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost least gram of each window of `span` grams; grams are compared by their high 40 bits, at most 2**24 at once."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(grams) // span)
    square = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    square[: len(grams)] = packed
    square = square.reshape(blocks, span)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & low).astype(np.int64)


def units_of(text: str | None, plan: Plan, hashes: WordHashes) -> np.ndarray:
    if plan.words:
        return hashes.of(words_of(text))
    return np.frombuffer((text or "").encode(), np.uint8)


def runs_of(texts: list[np.ndarray], plan: Plan) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor's offset in the span, key, span hash) of the runs of some texts' units, in order.

    The texts are handled as one sequence, PIECE units at a time; a run that a
    piece's edge cuts is two, which every copy of it may be as well: runs are
    compared window by window, not as wholes.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + sizes[end] <= PIECE):
            total += int(sizes[end])
            end += 1
        whole = np.concatenate(texts[at:end]) if end - at > 1 else texts[at]
        for lo in range(0, max(1, len(whole) - plan.window + 1), PIECE):  # one text longer than PIECE
            part = whole[lo : lo + PIECE + plan.window - 1]
            grams = window_hashes(part, plan.gram) if plan.words else byte_grams(part, plan.gram)
            anchor = anchors_of(grams, plan.reach + 1)
            if not len(anchor):
                continue
            begins = np.cumsum(sizes[at:end]) - sizes[at:end] - lo
            owner = np.searchsorted(begins, np.arange(len(anchor)), side="right") - 1
            inside = np.arange(len(anchor)) + plan.window <= begins[owner] + sizes[at:end][owner]
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new & inside)
            if not len(first):
                continue
            stop = np.flatnonzero(np.append(new[1:], True) & inside) + 1
            edge = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1  # the last window of a text ends its run
            stop = np.unique(np.concatenate([stop, edge]))
            n = stop[np.searchsorted(stop, first, side="right")] - first
            raw, size = part.tobytes(), part.itemsize
            spans = [xxhash.xxh3_64_intdigest(raw[a * size : b * size]) for a, b in zip(first.tolist(), (first + n + plan.window - 1).tolist(), strict=True)]
            for held, x in zip(out, (owner[first] + at, first - begins[owner[first]], n, anchor[first] - first, grams[anchor[first]], np.array(spans, np.uint64)), strict=True):
                held.append(x)
        at = end
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds, strict=True))


_ASK = np.dtype([("key", "<u8"), ("span", "<u8"), ("count", "<u4"), ("index", "<u4"), ("least", "<i8"), ("most", "<i8")])
_OWN = np.dtype([("index", "<u4"), ("first", "<u4"), ("n", "<u4"), ("at", "<u2")])
_SAY = np.dtype([("index", "<u4"), ("from", "<u4"), ("to", "<u4"), ("least", "<i8")])


def _planes(x: np.ndarray) -> bytes:
    """A structured array, byte position by byte position, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()) if len(x) else b""


def _unplanes(data: bytes, kind: np.dtype) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def identified(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text): rid is a hash of both, so rows with equal id and text share one and all others differ."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")


def _batches(rows: DataFrame, plan: Plan, buckets: int) -> DataFrame:
    """(bucket, batch, rids, ids, sizes, payload): bucket -1 has a batch's own runs, the others what it asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        rids, ids, sizes, held, seen = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            name = uuid.uuid4().int >> 65
            n, first, at, key, span = (np.concatenate(x) for x in zip(*held, strict=True))
            doc = np.repeat(np.array(ids, np.int64), sizes)
            order = np.lexsort((span, key))
            k, s = key[order], span[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
            starts = np.flatnonzero(new)
            index = np.empty(len(k), np.uint32)
            index[order] = np.cumsum(new) - 1
            ask = np.zeros(len(starts), _ASK)
            ask["key"], ask["span"], ask["count"] = k[starts], s[starts], np.diff(np.append(starts, len(k)))
            ask["index"] = np.arange(len(starts))
            ask["least"], ask["most"] = np.minimum.reduceat(doc[order], starts), np.maximum.reduceat(doc[order], starts)
            own = np.zeros(len(n), _OWN)
            own["index"], own["first"], own["n"], own["at"] = index, first, n, at
            yield _row(-1, name, rids, ids, sizes, _planes(own))
            dealt = (scramble(ask["key"]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(dealt, kind="stable")
            cuts = np.flatnonzero(np.diff(dealt[order])) + 1
            for mine in np.split(order, cuts):
                yield _row(int(dealt[mine[0]]), name, [], [], [], _planes(ask[mine]))

        for got, words in steps(batches):
            texts = [units_of(t, plan, hashes) for t in words]
            text, first, n, at, key, span = runs_of(texts, plan)
            owners, counts = np.unique(text, return_counts=True)
            r, d = got.column(0).to_pylist(), got.column(1).to_pylist()
            rids += [r[i] for i in owners.tolist()]
            ids += [NO_ID if d[i] is None else d[i] for i in owners.tolist()]
            sizes += counts.tolist()
            if len(text):
                held.append((n, first, at, key, span))
            seen += sum(map(len, texts))
            if seen >= BATCH_UNITS and held:
                yield from flush()
                rids, ids, sizes, held, seen = [], [], [], [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, "bucket int, batch bigint, rids array<bigint>, ids array<bigint>, sizes array<int>, payload binary")


def _row(bucket: int, batch: int, rids: list, ids: list, sizes: list, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([batch], pa.int64()), pa.array([rids], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([payload], pa.binary())], names=["bucket", "batch", "rids", "ids", "sizes", "payload"])


def _asked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All that batches ask of a bucket, by (key, span); the batch of each; whether it begins a new (key, span)."""
    parts, batch = [], []
    for b, data in zip(table["batch"].to_pylist(), table["payload"], strict=True):
        parts.append(_unplanes(data.as_py(), _ASK))
        batch.append(np.full(len(parts[-1]), b, np.int64))
    ask, batch = np.concatenate(parts), np.concatenate(batch)
    order = np.lexsort((ask["span"], ask["key"]))
    ask, batch = ask[order], batch[order]
    new = np.ones(len(ask), bool)
    new[1:] = (ask["key"][1:] != ask["key"][:-1]) | (ask["span"][1:] != ask["span"][:-1])
    return ask, batch, new


def _by_batch(batch: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(batch, its rows) of some rows."""
    order = rows[np.argsort(batch[rows], kind="stable")]
    for mine in np.split(order, np.flatnonzero(np.diff(batch[order])) + 1) if len(order) else ():
        yield int(batch[mine[0]]), mine


def _choose(plan: Plan):
    """applyInArrow over a bucket: the spans whose units a batch shall send, repeated ones from two places."""

    def chosen(table: pa.Table) -> pa.Table:
        ask, batch, new = _asked(table)
        starts = np.flatnonzero(new)
        group, rows = np.cumsum(new) - 1, np.arange(len(ask))
        least, most = np.minimum.reduceat(ask["least"], starts), np.maximum.reduceat(ask["most"], starts)
        twice = least < most if plan.earlier else np.add.reduceat(ask["count"].astype(np.int64), starts) > 1
        key = ask["key"][starts]
        of_key = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        spans = np.diff(np.append(of_key, len(starts)))
        if plan.earlier:
            may = np.minimum.reduceat(least, of_key) < np.maximum.reduceat(most, of_key)
        else:
            may = (spans > 1) | np.logical_or.reduceat(twice, of_key)
        may = np.repeat(may, spans)
        many = np.repeat(spans > SPLIT_SPANS, spans)
        one, two = np.flatnonzero(may), np.flatnonzero(may & twice)
        first = np.minimum.reduceat(np.where(ask["least"] == least[group], rows, len(rows)), starts)
        last = np.maximum.reduceat(np.where(ask["most"] == most[group], rows, -1), starts)
        of, at = np.concatenate([one, two]), np.concatenate([first[one], last[two]])
        copy = np.concatenate([np.where(twice[one], FIRST, ALONE), np.full(len(two), LAST)])
        doc = np.where(copy == LAST, most[of], least[of])
        out: list[list] = [[], []]
        for b, mine in _by_batch(batch[at], np.arange(len(at))):
            out[0].append(b)
            x = ask[at[mine]]
            out[1].append([dict(zip(_ASKED, v, strict=True)) for v in zip(x["index"].tolist(), x["key"].view(np.int64).tolist(), x["span"].view(np.int64).tolist(), copy[mine].tolist(), doc[mine].tolist(), many[of[mine]].tolist(), strict=True)])
        return pa.table({"batch": pa.array(out[0], pa.int64()), "part": pa.array(out[1], _PART)})

    return chosen


#: A span's witness: the only one; the first of two, which is looked up; the last of two, which asks.
ALONE, FIRST, LAST = 0, 1, 2
_ASKED = ("index", "key", "span", "copy", "least", "many")
_PART = pa.list_(pa.struct([("index", pa.int64()), ("key", pa.int64()), ("span", pa.int64()), ("copy", pa.int32()), ("least", pa.int64()), ("many", pa.bool_())]))
_PART_SQL = "array<struct<index:bigint,key:bigint,span:bigint,copy:int,least:bigint,many:boolean>>"
_WANT_SQL = "array<struct<first:int,n:int,at:int,key:bigint,span:bigint,copy:int,least:bigint,many:boolean>>"
_WANT = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("at", pa.int32()), ("key", pa.int64()), ("span", pa.int64()), ("copy", pa.int32()), ("least", pa.int64()), ("many", pa.bool_())]))
RANGES = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
RANGES_SQL = "array<struct<from:int,to:int>>"
#: What a matcher returns: windows [from, to) of a span, counted from its first, that repeat, and the least id of a document that has them.
FOUND_SQL = "key bigint, span bigint, from int, to int, least bigint"


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges [a, b), those that touch joined."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    starts = np.flatnonzero(new)
    return a[starts], b[np.append(starts[1:], len(a)) - 1]


def _wants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over batches' own runs with the spans they shall send: per text, where those lie."""
    for got in batches:
        col = lambda c: got.column(got.schema.get_field_index(c))  # noqa: B023, E731
        for r in range(got.num_rows):
            rids, ids, sizes = (col(c)[r].as_py() for c in ("rids", "ids", "sizes"))
            own = _unplanes(col("payload")[r].as_py(), _OWN)
            parts = [x for y in col("part")[r].as_py() for x in y]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((np.array(ids, np.int64)[owner], own["index"]))  # a span's runs by document
            asked = np.array([x["index"] for x in parts], np.uint32)
            lo, hi = (np.searchsorted(own["index"][order], asked, side=side) for side in ("left", "right"))
            runs = order[np.where([x["copy"] == LAST for x in parts], hi - 1, lo)]
            out: dict[int, list] = {}
            for m, o, x in zip(own[runs], owner[runs].tolist(), parts, strict=True):
                out.setdefault(o, []).append({"first": int(m["first"]), "n": int(m["n"]), "at": int(m["at"]), **{c: x[c] for c in _ASKED[1:]}})
            yield pa.RecordBatch.from_arrays([pa.array([rids[o] for o in out], pa.int64()), pa.array(list(out.values()), _WANT)], names=["rid", "wants"])


_PIECE_COLUMNS = {"key": "bigint", "span": "bigint", "many": "boolean", "core": "bigint", "part": "bigint", "skip": "int", "n": "int", "at": "int", "copy": "int", "least": "bigint", "units": "binary"}
_PIECE_SQL = ", ".join(f"{c} {t}" for c, t in _PIECE_COLUMNS.items())
#: What a matcher gets: witnesses of a key's spans, with the number of their windows, the anchor's place and the id of the document they come from.
SPAN_SQL = "key bigint, span bigint, n int, at int, copy int, least bigint, units binary"


def _hash(units: np.ndarray, seed: int = 0) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(units.tobytes(), seed)).view(np.int64))


def segments(units: np.ndarray, n: int, at: int, width: int, plan: Plan) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(core, windows skipped, windows, anchor's place, units) of a span's windows, by groups of `width` offsets of the anchor that share a core."""
    for lo in range(0, plan.reach + 1, width):
        hi = min(lo + width - 1, plan.reach)
        s0, s1 = max(0, at - hi), min(n - 1, at - lo)
        if s0 <= s1:
            yield _hash(units[at - lo : at - hi + plan.window], lo + 1 + (plan.reach + 1) * width), s0, s1 - s0 + 1, at - s0, units[s0 : s1 + plan.window]


def _cut(plan: Plan):
    """mapInArrow over texts with their wants: _PIECE_SQL, in segments where many."""
    width = max(1, (plan.reach + 8) // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for got, words in steps(batches):
            out: list[list] = []
            for t, ws in zip(words, got.column(got.schema.get_field_index("wants")).to_pylist(), strict=True):
                units = units_of(t, plan, hashes)
                for w in ws:
                    own = units[w["first"] : w["first"] + w["n"] + plan.window - 1]
                    if w["many"]:
                        for core, skip, n, at, part in segments(own, w["n"], w["at"], width, plan):
                            out.append([w["key"], w["span"], True, core, _hash(part, at + 1), skip, n, at, w["copy"], w["least"], part.tobytes()])
                    else:
                        out.append([w["key"], w["span"], False, w["key"], w["span"], 0, w["n"], w["at"], w["copy"], w["least"], own.tobytes()])
            yield _pieces(out)

    return run


def _pieces(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds, strict=True)], names=list(_PIECE_COLUMNS))


def _windows(plan: Plan):
    """mapInArrow over pieces: each window by itself, its core the whole of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            out = []
            for x in got.to_pylist():
                units = np.frombuffer(x["units"], np.uint64 if plan.words else np.uint8)
                for core, skip, n, at, part in segments(units, x["n"], x["at"], 1, plan):
                    out.append([x["key"], x["span"], True, core, _hash(part, at + 1), x["skip"] + skip, n, at, x["copy"], x["least"], part.tobytes()])
            yield _pieces(out)

    return run


def _matched(pieces: DataFrame, plan: Plan, match: Callable[[DataFrame, Plan], DataFrame]) -> DataFrame:
    """FOUND_SQL of whole and of segmented spans; of equal segments and windows two witnesses go to the matcher."""
    whole = pieces.where("not many").select("key", "span", "n", "at", "copy", "least", "units")
    cut = pieces.where("many")
    hot = cut.groupBy("core").agg(F.approx_count_distinct("part").alias("m")).where(F.col("m") > SPLIT_SPANS).select("core")
    single = cut.join(hot, "core", "left_semi").select(*_PIECE_COLUMNS).mapInArrow(_windows(plan), _PIECE_SQL)
    cut = settle(cut.join(hot, "core", "left_anti").select(*_PIECE_COLUMNS).unionByName(single), "segments")
    witness, by = F.struct("n", "at", "least", "units"), F.struct("least", "span", "copy")
    ends = cut.groupBy("core", "part").agg(F.min_by(witness, by).alias("a"), F.max_by(witness, by).alias("b"), F.count("*").alias("rows"))
    twice = F.expr("a.least < b.least") if plan.earlier else F.col("rows") > 1
    named = lambda c, copy: F.struct(F.lit(copy).alias("copy"), *(F.col(c)[x].alias(x) for x in ("n", "at", "least", "units")))
    sent = ends.select(F.col("core").alias("key"), F.col("part").alias("span"), F.explode(F.when(twice, F.array(named("a", FIRST), named("b", LAST))).otherwise(F.array(named("a", ALONE)))).alias("x"))
    owners = cut.select("core", "part", "key", "span", "skip").distinct()
    found = match(sent.select("key", "span", "x.n", "x.at", "x.copy", "x.least", "x.units"), plan).withColumnsRenamed({"key": "core", "span": "part"}).join(owners, ["core", "part"])
    moved = found.select("key", "span", (F.col("from") + F.col("skip")).alias("from"), (F.col("to") + F.col("skip")).alias("to"), "least")
    return match(whole, plan).unionByName(moved)


def _tell(plan: Plan):
    """cogrouped applyInArrow over a bucket's asks and its found windows: to each batch, what of its spans is covered."""

    def told(asked: pa.Table, found: pa.Table) -> pa.Table:
        if not asked.num_rows or not found.num_rows:
            return pa.table({"batch": pa.array([], pa.int64()), "said": pa.array([], pa.binary())})
        ask, batch, new = _asked(asked)
        starts = np.flatnonzero(new)
        pair = np.stack([ask["key"][starts], ask["span"][starts]])
        got = np.stack([np.asarray(found[c].combine_chunks()).view(np.uint64) for c in ("key", "span")])
        order = np.lexsort((got[1], got[0]))
        got = got[:, order]
        first, last, least = (np.asarray(found[c].combine_chunks())[order] for c in ("from", "to", "least"))
        name = lambda x: scramble(x[0]) ^ x[1]
        a, b = name(pair), name(got)
        by = np.argsort(b, kind="stable")
        lo, hi = np.searchsorted(b[by], a, side="left"), np.searchsorted(b[by], a, side="right")
        group = np.cumsum(new) - 1
        n = (hi - lo)[group]
        row = np.repeat(np.arange(len(ask)), n)
        which = by[lo[group][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
        right = (pair[:, group[row]] == got[:, which]).all(axis=0)
        if plan.earlier:
            right &= least[which] < ask["most"][row]
        row, which = row[right], which[right]
        said = np.zeros(len(row), _SAY)
        said["index"], said["from"], said["to"], said["least"] = ask["index"][row], first[which], last[which], least[which]
        out = [(b, _planes(said[mine])) for b, mine in _by_batch(batch[row], np.arange(len(row)))]
        return pa.table({"batch": pa.array([x for x, _ in out], pa.int64()), "said": pa.array([x for _, x in out], pa.binary())})

    return told


def _covered(plan: Plan):
    """mapInArrow over batches' own runs with all that was said: the covered units of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            col = lambda c: got.column(got.schema.get_field_index(c))  # noqa: B023, E731
            for r in range(got.num_rows):
                rids, ids, sizes = (col(c)[r].as_py() for c in ("rids", "ids", "sizes"))
                own = _unplanes(col("payload")[r].as_py(), _OWN)
                said = np.concatenate([_unplanes(x, _SAY) for x in col("said")[r].as_py()])
                said = said[np.argsort(said["index"], kind="stable")]
                lo, hi = np.searchsorted(said["index"], own["index"], side="left"), np.searchsorted(said["index"], own["index"], side="right")
                n = hi - lo
                run_ = np.repeat(np.arange(len(own)), n)
                x = said[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(run_))]
                owner = np.repeat(np.arange(len(sizes)), sizes)[run_]
                hit = x["least"] < np.array(ids, np.int64)[owner] if plan.earlier else np.ones(len(x), bool)
                owner, a, b = owner[hit], own["first"][run_][hit].astype(np.int64) + x["from"][hit], own["first"][run_][hit].astype(np.int64) + x["to"][hit] + plan.window - 1
                far = (1 + int(b.max(initial=0))) * owner  # each text's ranges beyond the one before's
                p, q = merged(a + far, b + far)
                of = p // (1 + int(b.max(initial=0)))
                texts, starts = np.unique(of, return_index=True)
                base = of * (1 + int(b.max(initial=0)))
                ranges = pa.StructArray.from_arrays([pa.array(p - base, pa.int32()), pa.array(q - base, pa.int32())], names=["from", "to"])
                offsets = pa.array(np.append(starts, len(of)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([rids[i] for i in texts.tolist()], pa.int64()), pa.ListArray.from_arrays(offsets, ranges)], names=["rid", "ranges"])

    return run


def repeated(rows: DataFrame, plan: Plan, match: Callable[[DataFrame, Plan], DataFrame]) -> DataFrame:
    """(rid, ranges): units of each of identified() rows in repeated windows, ranges in order, once or (repeated rows) more a rid.

    match gets SPAN_SQL (equal keys belong together, windows may be equal only
    at equal distances from the anchor) and returns FOUND_SQL of the witnesses
    that are not FIRST: those have the same windows as their LAST.
    """
    spark = rows.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches = settle(_batches(rows, plan, buckets), "anchors")
    asked = batches.where("bucket >= 0").select("bucket", "batch", "payload")
    own = batches.where("bucket = -1").select("batch", "rids", "ids", "sizes", "payload")
    parts = asked.groupBy("bucket").applyInArrow(_choose(plan), f"batch bigint, part {_PART_SQL}").groupBy("batch").agg(F.collect_list("part").alias("part"))
    wants = own.join(parts, "batch").mapInArrow(_wants, f"rid bigint, wants {_WANT_SQL}").groupBy("rid").agg(F.flatten(F.collect_list("wants")).alias("wants"))
    texts = rows.select("rid", "text").join(wants, "rid")
    found = settle(_matched(settle(texts.mapInArrow(_cut(plan), _PIECE_SQL), "pieces"), plan, match), "found")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            key = np.asarray(got.column(0)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((scramble(key) % np.uint64(buckets)).astype(np.int32)), *got.columns], names=["bucket", *got.schema.names])

    dealt = found.mapInArrow(named, f"bucket int, {FOUND_SQL}")
    said = asked.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(_tell(plan), "batch bigint, said binary").groupBy("batch").agg(F.collect_list("said").alias("said"))
    return own.join(said, "batch").mapInArrow(_covered(plan), f"rid bigint, ranges {RANGES_SQL}")


def groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows in tables of whole keys, of about `most` bytes of units; the rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        key = np.asarray(batch.column(batch.schema.get_field_index("key")))
        if not len(key):
            continue
        total = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index("units")))), dtype=np.int64)])
        begins = np.flatnonzero(np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]]))
        at = 0
        for c in begins.tolist():
            if size + int(total[c] - total[at]) >= most:
                if c > at:
                    held.append(batch.slice(at, c - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, size, at = [], 0, c
        held.append(batch.slice(at))
        size += int(total[-1] - total[at])
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held)


def found_windows(table: pa.Table, rows: np.ndarray, windows: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    """FOUND_SQL from repeated windows: row and window within the row, sorted by both; neighbours with one least id join."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (windows[1:] != windows[:-1] + 1) | (least[1:] != least[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(rows)) - 1
    of = pa.array(rows[starts])
    return pa.RecordBatch.from_arrays([table["key"].combine_chunks().take(of), table["span"].combine_chunks().take(of), pa.array(windows[starts], pa.int32()), pa.array(windows[ends] + 1, pa.int32()), pa.array(least[starts], pa.int64())], names=["key", "span", "from", "to", "least"])
