"""Removal of byte strings that occur twice, by range-partitioned and locally sorted suffixes.

Suffixes start at content-chosen anchors (anchors.py), which leaves one in
about 85 positions; of equal spans two are sorted, so that each finds the other.
They are
dealt to range partitions by their leading bytes, at splitters that Spark
samples; leading bytes with very many suffixes are dealt by a longer core. A
bucket sorts its suffixes, and what lies before them read backwards, by multikey
quicksort; common prefixes of neighbours on both sides give the strings of full
length that start elsewhere as well. Equal leading bytes share a partition, so
no two equal strings lie on different sides of a boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.anchors import ANY_ID, FIRST, FOUND_SQL, RANGES_SQL, Plan, found_windows, groups, identified, merged, repeated
from barloom.llm.common import steps

#: Bytes of a string that is removed where it repeats; bytes of an anchor; bytes of suffixes sorted at once.
LENGTH, GRAM, BUCKET = 200, 32, 3_000_000


def multikey_quicksort(chars: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of rows of words by (group, words), by three-way partition of all parts at once.

    Each part has a depth. Its rows are split at the word there of its middle
    row: less, equal, greater; the equal ones go one word deeper. Parts of one
    row, and those past the last word, are done.
    """
    order = np.argsort(group, kind="stable")
    part = np.cumsum(np.concatenate([[0], np.diff(group[order]) != 0])) if len(order) else np.zeros(0, np.int64)
    at, depth = np.arange(len(order)), np.zeros(int(part[-1]) + 1 if len(part) else 0, np.int64)
    while True:
        size = np.bincount(part, minlength=len(depth))
        live = (size > 1) & (depth < chars.shape[1])
        keep = live[part]
        at, part = at[keep], (np.cumsum(live) - 1)[part[keep]]
        depth, size = depth[live], size[live]
        if not len(at):
            return order
        word = chars[order[at], depth[part]]
        pivot = word[np.cumsum(size) - size + size // 2][part]
        side = 3 * part + (word > pivot) + (word >= pivot)
        by = np.argsort(side, kind="stable")
        order[at], side = order[at[by]], side[by]
        new = np.concatenate([[0], np.cumsum(side[1:] != side[:-1])])
        first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        depth, part = depth[side[first] // 3] + (side[first] % 3 == 1), new


def multikey_sort(rows: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of zero-padded byte rows by (group, bytes, length), and each one's common prefix with the one before it; -1 marks the first row of a group."""
    n, width = rows.shape
    padded = np.pad(rows, ((0, 0), (0, -width % 8)))
    chars = np.concatenate([np.ascontiguousarray(padded).view(">u8").astype(np.uint64), length[:, None].astype(np.uint64)], axis=1)
    order = multikey_quicksort(chars, group)
    lcp = np.full(n, -1, np.int64)
    if n > 1:
        a, b = order[1:], order[:-1]
        for at in range(0, n - 1, 4096):
            x, y = a[at : at + 4096], b[at : at + 4096]
            diff = rows[x] != rows[y]
            common = np.where(diff.any(axis=1), diff.argmax(axis=1), width)
            lcp[at + 1 : at + 1 + len(x)] = np.where(group[x] == group[y], np.minimum(common, np.minimum(length[x], length[y])), -1)
    return order, lcp


def _padded(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width), length


def covered(table: pa.Table, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, windows within them and least ids of the windows that are repeated, sorted; for spans of whole keys."""
    col = lambda c: np.asarray(table[c].combine_chunks()).astype(np.int64)
    key, n, at, copy, least = (col(c) for c in ("key", "n", "at", "copy", "least"))
    _, group = np.unique(key, return_inverse=True)
    units = table["units"].to_pylist()
    place = at.tolist()
    right, right_len = _padded([u[a:] for u, a in zip(units, place, strict=True)], -(-plan.window // 8) * 8)
    left, left_len = _padded([u[:a][::-1] for u, a in zip(units, place, strict=True)], -(-max(plan.reach, 1) // 8) * 8)
    (by_right, lcp_right), (by_left, lcp_left) = multikey_sort(right, right_len, group), multikey_sort(left, left_len, group)
    out: list[list[np.ndarray]] = [[], [], []]
    count = len(key)
    class_left, class_right = np.empty(count, np.int64), np.empty(count, np.int64)
    for before in range(plan.reach + 1):  # windows with `before` bytes in front of the anchor
        valid = np.flatnonzero((before <= at) & (before >= at - n + 1))
        if not len(valid):
            continue
        class_left[by_left] = np.cumsum(lcp_left < before)
        class_right[by_right] = np.cumsum(lcp_right < plan.window - before)
        _, kind = np.unique(class_left[valid] * (count + 1) + class_right[valid], return_inverse=True)
        total = np.bincount(kind)
        low = np.full(len(total), ANY_ID)
        if plan.earlier:
            low[:] = np.iinfo(np.int64).max
            np.minimum.at(low, kind, least[valid])
        hit = np.flatnonzero((total[kind] > 1) & (copy[valid] != FIRST))
        for held, x in zip(out, (valid[hit], at[valid[hit]] - before, low[kind[hit]]), strict=True):
            held.append(x)
    rows, windows, low = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    order = np.lexsort((windows, rows))
    return rows[order], windows[order], low[order]


def _match(spans: DataFrame, plan: Plan) -> DataFrame:
    partitions = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, BUCKET):
            rows, windows, least = covered(table, plan)
            if len(rows):
                yield found_windows(table, rows, windows, least)

    leading = spans.withColumn("lead", F.expr(f"substring(units, at + 1, {plan.gram})"))
    return leading.repartitionByRange(partitions, "lead", "key").sortWithinPartitions("lead", "key").drop("lead").mapInArrow(run, FOUND_SQL)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, spans of removed bytes, kept binary) of each row.

    A byte is removed if a string of `length` bytes that covers it also starts
    at another place, in the same text or any other; strings are judged on the
    input and never cross texts. Null and empty texts have no bytes. Repeated
    rows repeat each other; rows with a null doc_id take part as all others.
    """
    plan = Plan(length, gram, False, False)
    rows = identified(docs)
    ranges = repeated(rows, plan, _match).groupBy("rid").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, words in steps(batches):
            col = lambda c: got.column(got.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            size, spans, kept = [], [], []
            for t, r in zip(words, col("ranges"), strict=True):
                data = (t or "").encode()
                a, b = merged(np.array([x["from"] for x in r or ()], np.int64), np.array([x["to"] for x in r or ()], np.int64))
                edges = [0, *(y for x in zip(a.tolist(), b.tolist(), strict=True) for y in x), len(data)]
                size.append(len(data))
                spans.append([{"from": x, "to": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(col("doc_id"), pa.int64()), pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return rows.join(ranges, "rid", "left").select("doc_id", "text", "ranges").mapInArrow(run, f"doc_id bigint, n_bytes bigint, spans {RANGES_SQL}, kept binary")
