"""Quality classifier: a small convolutional network over the bytes of a text.

Filters of WIDTH bytes run over the whole text. Their greatest answers in each
half chunk are kept; two neighbouring halves make a chunk, so chunks overlap by
half and cover everything. A chunk's pooled answers go through one hidden
layer, the greatest of each hidden unit over all chunks are combined into one
probability. Because a filter sees a byte's identity alone, its answer is a sum
of WIDTH table rows: scoring is array look-ups, additions and maxima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import STEP_CHARS, settle

#: Bytes that a filter sees, filters, hidden units of a chunk, bytes of half a chunk.
WIDTH, FILTERS, HIDDEN, HALF = 5, 24, 16, 128
#: Bounds of the sample that the network learns from: rows of each label, bytes of a row.
SAMPLE_ROWS, SAMPLE_BYTES = 1_500, 16_000
EPOCHS, BATCH, RATE, DECAY = 10, 32, 3e-3, 1e-4
#: Half chunks worked on at a time: their answers stay in the processor's cache.
SPAN = 64


class ByteNet:
    """The network's numbers: filters[k, b] is what byte b at place k of a window adds to each filter."""

    def __init__(self, seed: int = 0, prior: float = 0.5):
        rng = np.random.default_rng(seed)
        self.filters = (rng.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.hidden = (rng.standard_normal((FILTERS, HIDDEN)) * 0.3).astype(np.float32)
        self.hidden_bias = np.zeros(HIDDEN, np.float32)
        self.out = (rng.standard_normal(HIDDEN) * 0.3).astype(np.float32)
        self.out_bias = np.array([np.log(prior / (1 - prior))], np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def answers(self, padded: np.ndarray) -> np.ndarray:
        """(windows, filters): a window ends at each of the bytes but the first WIDTH - 1."""
        n = len(padded) - WIDTH + 1
        total = self.filters[0].take(padded[:n], axis=0)
        for k in range(1, WIDTH):
            total += self.filters[k].take(padded[k : k + n], axis=0)
        return total

    def halves(self, padded: np.ndarray) -> np.ndarray:
        """(half chunks, filters): greatest answers, before the bias, of what padded_bytes() gives."""
        n = (len(padded) - WIDTH + 1) // HALF
        out = np.empty((n, FILTERS), np.float32)
        for a in range(0, n, SPAN):
            b = min(n, a + SPAN)
            self.answers(padded[a * HALF : b * HALF + WIDTH - 1]).reshape(b - a, HALF, FILTERS).max(axis=1, out=out[a:b])
        return out

    def scores(self, padded: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text, which has so many half chunks."""
        chunks, starts = _chunks(self.halves(padded), counts)
        h = np.maximum(np.maximum(chunks + self.bias, 0) @ self.hidden + self.hidden_bias, 0)
        z = np.maximum.reduceat(h, starts, axis=0) @ self.out + self.out_bias[0]
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def _chunks(halves: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of two neighbouring halves, and where each text's begin; a text of one half is one chunk."""
    ends = np.cumsum(counts)
    chunks = np.maximum(halves, np.concatenate([halves[1:], halves[-1:]]))
    chunks[ends - 1] = halves[ends - 1]  # a text's last half pairs with none after it
    return chunks, ends - counts


def padded_bytes(texts: list[bytes | memoryview]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in a row after WIDTH - 1 zeros, each filled up with that many zeros or more to whole half chunks, and their numbers of half chunks.

    So a window, wherever it ends, holds bytes of one text.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-(sizes + WIDTH - 1) // HALF)
    out = np.zeros(int(counts.sum()) * HALF + WIDTH - 1, np.uint8)
    at = WIDTH - 1
    for t, n in zip(texts, counts.tolist(), strict=True):
        if len(t):
            out[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * HALF
    return out, counts


class Learner:
    """Adam on the weighted log loss; a maximum passes its gradient to the place it came from."""

    def __init__(self, net: ByteNet):
        self.net, self.t = net, 0
        self.m = [np.zeros_like(p) for p in net.parts()]
        self.v = [np.zeros_like(p) for p in net.parts()]

    def step(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> float:
        net = self.net
        padded, counts = padded_bytes(texts)
        n = int(counts.sum())
        answers = net.answers(padded).reshape(n, HALF, FILTERS)
        peak = answers.argmax(axis=1)
        halves = np.take_along_axis(answers, peak[:, None], axis=1)[:, 0]
        ends = np.cumsum(counts)
        partner = np.arange(n) + 1
        partner[ends - 1] = ends - 1
        second = halves[partner] > halves
        chunks = np.where(second, halves[partner], halves)
        source = np.where(second, partner[:, None], np.arange(n)[:, None])  # of each chunk and filter: the half it came from
        pooled = np.maximum(chunks + net.bias, 0)
        pre = pooled @ net.hidden + net.hidden_bias
        h = np.maximum(pre, 0)
        starts = ends - counts
        top = np.maximum.reduceat(h, starts, axis=0)
        z = top @ net.out + net.out_bias[0]
        p = 1 / (1 + np.exp(-z))
        share = weights / weights.sum()
        dz = ((p - labels) * share).astype(np.float32)
        d_out, d_out_bias = top.T @ dz, np.array([dz.sum()], np.float32)
        d_top = dz[:, None] * net.out
        owner = np.repeat(np.arange(len(texts)), counts)
        is_top = (h == top[owner]) & (h > 0)
        ties = np.add.reduceat(is_top.astype(np.float32), starts, axis=0)
        d_pre = np.where(is_top, d_top[owner] / np.maximum(ties, 1)[owner], 0).astype(np.float32)
        d_hidden, d_hidden_bias = pooled.T @ d_pre, d_pre.sum(axis=0)
        d_pool = np.where(pooled > 0, d_pre @ net.hidden.T, 0).astype(np.float32)
        d_bias = d_pool.sum(axis=0)
        rows, cols = np.nonzero(d_pool)
        half = source[rows, cols]
        place = half * HALF + peak[half, cols]
        d_filters = np.zeros_like(net.filters)
        for k in range(WIDTH):
            flat = padded[place + k].astype(np.int64) * FILTERS + cols
            d_filters[k] = np.bincount(flat, d_pool[rows, cols], minlength=256 * FILTERS).reshape(256, FILTERS)
        self._move([d_filters, d_bias, d_hidden, d_hidden_bias, d_out, d_out_bias])
        return float(-(share * np.where(labels > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum())

    def _move(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.net.parts(), grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * ((m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8) + DECAY * p)


def fit(texts: list[bytes], labels: list[int], share: float | None = None, seed: int = 0, epochs: int = EPOCHS) -> ByteNet:
    """A network from whole texts; share is label 1's part of the rows that the sample stands for (by default its part of the sample).

    Without texts, or with one label only, the network gives every text the smoothed share.
    """
    y = np.array(labels, np.float32)
    if not 0 < y.sum() < len(y):
        net = ByteNet(seed, float((y.sum() + 1) / (len(y) + 2)))
        net.out[:] = 0
        return net
    part = float(y.mean())
    share = part if share is None else share
    weights = np.where(y > 0, share / part, (1 - share) / (1 - part)).astype(np.float32)
    net, rng = ByteNet(seed, share), np.random.default_rng(seed)
    learner = Learner(net)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            at = order[a : a + BATCH]
            learner.step([texts[i] for i in at], y[at], weights[at])
    return net


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, seed: int = 0) -> ByteNet:
    """A network from labels (doc_id, quality) of docs.

    It learns from a bounded sample: of each label the `rows` doc_ids of least
    hash among those with a text of at most most_bytes bytes. Null labels and
    ids are left out; an id labelled twice counts as its least label; of rows
    of one id one text is taken, the least.
    """
    marked = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["quality"].cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = settle(marked, "labels")
    total = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    short = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).where(F.octet_length("text") <= most_bytes)
    able = settle(marked.join(short.select("doc_id").distinct(), "doc_id", "left_semi"), "able")  # ids alone are shuffled
    picked = None
    for q in (0, 1):
        part = able.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = part if picked is None else picked.unionAll(part)
    picked = settle(picked.coalesce(1), "picked")  # at most 2 * rows ids
    sample = short.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    share = total.get(1, 0) / max(1, sum(total.values()))
    return fit([r["text"].encode() for r in sample], [r["quality"] for r in sample], share if 0 < share < 1 else None, seed)


def quality_scores(docs: DataFrame, net: ByteNet) -> DataFrame:
    """(doc_id bigint, score double): the network's probability of label 1 for every whole text.

    Null texts count as empty; an empty text is one chunk of padding, so all
    empty texts share one score. Equal texts have equal scores, repeated rows a
    row each, null ids stay null; an empty table gives no rows. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in batches:
            raw = b.column(1).cast(pa.large_binary()).to_pylist()
            score = np.empty(len(raw))
            a, total = 0, 0
            for i, t in enumerate(raw):
                total += len(t or b"")
                if total >= STEP_CHARS or i + 1 == len(raw):
                    score[a : i + 1] = net.scores(*padded_bytes([x or b"" for x in raw[a : i + 1]]))
                    a, total = i + 1, 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("binary").alias("raw")).mapInArrow(run, "doc_id bigint, score double")
