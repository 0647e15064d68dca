"""Token ids on disk: blocks of ids, transposed to byte or bit planes, each plane compressed, with an index.

A segment is one self-contained binary value of whole documents:

    magic "BPL1" | u8 planes a id (4: byte planes, 32: bit planes) | 3 bytes 0 | u32 ids a block
    u64 ids | u32 blocks | u32 documents
    documents x (i64 doc_id, u8 has_id, u64 ids of the document)     the document index
    blocks x planes x u32                                           compressed size of each plane: the chunk index
    the planes, block after block

All numbers are little-endian. A block's k-th byte (or bit) plane has the k-th
byte (bit) of each of its ids, compressed with zstandard. The last block may be
short. Segments are rows (shard, segment, n_ids, payload) of a Parquet table in
ascending doc_id order over shards and segments.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import arrow_map, settle, texts

#: Ids of a block, of a segment, and of a range partition, about.
MAGIC, BLOCK_IDS, SEGMENT_IDS, SHARD_IDS = b"BPL1", 65_536, 1_000_000, 8_000_000
_DOC = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("n", "<u8")])


def write_segment(doc_ids: list[int | None], ids: list[np.ndarray], planes: int = 4, block_ids: int = BLOCK_IDS) -> bytes:
    """ids: each document's ids as unsigned 32-bit integers."""
    flat = np.concatenate([np.zeros(0, "<u4"), *ids])
    index = np.array([(d or 0, d is not None, len(x)) for d, x in zip(doc_ids, ids, strict=True)], _DOC)
    press, sizes, body = zstandard.ZstdCompressor(level=3), [], []
    for at in range(0, len(flat), block_ids):
        block = flat[at : at + block_ids].view(np.uint8).reshape(-1, 4)
        if planes == 32:
            block = np.packbits(np.unpackbits(block, axis=1, bitorder="little"), axis=0).T
        else:
            block = block.T
        for plane in block:
            body.append(press.compress(np.ascontiguousarray(plane).tobytes()))
            sizes.append(len(body[-1]))
    head = MAGIC + struct.pack("<B3xIQII", planes, block_ids, len(flat), -(-len(flat) // block_ids), len(index))
    return b"".join([head, index.tobytes(), np.array(sizes, "<u4").tobytes(), *body])


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, the number of ids of each, and all ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a bit-plane segment")
    planes, block_ids, total, blocks, docs = struct.unpack_from("<B3xIQII", data, 4)
    at = 4 + struct.calcsize("<B3xIQII")
    index = np.frombuffer(data, _DOC, docs, at)
    at += index.nbytes
    sizes = np.frombuffer(data, "<u4", blocks * planes, at).reshape(blocks, planes)
    at += sizes.nbytes
    open_, out = zstandard.ZstdDecompressor(), np.empty(total, "<u4")
    for k in range(blocks):
        n = min(block_ids, total - k * block_ids)
        rows = []
        for size in sizes[k].tolist():
            rows.append(np.frombuffer(open_.decompress(data[at : at + size]), np.uint8))
            at += size
        if planes == 32:
            block = np.packbits(np.unpackbits(np.stack(rows).T, axis=0)[:n], axis=1, bitorder="little")
        else:
            block = np.stack(rows, axis=1)
        out[k * block_ids : k * block_ids + n] = np.ascontiguousarray(block).view("<u4").ravel()
    return [d if h else None for d, h in zip(index["doc_id"].tolist(), index["has_id"].tolist(), strict=True)], index["n"].astype(np.int64), out


#: Classes of bytes: letters, digits, other signs, the apostrophe, white space, and bytes whose class is not known from themselves.
_LETTER, _DIGIT, _SIGN, _APOSTROPHE, _BLANK, _UNSURE, _EDGE = range(7)
#: A byte that no UTF-8 text has; it stands between texts.
EDGE = b"\xff"


def _byte_classes() -> np.ndarray:
    out = np.full(256, _UNSURE, np.uint8)
    out[:128] = _SIGN
    for chars, kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", _LETTER), (b"0123456789", _DIGIT), (b"'", _APOSTROPHE), (b"\t\n\x0b\x0c\r ", _BLANK)):
        out[np.frombuffer(chars, np.uint8)] = kind
    out[EDGE[0]] = _EDGE
    return out


_CLASS = _byte_classes()


def cut_points(data: np.ndarray) -> np.ndarray:
    """Places of bytes (UTF-8 texts, an EDGE before, between and after them) where the byte-level pre-tokenizer always cuts.

    A run of white space ends before its last character, which goes with what
    follows if it is a space; runs of letters, digits and other signs end where
    another class begins. Nothing is cut beside an apostrophe or characters
    whose class the bytes do not show, but for white space that is surely not
    part of a longer run.
    """
    kind = _CLASS[data]
    wide = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))  # Latin letters of two bytes, save the signs of times and division
    wide = wide[(data[wide] != 0xC3) | ((data[wide + 1] != 0x97) & (data[wide + 1] != 0xB7))]
    kind[wide] = kind[wide + 1] = _LETTER
    left, right = kind[:-1], kind[1:]
    sure = kind <= _APOSTROPHE  # not white space
    blank = kind == _BLANK
    cut = (left != right) & (left <= _SIGN) & (right <= _SIGN)
    cut |= (kind == _EDGE)[:-1] | (kind == _EDGE)[1:]
    cut |= sure[:-1] & blank[1:]  # a run begins
    last = np.flatnonzero(blank[:-1] & sure[1:])  # a run's last character
    cut[last[last > 0] - 1] = True
    cut[last[data[last] != 32]] = True
    return np.flatnonzero(cut) + 1


#: A space, then ASCII signs or Latin letters of two bytes, none of which is white space.
_ALONGSIDE = re.compile(rb" (?:[!-~]|[\xc3-\xc5][\x80-\xbf])+")


class ByteEncoder:
    """Ids of whole texts as the tokenizers library gives them, remembering parts.

    Texts are cut where the byte-level pre-tokenizer always cuts; a batch's
    distinct parts are encoded by the library and each occurrence takes its ids.
    Texts with special strings, and all texts if the file's pre-tokenizer is
    another one, are encoded as a whole.
    """

    #: Parts that are remembered; bytes of parts that the library encodes in one call.
    MOST, AT_ONCE = 1_500_000, 200_000

    def __init__(self, file: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(file)
        self.lib.no_truncation()
        self.lib.no_padding()
        made = json.loads(self.lib.to_str())
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.end = end_id
        first = made.get("pre_tokenizer") or {}
        self.byte_level = first.get("type") == "ByteLevel" and not first.get("add_prefix_space", True) and first.get("use_regex", True) and made.get("normalizer") is None
        vocabulary = self.lib.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids of pieces that begin with a space
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used, self.begin, self.size = np.zeros(1 << 16, "<u4"), 0, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _remember(self, parts: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.known), len(self.known) + len(parts)
        if m > len(self.begin):
            self.begin, self.size = (np.resize(x, 2 * m) for x in (self.begin, self.size))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[n:m] = sizes
        self.begin[n:m] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.known.update(zip(parts, range(n, m), strict=True))

    def _learn(self, parts: list[bytes]) -> None:
        """Parts of a space and signs that are surely no white space go to the library side by side, as one text: each piece that begins with a space begins a part."""
        fits = list(map(_ALONGSIDE.fullmatch, parts))
        joined, alone = [p for p, m in zip(parts, fits, strict=True) if m], [p for p, m in zip(parts, fits, strict=True) if not m]
        at = 0
        while at < len(joined):
            end, total = at, 0
            while end < len(joined) and total < self.AT_ONCE:
                total += len(joined[end])
                end += 1
            ids = self.whole(b"".join(joined[at:end]).decode())
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != end - at:
                raise ValueError("the vocabulary has pieces that hold spaces inside")
            self._remember(joined[at:end], ids, np.diff(np.append(starts, len(ids))))
            at = end
        for at in range(0, len(alone), 2_000):
            some = alone[at : at + 2_000]
            ids = [e.ids for e in self.lib.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self._remember(some, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), sizes)

    def encode(self, words: list[str | None]) -> list[np.ndarray]:
        """Each text's ids, the end id last."""
        out: list[np.ndarray | None] = [None] * len(words)
        plain = []
        for i, t in enumerate(words):
            if not self.byte_level or t and any(x in t for x in self.special):
                out[i] = np.append(self.whole(t or ""), np.uint32(self.end))
            else:
                plain.append(i)
        if not plain:
            return out
        data = np.frombuffer(EDGE + EDGE.join((words[i] or "").encode() for i in plain) + EDGE, np.uint8)
        cuts = cut_points(data)
        begins, ends = cuts[:-1], cuts[1:]
        edge = data[begins] == EDGE[0]  # between two texts
        text_of, real = np.concatenate([[0], np.cumsum(edge)])[:-1], ~edge
        begins, text_of = begins[real], text_of[real]
        sizes = ends[real] - begins
        if len(begins):
            packed = data[data != EDGE[0]]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            coded = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
            _, spans, joined = coded.dictionary.buffers()
            joined, spans = joined.to_pybytes(), np.frombuffer(spans, np.int32)[: len(coded.dictionary) + 1].tolist()
            parts = [joined[a:b] for a, b in zip(spans, spans[1:], strict=False)]  # to_pylist() takes ten times as long
            if len(self.known) > self.MOST:
                self._forget()
            self._learn([p for p in parts if p not in self.known])
            place = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))[np.asarray(coded.indices)]
            n_ids = self.size[place]
            before = np.cumsum(n_ids) - n_ids
            ids = self.flat[np.repeat(self.begin[place] - before, n_ids) + np.arange(int(n_ids.sum()))]
            per_text = np.bincount(text_of, n_ids, len(plain)).astype(np.int64)
        else:
            ids, per_text = np.zeros(0, "<u4"), np.zeros(len(plain), np.int64)
        ends = np.cumsum(per_text)
        for k, (i, a, b) in enumerate(zip(plain, (ends - per_text).tolist(), ends.tolist(), strict=True)):
            out[i] = np.append(ids[a:b], np.uint32(self.end))
        return out


_encoders: dict[tuple[str, int], ByteEncoder] = {}


def write_ids(docs: DataFrame, file: str, path: str, end_id: int, planes: int = 4, block_ids: int = BLOCK_IDS, segment_ids: int = SEGMENT_IDS, shard_ids: int = SHARD_IDS) -> None:
    """Encode each row's whole text and write segments to the Parquet folder path.

    Texts are encoded where they lie; the ids go to range partitions of doc_id
    (null first), as many as give about shard_ids each, and are sorted there.
    Rows of one doc_id are dealt by a hash besides, so none of them gathers in
    one task. A null text is empty: it has the end id alone. Repeated rows and
    ids stay, side by side.
    """

    def make():
        if (file, end_id) not in _encoders:
            _encoders[file, end_id] = ByteEncoder(file, end_id)
        encoder = _encoders[file, end_id]

        def step(rows: pa.RecordBatch, words: list) -> dict:
            ids = encoder.encode(words)
            return {"n": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array(list(map(packed_ids, ids)), pa.binary())}

        return step

    encoded = settle(arrow_map(texts(docs), make, "n bigint, ids binary", keep=("doc_id",)), "ids").withColumn("salt", F.xxhash64("n", "ids"))
    total = encoded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = encoded.repartitionByRange(max(8, -(-total // shard_ids)), "doc_id", "salt").sortWithinPartitions("doc_id", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, held_docs, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        one = lambda: pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([size], pa.int64()), pa.array([write_segment(held_docs, held, planes, block_ids)], pa.binary())], names=["shard", "segment", "n_ids", "payload"])
        for rows in batches:
            for d, x in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                held_docs.append(d)
                held.append(unpacked_ids(x))
                size += len(held[-1])
                if size >= segment_ids:
                    yield one()
                    segment, held_docs, held, size = segment + 1, [], [], 0
        if held:
            yield one()

    dealt.select("doc_id", "ids").mapInArrow(run, "shard int, segment int, n_ids bigint, payload binary").write.parquet(path)


_press, _open = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed_ids(ids: np.ndarray) -> bytes:
    """Ids for a shuffle: two byte planes if all fit, else four, compressed; the last byte is their number."""
    width = 2 if ids.max(initial=0) < 65_536 else 4
    planes = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return _press.compress(np.ascontiguousarray(planes).tobytes()) + bytes([width])


def unpacked_ids(data: bytes) -> np.ndarray:
    width = data[-1]
    planes = np.frombuffer(_open.decompress(data[:-1]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}").astype("<u4")


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document from the segments at path.

    start counts the ids of all documents before. The totals of shards, of
    which there are as many as partitions were written, give each its base;
    segments add up within their shard. An empty folder gives no rows.
    """
    table = spark.read.schema("shard int, segment int, n_ids bigint, payload binary").parquet(path)
    shards = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    before = table.select("shard", "segment", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")).alias("within"))
    starts = before.join(F.broadcast(base), "shard").select("shard", "segment", (F.col("base") + F.col("within")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, n, ids = read_segment(data.as_py())
                ends = np.cumsum(n)
                begins = ends - n
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begins + first, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.join(starts, ["shard", "segment"]).select("first", "payload").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
