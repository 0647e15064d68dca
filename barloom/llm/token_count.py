"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced where both agree.

A chunk's encoding may differ from the whole text's only near its ends. Two
neighbouring chunks are joined inside their overlap, at a boundary that is
proven to be one of the whole text's encoding:

* merge-type SentencePiece (.model): an encoding is right exactly if each two
  neighbouring tokens are right on their own. Where both chunks hold the same
  two tokens at the same offsets, the left chunk's tokens up to their boundary
  and the right chunk's from there on are compatible neighbours throughout.
* byte-level BPE (.json): a single space before a non-space always begins a
  pre-token, so encodings on its two sides are independent.

If an overlap holds no such place, the overlap is doubled, up to the whole text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import arrow_map, texts

#: Characters of a chunk and of the first overlap; a text of up to two chunks is encoded at once.
CHUNK, OVERLAP = 32_768, 256


class PieceChunks:
    def __init__(self, file: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=file)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.lib.encode(texts, num_threads=1)] if texts else []

    def spans(self, text: str, at: int) -> list[tuple[int, int, int]]:
        """(begin, end, id) in characters of the whole text."""
        e = self.lib.encode(text, return_type="offset_mapping")
        return [(a + at, b + at, i) for (a, b), i in zip(e["offsets"], e["ids"], strict=True)]

    def joint(self, text: str, left: list, right: list) -> tuple[int, int] | None:
        """Tokens of left before the boundary, tokens of right before it."""
        places = {(a, b): i for i, (a, b) in enumerate(zip(right, right[1:], strict=False)) if a[0] < a[1] and b[0] < b[1]}
        for k in range(len(left) - 2, 0, -1):
            i = places.get((left[k], left[k + 1]))
            if i is not None and i > 0:  # the first token of a chunk has the model's lead sign
                return k + 1, i + 1
            if left[k][0] < right[0][0]:
                break
        return None


class ByteChunks:
    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(file)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.single = re.compile(r"(?<=\S) (?=\S)")

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.lib.encode_batch(texts, add_special_tokens=False)] if texts else []

    def spans(self, text: str, at: int) -> list[tuple[int, int, int]]:
        e = self.lib.encode(text, add_special_tokens=False)
        return [(a + at, b + at, i) for (a, b), i in zip(e.offsets, e.ids, strict=True)]

    def joint(self, text: str, left: list, right: list) -> tuple[int, int] | None:
        begin, end = right[0][0], left[-1][1]
        if any(s in text[begin:end] for s in self.special):
            return None
        places = {t[0]: i for i, t in enumerate(right) if i}
        for k in range(len(left) - 1, 0, -1):
            p = left[k][0]
            if p <= begin:
                break
            if p in places and p + 1 < end and self.single.match(text, p) and left[k - 1][1] == p:
                return k, places[p]
        return None


def chunked_count(lib: PieceChunks | ByteChunks, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text by overlapping chunks; the same as lib.counts([text])."""
    total, end = 0, min(len(text), chunk)
    left = lib.spans(text[:end], 0)
    while end < len(text):
        wide = overlap
        while True:
            start = end - wide
            if 2 * wide > chunk or start <= left[0][0]:  # no agreement within half a chunk: begin again with wider ones
                return chunked_count(lib, text, 2 * chunk, 2 * overlap)
            stop = min(len(text), end + chunk)
            right = lib.spans(text[start:stop], start)
            if found := lib.joint(text, left, right):
                total += found[0]
                left, end = right[found[1] :], stop
                break
            wide *= 2
    return total + len(left)


_libraries: dict[str, PieceChunks | ByteChunks] = {}


def library(file: str) -> PieceChunks | ByteChunks:
    if file not in _libraries:
        _libraries[file] = PieceChunks(file) if file.endswith(".model") else ByteChunks(file)
    return _libraries[file]


def token_counts(docs: DataFrame, file: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes bigint, n_tokens bigint) of each row's whole text, without begin, end and special tokens.

    A null or empty text has 0 tokens; repeated rows and null ids give a row
    each; other columns are ignored. No shuffle; memory is a chunk's however
    long the text is.
    """

    def make():
        lib = library(file)

        def step(rows: pa.RecordBatch, words: list) -> dict:
            short = [i for i, t in enumerate(words) if t and len(t) <= 2 * chunk]
            n = [0] * len(words)
            for i, k in zip(short, lib.counts([words[i] for i in short]), strict=True):
                n[i] = k
            for i, t in enumerate(words):
                if t and len(t) > 2 * chunk:
                    n[i] = chunked_count(lib, t, chunk, overlap)
            return {"n_tokens": pa.array(n, pa.int64()), "n_bytes": pa.array([len(t.encode()) if t else 0 for t in words], pa.int64())}

        return step

    return arrow_map(texts(docs), make, "n_bytes bigint, n_tokens bigint", keep=("doc_id",))
