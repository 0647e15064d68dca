"""SentencePiece (merge type) encoding by a prefix table, and decoding.

For every prefix of a text the merge procedure has exactly one last token. A
token ending at i is that token if it is a whole encoding itself (at the start)
or may follow the last token of the prefix before it, which a test of the two
alone decides: encodings in which all neighbours are compatible are the
encoding. Matches come from an Aho-Corasick automaton of the vocabulary; the
ids are then read backwards from the table's end.

A piece never has a space sign after another character, so the parts of a text
that begin at a run of spaces are encoded on their own, and a line break that
no longer piece contains splits them further; both are read from the
vocabulary. Frequent parts are remembered, within a fixed number.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from barloom.llm.common import arrow_map, array_of, texts

SIGN = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class PrefixCodec:
    """encode() and decode() as the model's library has them, without begin and end ids."""

    MOST_PARTS, MOST_PAIRS = 250_000, 1_000_000

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or any(p.type in (USER, UNUSED) for p in model.pieces) or not model.trainer_spec.byte_fallback:
            raise ValueError("the prefix table needs a byte-fallback model without normalisation rules and user-defined pieces")
        self.lead = SIGN if norm.add_dummy_prefix else ""
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        long_pieces = [p for p in self.id if len(p) > 1]
        if any(SIGN in p.lstrip(SIGN) for p in long_pieces):
            raise ValueError("a piece holds a space sign after another character")
        joined = "".join(long_pieces)
        self.cut = "" if "\n" in joined else "\n"
        self.parts = re.compile(f"\n|[{SIGN}]*[^{SIGN}\n]+|[{SIGN}]+" if self.cut else f"[{SIGN}]*[^{SIGN}]+|[{SIGN}]+").findall
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, list[int]] = {}

    def merged(self, text: str) -> list[str]:
        """The merge procedure on a short text: best score first, leftmost among equals."""
        symbols, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether left and right, side by side, stay the two tokens they are."""
        if len(self.pairs) >= self.MOST_PAIRS:
            self.pairs.clear()
        ok = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return ok

    def part_ids(self, part: str) -> list[int]:
        n, pairs = len(part), self.pairs
        last: list[str | None] = [None] * (n + 1)
        for end, token in self.automaton.iter(part):  # at each end the longest match comes first
            if last[end + 1] is not None:
                continue
            start = end + 1 - len(token)
            before = last[start] if start else ""
            if before is None:  # an unknown character joins nothing
                before = ""
            ok = pairs.get((before, token))
            if self.fits(before, token) if ok is None else ok:
                last[end + 1] = token
        out, i = [], n
        while i:
            token = last[i]
            if token is None:
                out += [self.byte_id[b] for b in reversed(part[i - 1].encode())]
                i -= 1
            else:
                out.append(self.id[token])
                i -= len(token)
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for part in self.parts(self.lead + text.replace(" ", SIGN)):
            ids = known.get(part)
            if ids is None:
                if len(known) >= self.MOST_PARTS:
                    known.clear()
                ids = self.part_ids(part)
                if len(part) <= 64:
                    known[part] = ids
            out += ids
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids) if ids else []


_codecs: dict[str, PrefixCodec] = {}


def codec(model_file: str) -> PrefixCodec:
    """One a Python worker: the tables it has learned stay for the next task."""
    if model_file not in _codecs:
        _codecs[model_file] = PrefixCodec(model_file)
    return _codecs[model_file]


def encode_decode(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each row's whole text.

    A null or empty text has no ids and decodes to "". Null ids and repeated
    rows give a row each; other columns are ignored. A row needs nothing but
    itself, so there is no shuffle and no limit on a text's length.
    """

    def make():
        c = codec(model_file)

        def step(rows: pa.RecordBatch, words: list) -> dict:
            ids = [c.encode(t) for t in words]
            return {"ids": array_of(ids, pa.int32()), "decoded": pa.array(c.decode(ids), pa.string())}

        return step

    return arrow_map(texts(docs), make, "ids array<int>, decoded string", keep=("doc_id",))
