"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton of all items' words is built once a block of items and sent to
the tasks; texts stream through it. The length of the longest match that ends
at each word tells which words lie in a window of an item. Blocks bound what is
sent: a larger benchmark makes more passes, never a larger broadcast.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import arrow_map, lower_ascii, settle, texts

#: Words: all but ASCII characters other than digits and letters.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Words of items of one automaton, about.
BLOCK_WORDS = 200_000


class Automaton:
    """Generalised suffix automaton over words: windows of n words, or a whole item that is shorter."""

    def __init__(self, items: list[tuple[str, list[str]]], n: int):
        self.n, self.names = n, [name for name, _ in items]
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[set[int]] = [set()]
        whole: dict[int, set[int]] = {}
        for item, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._add(last, w, ends)
                ends[last].add(item)
            if 0 < len(words) < n:
                whole.setdefault(self._walk(words), set()).add(item)
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)
        for v in order:
            ends[self.link[v]] |= ends[v]
        #: of each state: the state of its suffix of n words, or -1; the items that hold that window
        self.window = [-1] * len(self.len)
        self.items: dict[int, tuple[int, ...]] = {}
        #: of each state: whole short items that are suffixes of its words, as (length, state)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.len)
        for v in reversed(order):
            p = self.link[v]
            self.window[v] = v if self.len[p] < n <= self.len[v] else self.window[p]
            self.short[v] = self.short[p]
            if v in whole:  # its length is the item's: of the state's words only the longest or shorter ones by link
                self.short[v] += tuple(sorted({(len(items[i][1]), v) for i in whole[v]}))
            if self.window[v] == v:
                self.items[v] = tuple(sorted(ends[v]))
        self.whole = {v: tuple(sorted(x)) for v, x in whole.items()}
        self.words = {w for d in self.next for w in d}
        self.least = min([n, *(len(w) for _, w in items if w)])

    def _walk(self, words: list[str]) -> int:
        v = 0
        for w in words:
            v = self.next[v][w]
        return v

    def _new(self, length: int, ends: list[set[int]]) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        ends.append(set())
        return len(self.len) - 1

    def _split(self, p: int, w: str, q: int, ends: list[set[int]]) -> int:
        """A copy of q for words of length len(p) + 1 and less."""
        c = self._new(self.len[p] + 1, ends)
        self.next[c] = dict(self.next[q])
        self.link[c], self.link[q] = self.link[q], c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _add(self, last: int, w: str, ends: list[set[int]]) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, w, q, ends)
        v, p = self._new(self.len[last] + 1, ends), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = v
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[v] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q, ends)
        return v

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit words as disjoint ranges [from, to) in order, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        known = np.fromiter(map(self.words.__contains__, words), bool, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - begin >= self.least:  # no match reaches over an unknown word
                self._run(words, begin, end, spans, items)
        return spans, items

    def _run(self, words: list[str], begin: int, end: int, spans: list, items: set[int]) -> None:
        nexts, link, lens, n, v, length = self.next, self.link, self.len, self.n, 0, 0
        for i in range(begin, end):
            w = words[i]
            q = nexts[v].get(w)
            if q is None:
                while v and q is None:
                    v = link[v]
                    q = nexts[v].get(w)
                length = lens[v]
            v, length = q, length + 1
            hit = 0
            if length >= n:
                hit = n
                items.update(self.items[self.window[v]])
            for m, s in self.short[v]:
                if m <= length:
                    hit = max(hit, m)
                    items.update(self.whole[s])
            if hit:
                a = i + 1 - hit
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))


def item_words(text: str | None) -> list[str]:
    return WORD.findall(lower_ascii(text)) if text else []


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[str]]]]:
    """Items in blocks by the hash of their id, of about block_words words each."""
    rows = settle(items.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull()), "items")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 4
    n = max(1, -(-total // block_words))
    for b in range(n):
        got = [(r["item_id"], item_words(r["text"])) for r in rows.where(F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(""))), F.lit(n)) == b).collect()]
        yield sorted(((i, w) for i, w in got if w), key=lambda x: (x[0] is not None, x[0] or "", x[1]))


SPANS = "array<struct<from:int,to:int>>"


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, text, n_words bigint, spans array of hit words [from, to), items array<string>) of each row.

    A hit word lies in an occurrence of n consecutive words of an item, or of a
    whole item that has fewer. Words are taken after A-Z are lower-cased. Null
    or empty texts and items have no words; an empty items table hits nothing;
    items with a null id hit but are not listed; repeated rows give a row each.
    """
    spark = docs.sparkSession
    out = texts(docs).withColumns({"spans": F.lit(None).cast(SPANS), "items": F.lit(None).cast("array<string>"), "n_words": F.lit(0).cast("bigint")})
    span_type = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    for block in _blocks(items, block_words):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def make(sent=sent):
            auto = _automaton(sent, n)

            def step(rows: pa.RecordBatch, words: list) -> dict:
                spans_in, items_in = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("spans", "items"))
                spans, found, counts = [], [], []
                for t, s0, i0 in zip(words, spans_in, items_in, strict=True):
                    w = item_words(t)
                    s, i = auto.scan(w) if w else ([], set())
                    spans.append([{"from": a, "to": b} for a, b in _union([(x["from"], x["to"]) for x in s0 or ()], s)])
                    found.append(sorted({*(i0 or ()), *(auto.names[k] for k in i if auto.names[k] is not None)}))
                    counts.append(len(w))
                return {"spans": pa.array(spans, span_type), "items": pa.array(found, pa.list_(pa.string())), "n_words": pa.array(counts, pa.int64())}

            return step

        out = arrow_map(out, make, f"spans {SPANS}, items array<string>, n_words bigint", keep=("doc_id", "text"))
    return out


_automata: dict[tuple[str, int], Automaton] = {}


def _automaton(sent, n: int) -> Automaton:
    """Built once a worker and block."""
    name, block = sent.value
    if (name, n) not in _automata:
        _automata.clear()
        _automata[name, n] = Automaton(block, n)
    return _automata[name, n]


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if not a:
        return b
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = out[-1][0], max(y, out[-1][1])
        else:
            out.append((x, y))
    return out


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from a span's first word to its last."""
    out, at = [], 0
    places = [(m.start(), m.end()) for m in WORD.finditer(lower_ascii(text))]
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs, with all its columns, without hit spans; rows of which more than max_coverage of the words are hit go.

    Rows without hits stay as they are, null texts included.
    """
    own = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    kind = own.schema["row"].dataType
    spark = docs.sparkSession
    out = own.withColumns({"spans": F.lit(None).cast(SPANS)})
    span_type = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    for block in _blocks(items, BLOCK_WORDS):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def make(sent=sent):
            auto = _automaton(sent, n)

            def step(rows: pa.RecordBatch, words: list) -> dict:
                before = rows.column(rows.schema.get_field_index("spans")).to_pylist()
                spans, share, cut = [], [], []
                for t, s0 in zip(words, before, strict=True):
                    w = item_words(t)
                    s = _union([(x["from"], x["to"]) for x in s0 or ()], auto.scan(w)[0] if w else [])
                    spans.append([{"from": a, "to": b} for a, b in s])
                    share.append(sum(b - a for a, b in s) / len(w) if w else 0.0)
                    cut.append(cut_spans(t, s) if s else t)
                return {"spans": pa.array(spans, span_type), "share": pa.array(share, pa.float64()), "cut": pa.array(cut, pa.string())}

            return step

        out = arrow_map(out.select("row", "doc_id", "text", "spans"), make, f"spans {SPANS}, share double, cut string", keep=("row", "doc_id", "text"))
    kept = out.where(F.col("share") <= max_coverage)
    return kept.select(*(F.col("cut").alias(f.name) if f.name == "text" else F.col("row")[f.name].alias(f.name) for f in kind.fields))


def items_digest(items: Column) -> Column:
    """Lowercase hex sha256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)
