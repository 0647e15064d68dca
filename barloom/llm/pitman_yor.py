"""Hierarchical Pitman-Yor language model over words, sampled by Gibbs, and the scores it gives texts.

A token's restaurant is the word before it. Words that make up at least SHARE of
the training tokens have one whose parent is the word's last character, hashed
into 256 places: there are at most 1 / SHARE such words, so their list and a
number for each may be sent along, whatever the corpus. Each rarer word has one
too, without discount, whose parent is its last two characters, hashed into 4096
places (a start mark has its own at a text's begin); theirs are the 256 places,
and those' is the root, over a uniform base.

Without discount, how a dish is seated does not depend on the other dishes of
the restaurant, so no numbers of the rarer words' restaurants need be sent. Their
customers only divide chances; as each of a word's occurrences has one token
after it, an occurrence carries that token's divisor, from its own word's shard.

Words are dealt to shards by hash. All seatings of one word, at all levels, lie
in its shard; of the rest of the corpus a seating needs only each restaurant's
number of tables. So a sweep is one pass over the shards with those numbers
sent along, and the numbers it gives are summed for the next. A shard keeps no
seating: it draws the earlier sweeps again from their seeds and numbers. Before
a dish is seated anew in a restaurant, its customers there leave, and so do the
customers that their tables stand for in the parent. Shards hold a bounded number
of tokens, so there are more of them for a larger corpus.

Seating c customers of a dish, the chance of a new table before the k-th joins
an old one follows a Polya urn; the wait for the next new table is geometric
with a beta-distributed rate, so a seating costs a draw a table, not a customer.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import lower_ascii, scramble, settle, steps, words_of

#: Tokens of a map batch; sweeps, and those of them that count for nothing; strength of all restaurants.
BATCH_TOKENS, SWEEPS, BURN_IN, STRENGTH = 2_000_000, 4, 1, 1.0
#: Restaurants of rarer words' endings; share of the training tokens from which a word has its own; tokens of a shard.
PLACES, SHARE, SHARD_TOKENS = 4096, 2e-5, 3_000_000
#: Tokens of a batch that are sorted at a time.
SLICE_TOKENS = 250_000
#: Strength of rarer words' own restaurants.
RARE_STRENGTH = 10.0
#: Flags of a pair: after a rarer word; a rarer word itself.
DEEP, RARE = 1, 2
_LOW = np.uint64(PLACES - 1)


def _place(word: str) -> int:
    """A word's two last characters as a restaurant; its parent is the number without the last 4 bits."""
    return (ord(word[-1]) * 2654435761 >> 7) % 256 * 16 + ((ord(word[-2]) * 2246822519 >> 9) % 16 if len(word) > 1 else 0)


class Tokens(dict):
    """64-bit hash of a token whose low 12 bits are the restaurant of the token after it."""

    MOST = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) & ~(PLACES - 1) | _place(word)
        return h


END = xxhash.xxh3_64_intdigest("end", 1) & ~(PLACES - 1)
START = PLACES - 1


def text_tokens(text: str | None, tokens: Tokens) -> np.ndarray:
    """Tokens of a text with the end."""
    words = words_of(lower_ascii(text)) if text else []
    return np.append(np.fromiter(map(tokens.__getitem__, words), np.uint64, len(words)), np.uint64(END))


def restaurants(words: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Restaurant of the tokens after each word. own: sorted, the words with a restaurant of their own."""
    after = (words & _LOW).astype(np.int64)
    if len(own):
        at = np.minimum(np.searchsorted(own, words), len(own) - 1)
        after = np.where(own[at] == words, PLACES + at, after)
    return after


def parents(own: np.ndarray) -> np.ndarray:
    """Parent of each restaurant."""
    return np.concatenate([np.arange(PLACES), (own & _LOW).astype(np.int64)]) >> 4


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, by byte planes, compressed."""
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays) if len(arrays[0]) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    types = [np.dtype(k) for k in kinds]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8) if data else np.zeros(0, np.uint8)
    n, out, at = len(raw) // sum(t.itemsize for t in types), [], 0
    for t in types:
        out.append(np.ascontiguousarray(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T).reshape(-1).view(t) if n else np.zeros(0, t))
        at += n * t.itemsize
    return out


_ENTRY = ("<u8", "<u2", "<u8", "<u4", "<u4")  # token, restaurant, rarer word before (or 0), occurrences in training texts, in all texts


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and the place of each value among them; np.unique's inverse in half the memory."""
    order = np.argsort(values)
    inner = values[order]
    new = np.ones(len(inner), bool)
    new[1:] = inner[1:] != inner[:-1]
    inner = inner[new]
    index = np.empty(len(values), "<u4")
    index[order] = np.cumsum(new, dtype="<u4") - np.uint32(1)
    return inner, index


def _tokens(docs: DataFrame) -> DataFrame:
    """(batch, docs, held, sizes, trained, words, index) of batches of whole texts: each token as its word's number in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ids, held, sizes, parts, seen = Tokens(), [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(parts)
            parts.clear()
            words, index = _numbered(flat)
            del flat
            trained = np.bincount(index[np.repeat(~np.array(held, bool), sizes)], minlength=len(words))
            values = {"batch": uuid.uuid4().int >> 65, "docs": ids, "held": held, "sizes": sizes, "trained": int(trained.sum()), "words": _pack(words.astype("<u8"), trained.astype("<u4")), "index": _pack(index)}
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values.values(), kinds, strict=True)], names=list(values))

        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
        for got, words in steps(batches):
            for d, x, t in zip(got.column(got.schema.get_field_index("doc_id")).to_pylist(), got.column(got.schema.get_field_index("held")).to_pylist(), words, strict=True):
                h = text_tokens(t, tokens)
                ids.append(d)
                held.append(x)
                sizes.append(len(h))
                parts.append(h)
                seen += len(h)
                if seen >= BATCH_TOKENS or len(ids) == 65_000:
                    yield flush()
                    ids, held, sizes, parts, seen = [], [], [], [], 0
        if ids:
            yield flush()

    return docs.mapInArrow(run, "batch bigint, docs array<bigint>, held array<boolean>, sizes array<bigint>, trained bigint, words binary, index binary")


def _common(texts: DataFrame, share: float = SHARE) -> tuple[np.ndarray, int]:
    """The training words with at least share of the training tokens, sorted, and the number of all tokens.

    A batch lists the words that make up half that share of its own tokens, so
    what it leaves out of a word's count is under half a share of all.
    """
    total, trained = texts.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for data in got.column(0):
                h, n = _unpack(data.as_py(), "<u8", "<u4")
                often = (n > 0) & (n >= share / 2 * n.sum()) & (h != END)
                yield pa.RecordBatch.from_arrays([pa.array(h[often].astype(np.int64)), pa.array(n[often].astype(np.int64))], names=["word", "n"])

    counted = texts.select("words").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    own = counted.where(F.col("n") >= max(2.0, share * trained)).select("word").toArrow()["word"].to_numpy()  # at most 1 / share rows
    return np.sort(own.astype(np.int64).view(np.uint64)), total


def _slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Neighbouring shards taken together while they have at most so many tokens; a larger one is alone."""
    out, low, total = [], 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > low and total + n > most:
            out.append((low, k))
            low, total = k, 0
        total += n
    return [*out, (low, len(sizes))]


def _batches(texts: DataFrame, shards: int, own: np.ndarray) -> DataFrame:
    """(shard, batch, entries, refs): a batch's distinct (token, word before) pairs with their counts, and which texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for row in range(got.num_rows):
                name, held, sizes, words, index = (got.column(i)[row].as_py() for i in range(5))
                words, (index,) = _unpack(words, "<u8", "<u4")[0], _unpack(index, "<u4")
                of_word = (scramble(words) % np.uint64(shards)).astype(np.int32)
                dealt = np.lexsort((words, of_word))
                rank = np.empty(len(words), "<u4")
                rank[dealt] = np.arange(len(words), dtype="<u4")
                after = restaurants(words, own)
                code = np.where(after < PLACES, np.arange(len(words)) + (1 << 16), after).astype("<u4")  # rarer words by their number
                before = np.empty(len(index), "<u4")
                before[1:] = code[index[:-1]]
                before[np.cumsum([0, *sizes[:-1]])] = START
                index = rank[index]
                doc = np.repeat(np.arange(len(sizes), dtype="<u2"), sizes)
                training = np.repeat(~np.array(held, bool), sizes)
                size_of = np.bincount(of_word, np.bincount(index, minlength=len(words))[rank], shards)
                for low, high in _slices(size_of, SLICE_TOKENS):
                    first, end = np.searchsorted(of_word[dealt], [low, high])
                    mine = np.flatnonzero((index >= first) & (index < end))
                    if not len(mine):
                        continue
                    pair = index[mine].astype(np.uint64) << np.uint64(32) | before[mine]
                    order = np.argsort(pair, kind="stable")  # documents stay in order
                    pair, mine = pair[order], mine[order]
                    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
                    count = np.diff(np.append(starts, len(pair))).astype("<u4")
                    known = np.add.reduceat(training[mine].astype("<u4"), starts).astype("<u4")
                    size = len(pair)
                    pair = pair[starts]
                    word = dealt[(pair >> np.uint64(32)).astype(np.int64)]
                    place = (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    rare, name_of = np.flatnonzero(place >= 1 << 16), np.zeros(len(place), "<u8")
                    prior = place[rare] - (1 << 16)
                    place[rare] = after[prior]
                    name_of[rare] = words[prior] >> np.uint64(16) | np.uint64(1)  # 48 bits tell a place's words apart
                    place, of_pair = place.astype("<u2"), of_word[word]
                    for s in np.unique(of_pair).tolist():
                        a, b = np.searchsorted(of_pair, [s, s + 1])
                        hi = starts[b] if b < len(starts) else size
                        values = [s, name, _pack(words[word[a:b]].astype("<u8"), place[a:b], name_of[a:b], known[a:b], count[a:b]), _pack(doc[mine[starts[a] : hi]])]
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "batch", "entries", "refs"])

    return texts.select("batch", "held", "sizes", "words", "index").mapInArrow(run, "shard int, batch bigint, entries binary, refs binary")


def _runs(word: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Number of each pair's (word, place); those of one follow each other."""
    new = np.zeros(len(word), np.int32)
    new[1:] = (word[1:] != word[:-1]) | (place[1:] != place[:-1])
    return np.cumsum(new, dtype=np.int32)


def _gathered(table: pa.Table, own: np.ndarray) -> pa.Table:
    """applyInArrow over a shard: its distinct (token, word before) pairs with training counts, and where texts have them."""
    parts = [_unpack(data.as_py(), *_ENTRY) for data in table["entries"]]
    sizes = [len(x[0]) for x in parts]
    h, place, before, known, count = (np.concatenate([x.pop(0) for x in parts]) for _ in _ENTRY)
    index, first, top = np.empty(len(h), "<u4"), [], (h >> np.uint64(60)).astype(np.uint8)
    for k in range(16):  # by the hash's first bits, so that a part is sorted at a time
        order = np.flatnonzero(top == k)
        order = order[np.lexsort((before[order], place[order], h[order]))]
        new = np.ones(len(order), bool)
        new[1:] = False
        for x in (h, place, before):
            x = x[order]
            new[1:] |= x[1:] != x[:-1]
        index[order] = np.cumsum(new) + (sum(map(len, first)) - 1)
        first.append(order[new])
    first = np.concatenate(first)
    h, place, deep = h[first], place[first], before[first] > 0
    del before, top
    total = np.bincount(index, known, len(first)).astype("<u8")
    word = np.zeros(len(h), np.int32)
    word[1:] = np.cumsum(h[1:] != h[:-1], dtype=np.int32)
    per_word = np.bincount(word, total)
    per_place = np.bincount(_runs(word, place), total)
    flags = np.where(deep, np.uint8(DEEP), np.uint8(0)) | np.where((restaurants(h, own) >= PLACES) | (h == END), np.uint8(0), np.uint8(RARE))
    refs, at = [], 0
    for n, docs in zip(sizes, table["refs"], strict=True):
        refs.append({"where": _pack(index[at : at + n], count[at : at + n]), "docs": docs.as_py()})
        at += n
    level = lambda x: [int((x == k).sum()) for k in (1, 2)]
    return pa.table(
        {
            "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
            "words": pa.array([_pack(word.astype("<u4"), place.astype("<u2"), total)], pa.binary()),
            "flags": pa.array([_pack(flags.astype("u1"))], pa.binary()),
            "batches": pa.array([table["batch"].to_pylist()], pa.list_(pa.int64())),
            "refs": pa.array([refs], pa.list_(pa.struct([("where", pa.binary()), ("docs", pa.binary())]))),
            "n": pa.array([int(total.sum())], pa.int64()),
            "v": pa.array([int((per_word > 0).sum())], pa.int64()),
            "singles": pa.array([level(per_place) + level(per_word)], pa.list_(pa.int64())),
        }
    )


_GATHERED = "shard int, words binary, flags binary, batches array<bigint>, refs array<struct<where:binary,docs:binary>>, n bigint, v bigint, singles array<bigint>"


def seat(count: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that count customers of a dish take, drawn one table at a time; weight: of a new table."""
    tables = (count > 0).astype(np.int64)
    seated = tables.copy()
    active = np.flatnonzero(count > 1)
    while len(active):
        n, t = seated[active], tables[active]
        rate = np.clip(rng.beta(np.maximum(weight[active], 1e-9), n - discount * t), 1e-12, 1.0)
        n = n + rng.geometric(rate)
        opened = n <= count[active]
        active = active[opened]
        seated[active] = n[opened]
        tables[active] += 1
    return tables


class Shard:
    """The seatings of a shard's words.

    Of pairs: customers `count` and tables t3 in the rarer words' restaurants; a
    pair without the flag DEEP has none, its customers go on to its place. Of
    (word, place), numbered by `at`: customers c2 and tables t2.
    """

    def __init__(self, data: bytes, number: int, base: float, discounts: tuple[float, float, float], above: np.ndarray | None = None, flags: bytes = b""):
        self.pair_word, place, count = _unpack(data, "<u4", "<u2", "<u8")
        self.count = count.astype(np.int64)
        self.flags = _unpack(flags, "u1")[0] if flags else np.zeros(len(count), np.uint8)
        self.deep = (self.flags & DEEP) > 0
        self.many = np.flatnonzero(self.deep & (self.count > 1))
        self.at = _runs(self.pair_word, place)
        starts = np.flatnonzero(np.diff(self.at, prepend=-1))
        self.word, self.place = self.pair_word[starts], place[starts].astype(np.int64)
        self.number, self.base, self.d = number, base, discounts
        self.above = parents(np.zeros(0, np.uint64)) if above is None else above
        n_words = int(self.word[-1]) + 1 if len(self.word) else 0
        pair = self.word.astype(np.int64) * 256 + self.above[self.place]
        named, self.parent = _numbered(pair)
        self.parent_word, self.parent_place = named // 256, named % 256
        self.t3 = np.where(self.deep, np.minimum(self.count, 1), self.count)
        self.c2 = np.bincount(self.at, self.t3, len(self.word)).astype(np.int64)
        self.t2, self.t1, self.t0 = (self.c2 > 0).astype(np.int64), np.zeros(len(named), np.int64), np.zeros(n_words, np.int64)
        self.c1 = np.bincount(self.parent, self.t2, len(named)).astype(np.int64)
        self.t1 = (self.c1 > 0).astype(np.int64)
        self.c0 = np.bincount(self.parent_word, self.t1, n_words).astype(np.int64)
        self.t0 = (self.c0 > 0).astype(np.int64)

    def chances(self, tables: list[np.ndarray], totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each (word, place) the word's chance in the place, in its parent and in the root. tables: numbers of tables by level (places, parents, root)."""
        d2, d1, d0 = self.d
        t2, t1, t0 = tables
        c1, c0 = np.bincount(self.above, t2, 256), t1.sum()
        p0 = (self.c0 - d0 * self.t0 + (STRENGTH + d0 * t0[0]) * self.base) / (STRENGTH + c0)
        p1 = (self.c1 - d1 * self.t1 + (STRENGTH + d1 * t1[self.parent_place]) * p0[self.parent_word]) / (STRENGTH + c1[self.parent_place])
        p2 = (self.c2 - d2 * self.t2 + (STRENGTH + d2 * t2[self.place]) * p1[self.parent]) / (STRENGTH + totals[self.place])
        return p2, p1, p0

    def undivided(self, p2: np.ndarray) -> np.ndarray:
        """Of each pair the word's chance, after a rarer word times RARE_STRENGTH and that word's training occurrences."""
        p = p2[self.at]
        return np.where(self.deep, self.count + RARE_STRENGTH * p, p)

    def divisors(self) -> np.ndarray:
        """Of each pair what its word's restaurant, if it has one as a rarer word, divides the chances of the token after it by."""
        return np.where(self.flags & RARE, RARE_STRENGTH + np.bincount(self.pair_word, self.count)[self.pair_word], 1.0)

    @staticmethod
    def _without(customers: np.ndarray, tables: np.ndarray, leaving: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of a dish once some customers, of any of its tables, have left."""
        left = customers - leaving
        return left, np.where(left > 0, np.maximum(1, np.rint(tables * (left / np.maximum(customers, 1)))), 0)

    def sweep(self, k: int, tables: list[np.ndarray], totals: np.ndarray) -> None:
        """Seat all customers anew, given the numbers of tables after the sweep before, each dish without its own customers."""
        rng = np.random.default_rng([self.number, k])
        d2, d1, d0 = self.d
        t2, t1, t0 = tables
        all1, all0 = np.bincount(self.above, t2, 256), t1.sum()
        _, p1, p0 = self.chances(tables, totals)

        at, own = self.at[self.many], self.t3[self.many]
        c2, n2 = self._without(self.c2[at], self.t2[at], own)
        p2 = (c2 - d2 * n2 + (STRENGTH + d2 * (t2[self.place[at]] - self.t2[at] + n2)) * p1[self.parent[at]]) / (STRENGTH + totals[self.place[at]] - own)
        self.t3[self.many] = seat(self.count[self.many], RARE_STRENGTH * p2, 0.0, rng)
        self.c2 = np.bincount(self.at, self.t3, len(self.c2)).astype(np.int64)

        home, own = self.parent_place[self.parent], self.t2
        c1, n1 = self._without(self.c1[self.parent], self.t1[self.parent], own)
        p1 = (c1 - d1 * n1 + (STRENGTH + d1 * (t1[home] - self.t1[self.parent] + n1)) * p0[self.parent_word][self.parent]) / (STRENGTH + all1[home] - own)
        self.t2 = seat(self.c2, (STRENGTH + d2 * (t2[self.place] - own)) * p1, d2, rng)

        own = self.t1
        c0, n0 = self._without(self.c0[self.parent_word], self.t0[self.parent_word], own)
        p0 = (c0 - d0 * n0 + (STRENGTH + d0 * (t0[0] - self.t0[self.parent_word] + n0)) * self.base) / (STRENGTH + all0 - own)
        self.c1 = np.bincount(self.parent, self.t2, len(self.c1)).astype(np.int64)
        self.t1 = seat(self.c1, (STRENGTH + d1 * (t1[self.parent_place] - own)) * p0, d1, rng)

        self.c0 = np.bincount(self.parent_word, self.t1, len(self.c0)).astype(np.int64)
        self.t0 = seat(self.c0, (STRENGTH + d0 * (t0[0] - self.t0)) * self.base, d0, rng)

    def tables(self) -> list[np.ndarray]:
        return [np.bincount(self.place, self.t2, len(self.above)), np.bincount(self.parent_place, self.t1, 256), np.array([float(self.t0.sum())])]


def _numbers(rows: DataFrame, base: float, discounts: tuple, above: np.ndarray, history: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Numbers of tables by level, and of the places' customers, after len(history) sweeps: a task's shards are summed, then the tasks."""
    size = len(above)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * size + 257)
        for got in batches:
            for number, data, flags in zip(got.column(0).to_pylist(), got.column(1), got.column(2), strict=True):
                shard = Shard(data.as_py(), number, base, discounts, above, flags.as_py())
                for k, numbers in enumerate(history):
                    shard.sweep(k, *numbers)
                out += np.concatenate([*shard.tables(), np.bincount(shard.place, shard.c2, size)])
                del shard  # before the next is made
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at], pa.float64())], names=["at", "x"])

    sums = rows.select("shard", "words", "flags").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # at most 2 * (4096 + 1 / SHARE) + 257 rows
    out = np.zeros(2 * size + 257)
    out[sums["at"].to_numpy()] = sums["x"].to_numpy()
    return [out[:size], out[size : size + 256], out[size + 256 : size + 257]], out[size + 257 :]


def scores(docs: DataFrame, held_out_of: int = 10, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    A row is held out if crc32 of its doc_id as text is divisible by
    held_out_of (so is a row without an id); the others train the model. score
    is log10 of the text's probability, averaged over the sweeps' predictive
    chances; base_score that of a unigram model with 0.1 added. A null or empty
    text is the end token alone. Repeated rows count as often as they occur.
    """
    spark = docs.sparkSession
    crc = F.coalesce(F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary")), F.lit(0))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), (crc % held_out_of == 0).alias("held"))
    texts = settle(_tokens(rows), "lm-tokens")
    own, tokens = _common(texts)
    above = parents(own)
    batches = _batches(texts, max(12, -(-tokens // SHARD_TOKENS)), own)
    gathered = settle(batches.groupBy("shard").applyInArrow(lambda t: _gathered(t, own), _GATHERED), "lm-shards")
    n, v, *singles = gathered.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0)), *(F.coalesce(F.sum(F.col("singles")[i]), F.lit(0)) for i in range(4))).first()
    of = lambda one, two: min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
    d2, d0 = of(*singles[:2]), of(*singles[2:])
    discounts, base = (d2, (d2 + d0) / 2, d0), 1.0 / (v + 1)

    history = []
    for _ in range(sweeps + 1):
        history.append(_numbers(gathered, base, discounts, above, history))
    floor = np.log10(n + 0.1 * (v + 1))

    def score(got_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in got_batches:
            for number, data, flags, names, refs in zip(*(got.column(i) for i in range(5)), strict=True):
                shard = Shard(data.as_py(), number.as_py(), base, discounts, above, flags.as_py())
                mean = np.zeros(len(shard.count))
                for k in range(sweeps):
                    shard.sweep(k, *history[k])
                    if k >= burn_in:
                        mean += shard.undivided(shard.chances(*history[k + 1])[0])
                log = np.log10(mean / (sweeps - burn_in)) - np.log10(shard.divisors())
                train = np.bincount(shard.pair_word, shard.count)
                plain = (np.log10(train + 0.1) - floor)[shard.pair_word]
                known = (train > 0)[shard.pair_word]
                del shard, mean, train
                for name, ref in zip(names.as_py(), refs, strict=True):
                    index, count = _unpack(ref["where"].as_py(), "<u4", "<u4")
                    doc = _unpack(ref["docs"].as_py(), "<u2")[0].astype(np.int64)
                    token = np.repeat(index, count)
                    size = int(doc.max()) + 1
                    sums = [np.bincount(doc, x[token], size) for x in (log, plain, known.astype(np.float64))]
                    has = np.flatnonzero(np.bincount(doc, minlength=size))
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([_pack(has.astype("<u2"))], pa.binary()), pa.array([b"".join(s[has].tobytes() for s in sums)], pa.binary())], names=["batch", "which", "sums"])

    partial = gathered.select("shard", "words", "flags", "batches", "refs").mapInArrow(score, "batch bigint, which binary, sums binary")

    def together(table: pa.Table) -> pa.Table:
        listed = next(r for r in table.to_pylist() if r["docs"])
        total = np.zeros((3, len(listed["docs"])))
        for which, sums in zip(table["which"], table["sums"], strict=True):
            if which.as_py():
                has = _unpack(which.as_py(), "<u2")[0]
                total[:, has] += np.frombuffer(sums.as_py(), np.float64).reshape(3, -1)
        return pa.table({"doc_id": pa.array(listed["docs"], pa.int64()), "held_out": pa.array(listed["held"], pa.bool_()), "n_tokens": pa.array(listed["sizes"], pa.int64()), "n_known": pa.array(np.rint(total[2]).astype(np.int64)), "train_tokens": pa.array([n] * len(listed["docs"]), pa.int64()), "base_score": pa.array(total[1]), "score": pa.array(total[0])})

    none = lambda kind: F.lit(None).cast(kind)
    listed = texts.select("batch", "docs", "held", "sizes", none("binary").alias("which"), none("binary").alias("sums"))
    both = listed.unionByName(partial.select("batch", none("array<bigint>").alias("docs"), none("array<boolean>").alias("held"), none("array<bigint>").alias("sizes"), "which", "sums"))
    return both.groupBy("batch").applyInArrow(together, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
