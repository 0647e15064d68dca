"""Spelling variants: words one edit apart, found by comparing tiles of code-point matrices.

Words that one insertion, deletion or replacement turns into each other agree
on all but one place: common prefix and common suffix together reach the longer
length minus one. Pairs are keyed by the place P where the prefix ends: a group
holds words of lengths m and m + 1 that share their first `lo` and last m - `hi`
code points, and finds the pairs with lo <= P < hi. Halving [lo, hi) splits any
group that is too large, so a prefix that a third of all words share is no hot
group: at hi - lo = 1 all members differ in one code point, of 90.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import discard, lower_ascii, settle, steps, texts

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words that a task counts before it hands them on.
MOST_WORDS = 200_000
#: Members and code points beyond which a group is split.
GROUP_WORDS, GROUP_CHARS = 2_048, 1 << 20
#: Rows of a tile, and cells of its matrix.
TILE, CELLS = 64, 1 << 20


def _misspelt(words: Counter, doc_id: int | None, every: int, least: int, into: Counter) -> None:
    """Add a text's runs to `into`, one code point less where `every` divides the hash of id and run."""
    seed = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for w, n in words.items():
        h = zlib.crc32(w.encode(), seed)
        if h % every == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
            if len(w) < least:
                continue
        into[w] += n


def word_counts(docs: DataFrame, every: int = 31, least: int = 7) -> DataFrame:
    """(word, n): the words of at least `least` code points of all texts and how often each occurs.

    A word is a maximal run of Latin letters, A-Z lower-cased; a run loses one
    code point where `every` divides its hash. Null texts have none; a null
    doc_id hashes as an empty one.
    """
    # a run of fewer code points cannot give a word, but must not be cut out of a longer one: runs are maximal
    run_of = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for rows, words in steps(batches):
            ids = rows.column(rows.schema.get_field_index("doc_id")).to_pylist()
            for i, t in zip(ids, words, strict=True):
                if t:
                    _misspelt(Counter(run_of.findall(lower_ascii(t))), i, every, least, total)
                    if len(total) >= MOST_WORDS:
                        yield out()
                        total.clear()
        yield out()

    return texts(docs).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """rows (word, n, m) as members of the group for [lo, hi)."""
    suffix = F.greatest(F.col("m") - hi, F.lit(0))
    key = F.concat_ws(":", F.lpad(F.col("m").cast("string"), 9, "0"), lo.cast("string"), hi.cast("string"), F.substring("word", F.lit(1), lo), F.when(suffix > 0, F.substring(F.col("word"), -suffix, suffix)).otherwise(""))
    return rows.select("word", "n", "m", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), key.alias("key"))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row as a member of the two groups for the halves of [lo, hi)."""
    mid = F.expr("(lo + hi) div 2").cast("int")
    return _keyed(rows, F.col("lo"), mid).unionAll(_keyed(rows, mid, F.col("hi")))


def _groups(words: DataFrame) -> Iterator[DataFrame]:
    """Tables (word, n, m, lo, hi, key): each pair of near words shares one key in one of them."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    rows = _halved(rows.select("*", F.lit(0).alias("lo"), (F.col("m") + 1).alias("hi")))
    while True:
        sized = settle(rows.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.length("word")).alias("chars"), F.max(F.col("hi") - F.col("lo")).alias("range"), F.min(F.length("word") - F.col("m")).alias("over")).where("members > 1 and over = 0"), "groups")
        too_large = (F.col("range") > 1) & ((F.col("members") > GROUP_WORDS) | (F.col("chars") > GROUP_CHARS) & (F.col("members") > 2))
        yield rows.join(sized.where(~too_large).select("key"), "key", "left_semi")
        if sized.where(too_large).isEmpty():
            return
        rows = settle(_halved(rows.join(sized.where(too_large).select("key"), "key", "left_semi")), "halved")
        discard(sized)


def _matrix(words: list[bytes], width: int, pad: int) -> np.ndarray:
    """Code points (all below 256) of the words, one row each, padded at the right."""
    return np.frombuffer(b"".join(w.ljust(width, bytes([pad])) for w in words), np.uint8).reshape(len(words), width)


def _common(a: np.ndarray, b: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of a with each row of b, where wanted."""
    alive, out = want.copy(), np.zeros(want.shape, np.int32)
    for k in range(a.shape[1]):
        alive &= a[:, k, None] == b[None, :, k]
        if not alive.any():
            break
        out += alive
    return out


def _near_pairs(words: list[bytes], group: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of near words among rows sorted by group, tile against tile; each pair once."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    tiles, at = [], 0
    while at < len(words):
        end = min(len(words), at + max(1, min(TILE, CELLS // int(size[at : at + TILE].max()))))
        tiles.append((at, end))
        at = end
    last = np.searchsorted(group, group, side="right")  # where each row's group ends
    for x, (a, b) in enumerate(tiles):
        for c, d in tiles[x:]:
            if c >= last[b - 1] and c > a:
                break
            want = group[a:b, None] == group[None, c:d]
            want &= (size[a:b] == m[a:b])[:, None] | (size[c:d] == m[c:d])[None, :]  # two of length m + 1 meet in another group
            if c == a:
                want &= np.arange(b - a)[:, None] < np.arange(d - c)[None, :]
            if not want.any():
                continue
            width = int(max(size[a:b].max(), size[c:d].max()))
            prefix = _common(_matrix(words[a:b], width, 0), _matrix(words[c:d], width, 1), want)
            want &= (prefix >= lo[a:b, None]) & (prefix < hi[a:b, None])
            if not want.any():
                continue
            suffix = _common(_matrix([w[::-1] for w in words[a:b]], width, 0), _matrix([w[::-1] for w in words[c:d]], width, 1), want)
            longer = np.maximum(size[a:b, None], size[None, c:d])
            i, j = np.nonzero(want & (prefix + suffix >= longer - 1))
            yield i + a, j + c


def _links(rows: DataFrame) -> DataFrame:
    """(word, n_near, best struct<down, word>): each row's near words of its groups, their number and the one of largest n.

    Rows of a key come together by hash and sort; a task holds a batch and the
    one group that passes its end.
    """
    dealt = rows.select("key", "word", "n", "m", "lo", "hi").repartition("key").sortWithinPartitions("key")

    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        keys = t.column("key").chunk(0) if t.num_rows else pa.array([], pa.string())
        group = np.concatenate([[0], np.cumsum(np.asarray(pc.not_equal(keys[1:], keys[:-1])))]) if t.num_rows else np.zeros(0, np.int64)
        words = t.column("word").to_pylist()
        coded = [w.encode("latin-1") for w in words]
        n = t.column("n").to_numpy()
        m, lo, hi = (t.column(c).to_numpy().astype(np.int64) for c in ("m", "lo", "hi"))
        found: dict[str, list] = {}
        for i, j in _near_pairs(coded, group, m, lo, hi):
            for a, b in zip([*i.tolist(), *j.tolist()], [*j.tolist(), *i.tolist()], strict=True):
                other = (-int(n[b]), words[b])
                have = found.setdefault(words[a], [0, other])
                have[0] += 1
                if other < have[1]:
                    have[1] = other
        best = pa.StructArray.from_arrays([pa.array([x[1][0] for x in found.values()], pa.int64()), pa.array([x[1][1] for x in found.values()], pa.string())], names=["down", "word"])
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array([x[0] for x in found.values()], pa.int64()), best], names=["word", "n_near", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the batch read last, and the start of its last group
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0)
            differs = np.flatnonzero(np.asarray(pc.not_equal(keys, keys[b.num_rows - 1])))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            if cut or (held and held[-1].column(0)[0] != keys[0]):
                yield solve(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield solve(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "word string, n_near bigint, best struct<down:bigint,word:string>")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): of each of the distinct words that has near ones, their number and the one of largest n, ties to the smallest."""
    found = None
    for rows in _groups(words):
        part = settle(_links(rows), "links")
        found = part if found is None else found.unionAll(part)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following forms ends. Each round doubles the steps that a row has gone."""
    out = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = out.select(F.col("word").alias("via"), F.col("root").alias("further"))
        longer = settle(out.join(on, out["root"] == on["via"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if longer.where("moved").isEmpty():
            return longer.select("word", "root")
        discard(out)
        out = longer.select("word", "root")


def variants(docs: DataFrame, least: int = 7, times: int = 2, factor: int = 10, every: int = 31) -> DataFrame:
    """(word, form, root string; n, n_near, form_n bigint) of each word of at least `least` code points that occurs `times` times in all.

    Words are near that differ by one inserted, deleted or replaced code point.
    A word's form is its near word of largest n, ties to the smallest in
    code-point order, if that n is at least `factor` times its own; root is
    where following forms ends, the word itself if it has none. Null and empty
    texts have no words, repeated rows count again, an empty table gives no
    rows; words may be of any length. Other columns are not read.
    """
    words = settle(word_counts(docs, every, least).where(F.col("n") >= times), "words")
    near = near_words(words).withColumnRenamed("word", "of")
    picked = F.when(-F.col("best.down") >= factor * F.col("n"), F.struct(F.col("best.word").alias("form"), (-F.col("best.down")).alias("form_n")))
    linked = settle(words.join(near, F.col("word") == F.col("of"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), picked.alias("pick")), "linked")
    ends = roots(linked.where("pick is not null").select("word", F.col("pick.form").alias("form"))).withColumnRenamed("word", "of")
    return linked.join(ends, F.col("word") == F.col("of"), "left").select("word", F.col("pick.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("pick.form_n").alias("form_n"))
