"""Near-duplicate groups by b-bit MinHash.

1. Each text's set of word shingles gives K minima. R of them at a time make
   the key of a band; the low BITS of each are packed into a signature.
2. Texts with the same set are one class; only classes go on.
3. In each bucket (a band's key) every class is paired with one class of the
   bucket, another one in each band, rather than with all. The signatures'
   equal fields, counted by bits and corrected for chance, sift the pairs.
4. Of each class the likeliest pair is confirmed on the full sets, components
   are joined, pairs inside a component go, and so on with more of the pairs
   that are left, until none is.
5. Buckets that still hold several components give the pairs between them
   whose finer sketches agree; these go through step 4 as well, so no link
   between different texts depends on the choice in step 3. A large bucket is
   cut into blocks, and each two blocks that may hold a link are a group of
   their own; blocks of its largest component meet only classes outside it.

With 32 bands of 4 a pair at a threshold of 0.85 shares no bucket once in
2e10 cases, at 0.8 once in 2e7; the sift is five standard deviations wide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import WordHashes, array_of, arrow_map, lower_ascii, scramble, settle, texts, window_hashes, words_of
from barloom.llm.components import components

K, R, BITS, WORDS = 128, 4, 4, 5
#: Standard deviations by which an estimate of a pair at the threshold may fall short: of the signature, of the finer sketch.
SLACK, FINE_SLACK = 5.2, 4.1
#: Likeliest pairs of a class that each round confirms at most, from the second round on times this number.
WIDER = 40
#: The finer sketch of classes in buckets of several components: minima and bits.
FINE_K, FINE_BITS = 4096, 2
#: Classes of such a bucket that are held against each other at once; a larger one is cut into blocks of about as many.
BLOCK = 1024
#: Numbers of a minima step that are held at once; they fit a core's cache.
CELLS = 131_072
_A = np.random.default_rng(7).integers(0, 2**31, FINE_K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = np.random.default_rng(8).integers(0, 2**32, FINE_K, dtype=np.uint32)


def shingles(text: str | None, hashes: WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct runs of n words (A-Z lower-cased); of all words if they are fewer; none without words."""
    words = words_of(lower_ascii(text)) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(hashes.of(words), min(n, len(words))) ^ np.uint64(min(n, len(words))))


def minima(items: np.ndarray, k: int = K) -> np.ndarray:
    """The least of the items' high 32 bits under each of k bijections of 32-bit words."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    low, step = np.full(k, np.iinfo(np.uint32).max, np.uint32), max(1, CELLS // k)
    held = np.empty((min(step, len(x)), k), np.uint32)
    for at in range(0, len(x), step):
        part = x[at : at + step]
        moved = held[: len(part)]
        np.bitwise_xor(part[:, None], _B[None, :k], out=moved)
        np.multiply(moved, _A[None, :k], out=moved)
        np.minimum(low, moved.min(axis=0), out=low)
    return low.astype(np.uint64)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = scramble(low).reshape(-1, R)
    key = np.arange(len(rows), dtype=np.uint64)
    for c in range(R):
        key = scramble(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, c])
    return key.view(np.int64)


def signature(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of each minimum, packed into 64-bit words."""
    fields = (scramble(low) & np.uint64((1 << bits) - 1)).reshape(-1, 64 // bits)
    return np.bitwise_or.reduce(fields << (np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits)), axis=1).view(np.int64)


def similarity(x: Column, y: Column) -> Column:
    """Estimated from two signatures: the share of equal fields, corrected for those equal by chance."""
    unequal = F.lit(0)
    for i in range(K // 16):
        d = x[i].bitwiseXOR(y[i])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3)).bitwiseAND(F.lit(0x1111111111111111))
        unequal = unequal + F.bit_count(d)
    chance = 2.0**-BITS
    return ((1 - unequal / F.lit(float(K))) - chance) / (1 - chance)


def cutoff(percent: int, k: int, bits: int, deviations: float) -> float:
    """The least estimate that k minima of some bits let pass at a threshold of percent."""
    chance = 2.0**-bits
    equal = chance + (1 - chance) * percent / 100
    return percent / 100 - deviations * math.sqrt(equal * (1 - equal) / k) / (1 - chance)


def features(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, cid: hash of the set or null if empty, sig, bands)."""

    def make():
        hashes = WordHashes()

        def step(rows: pa.RecordBatch, words: list) -> dict:
            size, cid, sig, bands = [], [], [], []
            for t in words:
                s = shingles(t, hashes, n)
                size.append(len(s))
                cid.append(int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else None)
                low = minima(s) if len(s) else None
                sig.append(signature(low) if low is not None else ())
                bands.append(band_keys(low) if low is not None else ())
            return {"n_shingles": pa.array(size, pa.int64()), "cid": pa.array(cid, pa.int64()), "sig": array_of(sig, pa.int64()), "bands": array_of(bands, pa.int64())}

        return step

    return arrow_map(texts(docs), make, "n_shingles bigint, cid bigint, sig array<bigint>, bands array<bigint>", keep=("doc_id",))


def _confirmed(pairs: DataFrame, held: DataFrame, percent: int, n: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * intersection >= percent * union, on the full sets of held (cid, text)."""
    joined = pairs.join(held.select(F.col("cid").alias("b"), F.col("text").alias("b_text")), "b").join(held.select(F.col("cid").alias("a"), F.col("text").alias("a_text")), "a").select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, mine = WordHashes(), None, None
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i in range(len(a)):
                if a[i] != last:
                    last, mine = a[i], shingles(batch.column(2)[i].as_py(), hashes, n)
                other = shingles(batch.column(3)[i].as_py(), hashes, n)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(a, keep, strict=True) if k], pa.int64()), pa.array([x for x, k in zip(b, keep, strict=True) if k], pa.int64())], names=["a", "b"])

    return joined.mapInArrow(run, "a bigint, b bigint")


def _mixed(own: DataFrame, hubs: DataFrame) -> DataFrame:
    """(key, cid, n, label, m): the m classes, of own (cid, n, label, bands), of each bucket of hubs (key) that has several components."""
    in_buckets = own.select("cid", "n", "label", F.explode("bands").alias("key")).join(hubs.select("key"), "key", "left_semi")
    mixed = in_buckets.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m")).where("x <> y and m > 2").select("key", "m")
    return in_buckets.join(mixed, "key")


def _blocks(members: DataFrame, percent: int) -> DataFrame:
    """(key, a, b, left, cid, label, n): of members (key, cid, label, n, m) the groups (key, a, b) to be compared.

    A bucket of m <= BLOCK is one group. Of a larger one each two blocks a <= b
    are a group, save both in the largest component, or of sizes that can't fit;
    left tells whose block a row is of, and if a = b all are left. Each pair of
    different components that may link is in one group of a bucket.
    """
    whole = members.where(F.col("m") <= BLOCK).select("key", F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(True).alias("left"), "cid", "label", "n")
    large = members.where(F.col("m") > BLOCK)
    main = large.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    step = max(math.log(100 / percent), 1e-3) * (1 + 1e-9)  # sizes that fit are in one class of sizes or in neighbours
    kinds = large.join(main, "key").withColumns({"rest": (F.col("label") != F.col("main")).cast("int"), "size": F.floor(F.log(F.col("n").cast("double")) / step)})
    cells = kinds.groupBy("key", "rest", "size").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    name = lambda salt: F.shiftleft(F.col("size") * 2 + F.col("rest"), 32) + salt
    placed = kinds.join(cells, ["key", "rest", "size"]).select("key", "cid", "label", "n", name(F.pmod(F.xxhash64("cid"), "blocks")).alias("block"))
    named = cells.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).withColumn("block", name(F.col("salt")))
    side = lambda x: named.select("key", F.col("block").alias(x), F.col("rest").alias(f"{x}_rest"), F.col("size").alias(f"{x}_size"))
    both = side("a").join(side("b"), "key").where((F.col("a") <= F.col("b")) & (F.col("a_rest") + F.col("b_rest") > 0) & (F.abs(F.col("a_size") - F.col("b_size")) <= 1)).select("key", "a", "b")
    out = lambda rows, x, left: rows.withColumn("block", F.col(x)).join(placed, ["key", "block"]).select("key", "a", "b", F.lit(left).alias("left"), "cid", "label", "n")
    return whole.unionByName(out(both, "a", True)).unionByName(out(both.where("a < b"), "b", False))


def _between(least: float, percent: int):
    """applyInArrow over a group (key, a, b, left, cid, label, n, fine, bands): likely pairs of different components.

    Where all rows are left, each class outside the group's largest component is
    held against all others at once, by bit counts of the finer sketches; else
    each class of the side with fewer against the other side. Only likely pairs
    leave, and each from the first bucket that holds both.
    """
    chance = 2.0**-FINE_BITS
    low_bits = np.uint64(0x5555555555555555)

    def pairs(table: pa.Table) -> pa.Table:
        cid, label, n, left = (np.asarray(table[c].combine_chunks()) for c in ("cid", "label", "n", "left"))
        sig = np.asarray(table["fine"].combine_chunks().flatten()).view(np.uint64).reshape(len(cid), -1)
        bands = np.asarray(table["bands"].combine_chunks().flatten()).reshape(len(cid), -1)
        before = bands[:, : int(np.flatnonzero(bands[0] == table["key"][0].as_py())[0])]
        out_a, out_b, out_est = [], [], []
        place = np.full(len(cid), -1)
        if left.all():
            kinds, count = np.unique(label, return_counts=True)
            rest = np.flatnonzero(label != kinds[count.argmax()])
            place[rest] = np.arange(len(rest))
        else:
            fewer = left if 2 * left.sum() <= len(left) else ~left
            rest = np.flatnonzero(fewer)
            place[rest] = len(rest)
        for k, i in enumerate(rest.tolist()):
            small, large = np.minimum(n, n[i]), np.maximum(n, n[i])
            near = np.flatnonzero((label != label[i]) & (100 * small >= percent * large) & (place < k))
            d = sig[near] ^ sig[i]
            unequal = np.bitwise_count((d | (d >> np.uint64(1))) & low_bits).sum(axis=1)
            est = ((1 - unequal / FINE_K) - chance) / (1 - chance)
            likely = est >= least
            likely[likely] = ~(before[near[likely]] == before[i]).any(axis=1)
            hit = near[likely]
            out_a.append(np.minimum(cid[hit], cid[i]))
            out_b.append(np.maximum(cid[hit], cid[i]))
            out_est.append(est[likely])
        cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        return pa.table({"a": cat(out_a, pa.int64()), "b": cat(out_b, pa.int64()), "est": cat(out_est, pa.float64())})

    return pairs


def _fine(held: DataFrame, n: int) -> DataFrame:
    """(cid, fine, bands) of held (cid, text)."""

    def make():
        hashes = WordHashes()

        def step(rows: pa.RecordBatch, words: list) -> dict:
            low = [minima(shingles(t, hashes, n), FINE_K) for t in words]
            return {"fine": array_of([signature(x, FINE_BITS) for x in low], pa.int64()), "bands": array_of([band_keys(x[:K]) for x in low], pa.int64())}

        return step

    return arrow_map(held, make, "fine array<bigint>, bands array<bigint>", keep=("cid",))


def near_duplicates(docs: DataFrame, percent: int = 85, n: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Texts are linked if 100 * |intersection| >= percent * |union| of their
    shingle sets; component_id is the smallest doc_id reachable, kept tells
    whether it is the row's own. Null, empty and wordless texts link with
    nothing. Rows with a null doc_id are not linked: their component_id is null
    and they are kept. Repeated rows get equal results (all with the smallest id are kept).
    """
    spark = docs.sparkSession
    rows = settle(features(docs, n), "minhash")
    linked = rows.where("cid is not null and doc_id is not null")
    classes = linked.groupBy("cid").agg(F.min("doc_id").alias("first_id"))
    nodes = settle(linked.join(classes.select("cid", F.col("first_id").alias("doc_id")), ["cid", "doc_id"]).dropDuplicates(["cid"]).select("cid", "doc_id", F.col("n_shingles").alias("n"), "sig", "bands"), "classes")
    least = cutoff(percent, K, BITS, SLACK)

    banded = nodes.select("cid", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("key", "cid"), "cid")).alias("hub")).where("m > 1").select("key", F.col("hub.cid").alias("hub"))
    hubs = settle(hubs, "hubs")
    near = banded.join(hubs, "key").where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    near = settle(_sifted(near, nodes, least, percent), "pairs")

    labels = spark.createDataFrame([], "node bigint, label bigint")
    wanted = near.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    labels = _confirm_all(near, labels, settle(_texts_of(docs, nodes, wanted, n), "texts"), percent, n)

    own = nodes.select("cid", "n", "bands").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    members = settle(_mixed(own, hubs), "mixed")
    held = settle(_texts_of(docs, nodes, members.select("cid").distinct(), n), "texts")
    fine = settle(_fine(held, n), "fine")
    more = _blocks(members, percent).join(fine, "cid").groupBy("key", "a", "b").applyInArrow(_between(cutoff(percent, FINE_K, FINE_BITS, FINE_SLACK), percent), "a bigint, b bigint, est double")
    tried = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = settle(more.join(tried, ["a", "b"], "left_anti"), "more")
    labels = _confirm_all(more, labels, held, percent, n)

    firsts = nodes.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").select("cid", "doc_id", F.coalesce("label", "cid").alias("label"))
    smallest = firsts.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = firsts.join(smallest, "label").select("cid", "component_id")
    out = rows.select("doc_id", "n_shingles", "cid").join(of_class, "cid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _sifted(pairs: DataFrame, nodes: DataFrame, least: float, percent: int) -> DataFrame:
    """(a, b, est) of the pairs whose set sizes and signatures allow a link."""
    side = lambda s: nodes.select(F.col("cid").alias(s), F.col("n").alias(f"{s}_n"), F.col("sig").alias(f"{s}_sig"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    fits = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
    return both.where(fits).select("a", "b", similarity(F.col("a_sig"), F.col("b_sig")).alias("est")).where(F.col("est") >= least)


def _confirm_all(pairs: DataFrame, labels: DataFrame, held: DataFrame, percent: int, n: int) -> DataFrame:
    """Confirm pairs on the texts held until each is a link, is refuted or lies inside a component: (node, label), from the labels so far."""
    rounds, alone, done = 0, labels.isEmpty(), 0
    if pairs.isEmpty():
        return labels
    likeliest = F.row_number().over(Window.partitionBy("b").orderBy(F.col("est").desc(), "a"))
    left = settle(pairs.select("a", "b", likeliest.alias("place")), "ranked")
    most = left.agg(F.max("place")).first()[0]
    while done < most:
        upto = WIDER**rounds
        best = left.where((F.col("place") > done) & (F.col("place") <= upto))
        if not alone:
            side = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"{s}_label"))  # noqa: B023, E731
            best = best.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b"))
        new = settle(_confirmed(best.select("a", "b"), held, percent, n), "links")
        rounds, done = rounds + 1, upto
        if not new.isEmpty():
            labels, alone = components(new.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))), False
    return labels


def _texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cid, text) of each wanted cid; if its document's id repeats, the text whose set is the class's."""
    joined = texts(docs).join(nodes.join(wanted, "cid", "left_semi").select("cid", "doc_id"), "doc_id")

    def make():
        hashes = WordHashes()

        def step(rows: pa.RecordBatch, words: list) -> dict:
            sets = (shingles(t, hashes, n) for t in words)
            return {"own": pa.array([int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) for s in sets], pa.int64())}

        return step

    repeated = arrow_map(joined, make, "own bigint", keep=("cid", "text"))
    return repeated.where("own = cid").select("cid", "text").dropDuplicates(["cid"])


def one_of_each(docs: DataFrame, percent: int = 80, n: int = WORDS) -> DataFrame:
    """docs, with all its columns, without the rows that near_duplicates() does not keep, and one row of those with equal doc_id and text.

    Of such repeated rows, whatever their other columns, any one stays; rows
    without a doc_id stay all. An empty table gives none.
    """
    marks = near_duplicates(docs, percent, n).where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("kept").alias("__kept"), F.count("*").alias("__n")).where("not __kept or __n > 1")
    rows = docs.select(F.struct("*").alias("__row"), docs["doc_id"].cast("long").alias("__own"), docs["text"].alias("__text"))
    rows = rows.join(marks, F.col("__own") == F.col("__id"), "left")
    once = rows.where("__id is null").select("__row.*")
    again = rows.where("__kept").select("__row", "__own", F.xxhash64("__text").alias("__hash"), F.length("__text").alias("__size")).dropDuplicates(["__own", "__hash", "__size"]).select("__row.*")
    return once.unionByName(again)
