"""Each operator against a plain brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from barloom.llm import anchors, bit_planes, decontaminate, fm_index, minhash, piece_codec, pitman_yor, quality, suffix_buckets, token_count, url_cascade

WORDS = "the of and to in tion ing er re on an th he at st nd ed or es en".split()
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")


def prose(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    """(doc_id, text): copies, near copies, shared passages, one very long text, null, empty, wordless and repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(12)]
    passage = prose(rng, 70)
    out = list(base)
    out += [base[0]] * 3
    for _ in range(6):
        w = base[1].split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [f"{prose(rng, 30)}\n{passage} {prose(rng, 30)}" for _ in range(4)]
    out += [prose(rng, 6000) + " " + passage, "", None, " \t\n ", "one two", "One TWO", "é日本 " * 40, "la " * 300]
    rows = [(i, t) for i, t in enumerate(out)]
    return [*rows, rows[2], (None, base[3]), (None, None)]


@pytest.fixture(scope="module")
def table(spark, docs):
    """Columns whose names clash with those the operators make."""
    rows = [(i, t, "en", "x", 1, 2, 3) for i, t in docs]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kept string, spans int, rid int, n_words int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


def words(t):
    return WORD.findall(t or "")


def low(t):
    return (t or "").encode().lower().decode()


def key(row):
    return tuple((x is None, str(x)) for x in row)


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


def test_quality_base(spark, table, docs, empty):
    want = []
    for i, t in docs:
        w = words(t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    got = quality.judged(table)
    same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), want)
    assert quality.judged(empty).count() == 0
    kept = quality.good_rows(table)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} >= set(range(12))


def test_quality_rejects_odd_histograms(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice(quality.COMMON_WORDS["en"][:12] + WORDS) for _ in range(200)), "en") for i in range(30)]
    odd = [(99, " ".join(f"{prose(rng, 1)}$$$###" for _ in range(200)), "en"), (98, " ".join(f"{prose(rng, 1)}$$$###" for _ in range(60))[:280], "en")]
    got = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(good + odd, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i] for i, _, _ in good) and not got[99]


def test_quality_against_labels(spark):
    """Of the labelled texts of sf0.1 that pass the base rules: rejected and kept by label."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judged(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    count = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert count.get((1, False), 0) == 0 and count[1, True] == 3243
    assert count[0, False] >= 285 and count.get((0, True), 0) <= 6


def test_distance_against_numpy(spark):
    rng = np.random.default_rng(3)
    for _ in range(5):
        p, q = rng.integers(0, 9, 7).astype(float), rng.integers(0, 9, 7).astype(float) + 0.1
        a, b = p / p.sum(), q / q.sum()
        m = (a + b) / 2
        want = math.sqrt(sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0) / 2 + sum(x * math.log2(x / y) for x, y in zip(b, m) if x > 0) / 2)
        df = spark.createDataFrame([(p.tolist(), q.tolist())], "p array<double>, q array<double>")
        assert abs(df.select(quality.distance(df.p, df.q)).first()[0] - want) < 1e-9


def brute_groups(docs, percent=85):
    sets = []
    for i, t in docs:
        w = words(low(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and docs[a][0] is not None and docs[b][0] is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[find(a)] = min(least[find(a)], i)
    return [(i, len(sets[a]), None if i is None else least[find(a)], i is None or i == least[find(a)]) for a, (i, _) in enumerate(docs)]


def test_near_duplicates(table, docs, empty):
    same(minhash.near_duplicates(table), brute_groups(docs))
    assert minhash.near_duplicates(empty).count() == 0


def test_one_of_each_repeated_row(spark, empty):
    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 60)
    df = spark.createDataFrame([(1, a, "x"), (1, a, "y"), (1, b, "z"), (2, a, "x"), (None, a, "x"), (None, a, "x"), (5, None, "x"), (5, None, "x")], "doc_id bigint, text string, __id string")
    got = sorted(str((r["doc_id"], r["text"])) for r in minhash.one_of_each(df).collect())
    assert got == sorted(str(x) for x in [(1, a), (1, b), (None, a), (None, a), (5, None)])
    assert minhash.one_of_each(empty).count() == 0


def test_near_duplicates_chain(spark):
    """Links that run only through the middle of a chain are found."""
    rng = random.Random(2)
    w = prose(rng, 300).split()
    rows = []
    for i in range(12):
        rows.append((i, " ".join(w)))
        for _ in range(3):
            w[rng.randrange(len(w))] = f"x{i}{rng.random()}"
    same(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")), brute_groups(rows))


def test_near_duplicates_in_blocks(table, docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 2)
    same(minhash.near_duplicates(table, 70), brute_groups(docs, 70))


def test_all_bands_give_mixed_buckets(spark):
    """Classes of different components that meet in one band alone are held against each other, whichever band it is."""
    bands = minhash.K // minhash.R
    rows = [(3 * b + c, 10, 3 * b + c, [b if k == b else 1000 * (3 * b + c + 1) + k for k in range(bands)]) for b in range(bands) for c in range(3)]
    own = spark.createDataFrame(rows, "cid bigint, n bigint, label bigint, bands array<bigint>")
    got = minhash._mixed(own, spark.createDataFrame([(b,) for b in range(bands)], "key bigint"))
    same(got.select("key", "cid", "m"), [(b, 3 * b + c, 3) for b in range(bands) for c in range(3)])


def test_large_buckets_are_cut(spark):
    """No group of a large bucket has many classes; each pair of different components whose sizes fit is in one group."""
    rng = random.Random(3)
    rows = [(1, i, 0 if i < 3000 else i, rng.randint(80, 130), 4000) for i in range(4000)] + [(2, i, i, 100, 3) for i in range(3)]
    members = spark.createDataFrame(rows, "key bigint, cid bigint, label bigint, n bigint, m bigint")
    groups = defaultdict(lambda: ([], []))
    for r in minhash._blocks(members, 85).collect():
        groups[r["key"], r["a"], r["b"]][r["left"]].append(r["cid"])
    assert max(len(x) + len(y) for x, y in groups.values()) <= 2.5 * minhash.BLOCK
    met = Counter()
    for (key, a, b), (right, left) in groups.items():
        assert (a == b) == (not right)
        met.update((key, *sorted(p)) for p in (itertools.product(left, right) if right else itertools.combinations(left, 2)))
    assert set(met.values()) == {1} and len([p for p in met if p[0] == 2]) == 3
    for x, y in itertools.combinations(rows[:4000], 2):
        if x[2] != y[2] and 100 * min(x[3], y[3]) >= 85 * max(x[3], y[3]):
            assert (1, x[1], y[1]) in met
        elif x[2] == y[2]:
            assert (1, x[1], y[1]) not in met


def test_signature_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    low_a, low_b = minhash.minima(np.unique(a), 1024), minhash.minima(np.unique(b), 1024)
    assert abs((low_a == low_b).mean() - 0.8) < 0.06


def brute_bytes(docs, n):
    count = Counter()
    data = [(t or "").encode() for _, t in docs]
    for b in data:
        count.update(b[k : k + n] for k in range(len(b) - n + 1))
    out = []
    for (i, _), b in zip(docs, data):
        mark = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                mark[k : k + n] = b"\1" * n
        out.append((i, len(b), sum(mark), hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 64])
def test_remove_repeats(spark, table, docs, empty, length):
    from pyspark.sql import functions as F

    got = suffix_buckets.remove_repeats(table, length)
    n = F.aggregate("spans", F.lit(0), lambda a, s: a + s["to"] - s["from"])
    same(got.select("doc_id", "n_bytes", n, F.sha2("kept", 256)), brute_bytes(docs, length))
    assert suffix_buckets.remove_repeats(empty).count() == 0


def brute_words(docs, n):
    first = {}
    order = [(1 << 62 if i is None else i, t) for i, t in docs]
    for i, t in order:
        w = words(t)
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            first[x] = min(first.get(x, i), i)
    out = []
    for (i, t), (d, _) in zip(docs, order):
        w = words(t)
        mark = [0] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < d:
                mark[k : k + n] = [1] * n
        out.append((i, len(w), sum(mark), " ".join(x for x, m in zip(w, mark) if not m)))
    return out


@pytest.mark.parametrize("window", [50, 12])
def test_remove_earlier(table, docs, empty, window):
    got = fm_index.remove_earlier(table, window)
    rows = [(r["doc_id"], r["n_words"], sum(s["to"] - s["from"] for s in r["spans"]), " ".join(words(r["kept"]))) for r in got.collect()]
    assert sorted(rows, key=key) == sorted(brute_words(docs, window), key=key)
    assert fm_index.remove_earlier(empty).count() == 0
    cut = fm_index.without_earlier(table, window)
    assert cut.columns == table.columns


def test_many_spans_of_one_anchor(spark, monkeypatch):
    """A very common line in ever different texts: the key's spans are split by longer cores, with equal results."""
    monkeypatch.setattr(anchors, "SPLIT_SPANS", 3)
    rng = random.Random(9)
    line, passage = prose(rng, 9), prose(rng, 40)
    rows = [(i, f"{prose(rng, 12)} {line} {passage if i % 5 == 0 else prose(rng, 40)} {prose(rng, 5)}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["n_words"], sum(s["to"] - s["from"] for s in r["spans"]), " ".join(words(r["kept"]))) for r in fm_index.remove_earlier(df, 20).collect()]
    assert sorted(got, key=key) == sorted(brute_words(rows, 20), key=key)


def test_removal_comes_from_the_matchers(table, monkeypatch):
    """With a matcher that finds nothing, nothing is removed."""
    from pyspark.sql import functions as F

    for module, remove in ((fm_index, fm_index.remove_earlier), (suffix_buckets, suffix_buckets.remove_repeats)):
        monkeypatch.setattr(module, "_match", lambda spans, plan: spans.select("key", "span", F.col("n").alias("from"), F.col("n").alias("to"), "least").limit(0))
        assert remove(table).where(F.size("spans") > 0).count() == 0


def test_equal_hashes_alone_remove_nothing(spark, monkeypatch):
    """Copies are found by comparing their units: with the last witness of each repeated span made another text, none is."""
    from pyspark.sql import functions as F

    words = [f"w{k * k % 977}" for k in range(400)]
    copies = spark.createDataFrame([(i, " ".join(words)) for i in range(6)], "doc_id long, text string")
    for module, remove, kept in ((fm_index, fm_index.remove_earlier, 1), (suffix_buckets, suffix_buckets.remove_repeats, 0)):
        match = module._match
        assert remove(copies).where(F.size("spans") > 0).count() == 6 - kept
        other = F.when(F.col("copy") == anchors.LAST, F.expr("unhex(translate(hex(units), '0123456789ABCDEF', '123456789ABCDEF0'))")).otherwise(F.col("units"))
        monkeypatch.setattr(module, "_match", lambda spans, plan, match=match, other=other: match(spans.withColumn("units", other), plan))
        assert remove(copies).where(F.size("spans") > 0).count() == 0


def test_fm_index_statistics():
    rng = np.random.default_rng(4)
    spans = [rng.integers(1, 5, rng.integers(5, 30)) for _ in range(20)]
    flat = np.concatenate([np.append(s, 0) for s in spans]).astype(np.int32)
    index = fm_index.FMIndex(flat, 4, np.arange(20) * 10 % 70)
    begins = np.cumsum([0, *(len(s) + 1 for s in spans)])[:-1]
    ends = np.concatenate([b + np.arange(6, len(s) + 1) for b, s in zip(begins, spans)])
    length, lo, hi = index.statistics(flat, ends, 6)
    runs = Counter(tuple(s[k : k + m].tolist()) for s in spans for m in range(1, 7) for k in range(len(s) - m + 1))
    of = lambda e, m: tuple(flat[e - m : e].tolist())
    assert length.tolist() == [max((m for m in range(7) if m == 0 or runs[of(e, m)] > 1), default=0) for e in ends.tolist()]
    full = ends[length == 6].tolist()
    assert (hi - lo).tolist() == [runs[of(e, 6)] for e in full]
    owners = {x: min(i * 10 % 70 for i, s in enumerate(spans) if any(tuple(s[k : k + 6].tolist()) == x for k in range(len(s) - 5))) for x in {of(e, 6) for e in full}}
    assert index.least(lo, hi).tolist() == [owners[of(e, 6)] for e in full]
    other = rng.integers(1, 6, 400).astype(np.int32)  # words the index does not hold as a span, one of them in no span
    places = np.arange(6, 401)
    index = fm_index.FMIndex(flat, 5, np.arange(20))
    length, lo, hi = index.statistics(other, places, 6, 1)
    at = lambda e, m: tuple(other[e - m : e].tolist())
    assert length.tolist() == [max(m for m in range(7) if m == 0 or runs[at(e, m)]) for e in places.tolist()]
    assert (hi - lo).tolist() == [runs[at(e, 6)] for e in places[length == 6].tolist()]


def test_runs_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 30, 5, 200, 49, 50, 0, 51, 400)]
    plan = anchors.Plan(50, 8, True, True)
    text, first, n, at, key, span = anchors.runs_of(texts, plan)
    for i, u in enumerate(texts):
        one = anchors.runs_of([u], plan)
        assert all(np.array_equal(x[text == i], y) for x, y in zip((first, n, at, key, span), one[1:]))
        assert n[text == i].sum() == max(0, len(u) - 49)


def test_multikey_sort():
    rng = random.Random(6)
    parts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    group = np.array([rng.randrange(3) for _ in parts])
    rows, length = suffix_buckets._padded(parts, 24)
    order, lcp = suffix_buckets.multikey_sort(rows, length, group)
    assert [(group[i], parts[i].ljust(24, b"\0"), len(parts[i])) for i in order] == sorted((g, p.ljust(24, b"\0"), len(p)) for g, p in zip(group, parts))
    for k in range(1, len(order)):
        a, b = parts[order[k - 1]], parts[order[k]]
        common = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == (common if group[order[k]] == group[order[k - 1]] else -1)


def test_contamination(spark, empty):
    rng = random.Random(8)
    items = [("a", prose(rng, 25)), ("b", prose(rng, 14)), ("c", "Alpha beta"), ("d", ""), ("e", None), ("f", prose(rng, 10)), (None, "gamma delta epsilon")]
    texts = [prose(rng, 200) for _ in range(6)]
    rows = [(0, texts[0]), (1, f"{texts[1]} {items[0][1].upper()} {texts[2]}"), (2, " ".join(items[0][1].split()[3:14]) + " x " + " ".join(items[1][1].split()[:9])), (3, f"so ALPHA, beta! {items[1][1]} {items[1][1]}"), (4, None), (5, ""), (6, "gamma delta epsilon"), (7, texts[3] * 30), (7, texts[3] * 30), (None, items[5][1])]
    unit = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    wins = defaultdict(set)
    for n, t in items:
        w = unit.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].add(n)
    want = []
    for i, t in rows:
        w = unit.findall(low(t))
        mark, found = [0] * len(w), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    mark[k : k + size] = [1] * size
                    found |= wins[tuple(w[k : k + size])]
        want.append((i, len(w), sum(mark), sorted(x for x in found if x is not None)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, items string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (200_000, 20):
        got = [(r["doc_id"], r["n_words"], sum(s["to"] - s["from"] for s in r["spans"]), r["items"]) for r in decontaminate.contamination(df, bench, block_words=block).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    cut = decontaminate.decontaminate(df, bench)
    assert cut.columns == df.columns
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert left[0] == rows[0][1] and left[4] is None and items[0][1].upper() not in left[1] and 6 not in left
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).where("size(spans) > 0").count() == 0


@pytest.mark.parametrize("file", [PIECES, BYTES])
def test_token_counts(spark, table, docs, file):
    lib = token_count.library(file)
    want = [(i, len((t or "").encode()), lib.counts([t])[0] if t else 0) for i, t in docs]
    same(token_count.token_counts(table, file, chunk=500, overlap=8), want)
    assert token_count.token_counts(table.limit(0), file).count() == 0


def test_chunked_counts_fuzz():
    rng = random.Random(3)
    for file in (PIECES, BYTES):
        lib = token_count.library(file)
        for _ in range(150):
            s = prose(rng, rng.randint(1, 120)) if rng.random() < 0.6 else "".join(rng.choice("ab  \n.é日's<|endoftext|>") for _ in range(300))
            s = s.replace(" ", "") if rng.random() < 0.2 else s
            if s:
                assert token_count.chunked_count(lib, s, rng.choice([20, 64, 200]), rng.choice([2, 8])) == lib.counts([s])[0]


def test_piece_codec(table, docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [(i, str(sp.encode(t or "")), sp.decode(sp.encode(t or ""))) for i, t in docs]
    got = [(r["doc_id"], str(r["ids"]), r["decoded"]) for r in piece_codec.encode_decode(table, PIECES).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert piece_codec.encode_decode(empty, PIECES).count() == 0


def test_piece_codec_fuzz():
    codec, rng = piece_codec.PrefixCodec(PIECES), random.Random(1)
    for alphabet in (" ▁\n\t abcdeééñ12 3.,the   ing日本<s>\x00", "aab", "  \n"):
        for _ in range(400):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
            assert codec.encode(s) == codec.library.encode(s)


@pytest.mark.parametrize("planes", [4, 32])
def test_bit_planes(spark, table, docs, empty, tmp_path, planes):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    path = str(tmp_path / "ids")
    bit_planes.write_ids(table, BYTES, path, 2, planes=planes, block_ids=100, segment_ids=700, shard_ids=3000)
    got = bit_planes.read_ids(spark, path).collect()
    rows = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows]
    crc = [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, ids)]
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == sorted(crc, key=key)
    at = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got)
    assert [a for a, _, _ in at] == list(np.cumsum([0, *(n for _, n, _ in at)])[:-1])
    assert [d is None for _, _, d in at] == [i is None for i, _ in rows]
    assert [d for _, _, d in at if d is not None] == [i for i, _ in rows if i is not None]
    bit_planes.write_ids(empty, BYTES, str(tmp_path / "none"), 2)
    assert bit_planes.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_byte_encoder_fuzz():
    e, rng = bit_planes.ByteEncoder(BYTES, 2), random.Random(1)
    texts = ["".join(rng.choice(" \n\t  ab'sé日<|endoftext|>.1,|word") for _ in range(60)) for _ in range(500)] + ["x  <|endoftext|> y", "naïve's 'tis", None]
    texts += ["".join(rng.choice("ab  \n\t''s.,1²é\xa0 x日\u2003\u3000Ü×÷ŉ\x85\x1c\x1f\x00 tre'll'd") for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    for a, t in zip(e.encode(texts), texts):
        assert a.tolist() == [*e.lib.encode(t or "", add_special_tokens=False).ids, 2]
    assert bit_planes.unpacked_ids(bit_planes.packed_ids(np.array([70_000, 1], "<u4"))).tolist() == [70_000, 1]


def test_latin_words_are_encoded_side_by_side():
    """Words of ASCII and of Latin letters go to the library as a few long texts; what else stands in a text goes alone; ids are the library's."""
    e, rng = bit_planes.ByteEncoder(BYTES, 2), random.Random(2)
    text = "".join(" " + "".join(rng.choice("abcéèñßœŉ÷×") for _ in range(8)) for _ in range(3000)) + " x\xa0 y \u2003é \x85 ñ\x1c z\t a\x7f"
    lib, sent = e.lib, []

    class Counted:
        def encode(self, text, **named):
            sent.append(text)
            return lib.encode(text, **named)

        def encode_batch_fast(self, texts, **named):
            sent.extend(texts)
            return lib.encode_batch_fast(texts, **named)

    e.lib = Counted()
    got = e.encode([text, text[::-1]])
    assert [x.tolist() for x in got] == [[*lib.encode(t, add_special_tokens=False).ids, 2] for t in (text, text[::-1])]
    assert len(sent) < 3000


def test_host_path_and_rules(spark):
    from pyspark.sql import functions as F

    urls = ["HTTP://A.Example.COM/en/7?x#y", "no scheme", None, "x://h", "x://h?q/en/", "a://b://c/d", "https://net/de/1", "https://y.example.net/de/8", "https://example.org/es/#"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = url_cascade.host_path(F.col("url"))
    rule, act = url_cascade.longest_rule(F.col("h"), F.col("p"), [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8"), ("allow", "net", "/de/"), ("block", "org", "/es/")])
    got = df.select(host.alias("h"), path.alias("p")).select("h", "p", rule, act).collect()
    assert [tuple(r) for r in got] == [("a.example.com", "/en/7", "example.com/en/7", "allow"), ("", "", None, None), ("", "", None, None), ("h", "", None, None), ("h", "", None, None), ("b:", "//c/d", None, None), ("net", "/de/1", "net/de/", "allow"), ("y.example.net", "/de/8", "example.net/de/8", "block"), ("example.org", "/es/", "org/es/", "block")]


@pytest.mark.parametrize("shard_keys", [10_000_000, 300])
def test_cascade_is_exact(spark, shard_keys):
    from pyspark.sql import functions as F

    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 50 != 3, F.concat(F.lit("k"), (F.col("id") % 4000).cast("string"))).alias("k"), F.lit("x").alias("bits"))
    listed = pages.where("page_id % 7 = 0").select(F.col("k").alias("key"))
    names = {r["key"] for r in listed.where("key is not null").collect()}
    got = url_cascade.listed_urls(pages, F.col("k"), listed, shard_keys)
    assert all(r["hit"] == (r["k"] in names) for r in got.collect()) and got.count() == 6000
    assert not url_cascade.listed_urls(pages, F.col("k"), listed.limit(0)).where("hit").count()
    assert url_cascade.listed_urls(pages.limit(0), F.col("k"), listed).count() == 0


def test_language_model(spark, table, docs, empty):
    got = pitman_yor.scores(table).collect()
    toks = [[*words(low(t)), None] for _, t in docs]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    c = Counter(w for ws, h in zip(toks, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for (i, _), ws, h in zip(docs, toks, held)]
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=key) == sorted(want, key=key)
    trained = [r for r in got if not r["held_out"]]
    assert sum(r["score"] for r in trained) > sum(r["base_score"] for r in trained)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert pitman_yor.scores(empty).count() == 0


def test_language_model_sorts_a_batch_in_parts():
    """Memory for a batch's pairs, besides what is yielded, and for a shard's, by a token; the pairs are all there."""
    import tracemalloc

    import pyarrow as pa

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    rng = np.random.default_rng(3)
    n, distinct = 1_000_000, np.sort(rng.integers(1 << 13, 1 << 62, 50_000, dtype=np.uint64))
    index = (distinct.size * rng.random(n) ** 3).astype("<u4")
    values = [([7], pa.int64()), ([[False, True]], pa.list_(pa.bool_())), ([[n // 2, n // 2]], pa.list_(pa.int64())), ([pitman_yor._pack(distinct, np.zeros(len(distinct), "<u4"))], pa.binary()), ([pitman_yor._pack(index)], pa.binary())]
    batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in values], names=["batch", "held", "sizes", "words", "index"])
    tracemalloc.start()
    try:
        parts, seen = [], 0
        for got in pitman_yor._batches(Rows(), 20, distinct[:100])(iter([batch])):
            parts.append(got)
            seen += int(pitman_yor._unpack(got["entries"][0].as_py(), *pitman_yor._ENTRY)[4].sum())
        assert seen == n and sorted(x["shard"][0].as_py() for x in parts) == list(range(20))
        made = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made < 55 * n


def test_chances_sum_to_one():
    rng = np.random.default_rng(2)
    h = np.repeat(np.arange(40), 6)
    place = np.tile(np.arange(6) * 16 + 3, 40)
    count = rng.integers(0, 5, len(h))
    data = pitman_yor._pack(h.astype("<u4"), place.astype("<u2"), count.astype("<u8"))
    v = int((np.bincount(h, count) > 0).sum())
    shard = pitman_yor.Shard(data, 0, 1 / (v + 1), (0.6, 0.5, 0.4))
    totals = np.bincount(place, count, pitman_yor.PLACES)
    tables = shard.tables()
    for k in range(3):
        shard.sweep(k, tables, totals)
        tables = shard.tables()
        assert (shard.t2 <= count).all() and ((shard.t2 > 0) == (count > 0)).all()
        p2, p1, p0 = shard.chances(tables, totals)
        unseen = (pitman_yor.STRENGTH + shard.d[2] * tables[2][0]) * shard.base / (pitman_yor.STRENGTH + tables[1].sum())
        assert abs(p0[np.bincount(h, count) > 0].sum() + unseen - 1) < 1e-9
        for x in np.unique(place):
            assert p2[(place == x)].sum() <= 1 + 1e-9


def test_seating_matches_one_by_one():
    """The mean number of tables agrees with customers seated one at a time."""
    rng = np.random.default_rng(5)
    fast = pitman_yor.seat(np.full(20_000, 12), np.full(20_000, 0.7), 0.5, rng).mean()
    slow = []
    for _ in range(20_000):
        t = 1
        for n in range(1, 12):
            t += rng.random() < 0.7 / (0.7 + n - 0.5 * t)
        slow.append(t)
    assert abs(fast - np.mean(slow)) < 0.06


def test_rarer_words_before_are_told_apart(spark, monkeypatch):
    """No word has a listed restaurant; zab and yab end alike, and yet what followed one of them is no likelier after the other."""
    common = pitman_yor._common
    monkeypatch.setattr(pitman_yor, "_common", lambda texts: common(texts, 1.0))
    rows = [(i, "zab left" if i % 2 else "yab right") for i in range(400)] + [(1000, "zab left"), (1001, "zab right"), (1002, "yab left"), (1003, "yab right")]
    p = {r["doc_id"]: r["score"] for r in pitman_yor.scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert p[1000] - p[1001] > 0.5 and p[1003] - p[1002] > 0.5


def test_chances_after_rarer_words_sum_to_one():
    """Two levels of shared places and a restaurant a word before: over all words and the unseen, each word's chances are one."""
    rng, n = np.random.default_rng(6), 30
    word, before = np.repeat(np.arange(n), 8), np.tile(np.arange(8), n)
    place = before // 4 * 16 + 3
    count = rng.integers(0, 4, len(word))
    count[before == 0] += 1  # every word is known
    shard = pitman_yor.Shard(pitman_yor._pack(word.astype("<u4"), place.astype("<u2"), count.astype("<u8")), 0, 1 / (n + 1), (0.6, 0.5, 0.4), None, pitman_yor._pack(np.full(len(word), pitman_yor.DEEP, "u1")))
    numbers = lambda: (shard.tables(), np.bincount(shard.place, shard.c2, pitman_yor.PLACES))
    for k in range(3):
        shard.sweep(k, *numbers())
        assert (shard.t3 <= count).all() and ((shard.t3 > 0) == (count > 0)).all()
        tables, totals = numbers()
        p2, p1, p0 = shard.chances(tables, totals)
        a, (d2, d1, d0) = pitman_yor.STRENGTH, shard.d
        new = (a + d0 * tables[2][0]) * shard.base / (a + tables[1].sum())
        for b in range(8):
            x, parent = b // 4 * 16 + 3, b // 4
            c1 = np.bincount(shard.above, tables[0], 256)[parent]
            unseen = (a + d2 * tables[0][x]) / (a + totals[x]) * (a + d1 * tables[1][parent]) / (a + c1) * new
            c = count[before == b].sum()
            assert abs((shard.undivided(p2)[before == b].sum() + pitman_yor.RARE_STRENGTH * unseen) / (pitman_yor.RARE_STRENGTH + c) - 1) < 1e-9
