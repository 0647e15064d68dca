"""Spelling variants, importance draws and the byte network against plain versions, with odd rows of every kind."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import prose
from test_registered import check, tables  # noqa: F401 (a fixture)

from barloom.llm import byte_cnn, importance, spelling
from barloom.llm import queries as registered

RUN, UNIT = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return (t or "").encode().lower().decode()


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    count = Counter()
    for i, t in rows:
        for w in RUN.findall(low(t)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                count[w] += 1
    count = {w: n for w, n in count.items() if n >= 2}
    near = {w: [v for v in count if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in count}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        if best and count[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), count[form[w]] if w in form else None))
    return out


def misspelt(rng, w):
    k, c = rng.randrange(len(w)), rng.choice("abcdeÿà")
    return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:], w + c])


@pytest.fixture(scope="module")
def typos():
    """Words at edit distance one by the dozen, chains of forms, ties, capitals, accents, one very long word."""
    rng = random.Random(3)
    stems = ["international", "Straßenbahn", "garçonnière", "aaaaaaaa", "aaaaaaa", "prefixes", "prefixed", "mañanita"]
    rows = []
    for i in range(40):
        words = [w for w in stems for _ in range(6)] + [misspelt(rng, rng.choice(stems)) for _ in range(60)]
        rng.shuffle(words)
        rows.append((i, " ".join(words) + ("1 x×y÷zabcdefg " if i % 3 else ", ")))
    rows += [(40, "chainaaaa " * 2 + "chainaaab " * 20 + "chainaabb " * 200), (41, None), (42, ""), (43, "short run 123"), (44, "q" * 3000 + " " + "q" * 3001 + " " + "q" * 2999 + "r"), (45, "q" * 3000 + " " + "q" * 3001 + " " + "q" * 2999 + "r")]
    return [*rows, rows[3], (None, rows[5][1]), (None, None)]


@pytest.fixture(scope="module")
def typo_table(spark, typos):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in typos], "doc_id bigint, text string, word string, n int, key int").repartition(3)


@pytest.mark.parametrize("most", [2048, 6])
def test_variants(spark, typos, typo_table, monkeypatch, most):
    """With groups of six, all but the last halvings are taken."""
    monkeypatch.setattr(spelling, "GROUP_WORDS", most)
    monkeypatch.setattr(spelling, "TILE", 5)
    got = [tuple(r) for r in spelling.variants(typo_table).collect()]
    want = brute_variants(typos)
    assert sorted(got) == sorted(want)
    assert any(r[1] and r[2] != r[1] for r in want) and max(r[4] for r in want) > 20


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variants(empty).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "alone once")], "doc_id bigint, text string")).collect() == []


def test_group_of_a_third_of_all_is_split(spark):
    """A prefix and a suffix that all words share: no group stays beyond the bound, and no link is lost."""
    words = ["common" + "".join(x) + "ending" for x in {(a, b, c) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}]
    rows = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    before, spelling.GROUP_WORDS = spelling.GROUP_WORDS, 16
    try:
        sizes = [g.groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("hi") - F.col("lo")).alias("r")).where("c > 16 and r > 1").count() for g in spelling._groups(rows)]
        near = {r["word"]: r["n_near"] for r in spelling.near_words(rows).collect()}
    finally:
        spelling.GROUP_WORDS = before
    assert sum(sizes) == 0 and len(sizes) > 1
    assert near == dict.fromkeys(words, 21)


def brute_draw(docs, items, percent=25):
    feats = {}

    def of(t):
        w = UNIT.findall(low(t))
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    docs = [(i, *of(t)) for i, t in docs]
    s, t = Counter(k for d in docs for k in d[2]), Counter(k for x in items for k in of(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (ns + 10000) / ((s[k] + 1) * (nt + 10000)))) for k in range(10000)]
    out = []
    for i, n, f in docs:
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20 and r[0] is not None), key=lambda r: (-r[4], r[0]))
    ranks = {}
    for k, r in enumerate(able[: len(able) * percent // 100]):
        ranks.setdefault(r[0], []).append(k + 1)
    return sorted(((*r, ranks[r[0]].pop(0) if r[1] >= 20 and ranks.get(r[0]) else None) for r in out), key=str), feats


def test_draws(spark):
    rng = random.Random(8)
    docs = [(i * 7919 % 100003, prose(rng, rng.randint(1, 60))) for i in range(150)]
    docs += [(-5, prose(rng, 3000)), (2**62, prose(rng, 30)), (-(2**62) - 9, prose(rng, 30)), (1, None), (2, ""), (3, "§$#"), (4, "Été " * 30), (6, "w" * 70 + " " + "é" * 90 + " end " * 20), (None, prose(rng, 40)), (None, None), docs[0], docs[7]]
    items = [prose(rng, 15) for _ in range(9)] + [None, ""]
    table = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs], "doc_id bigint, text string, rank int, score int, block int, n_words int").repartition(3)
    target = spark.createDataFrame([(t, 1) for t in items], "text string, features int")
    for percent in (25, 100):
        got = sorted((tuple(r) for r in importance.importance_ranks(table, target, percent).collect()), key=str)
        want, _ = brute_draw(docs, items, percent)
        assert got == want
    drawn = importance.resampled(table, target)
    assert drawn.columns == table.columns
    ids = {r[0] for r in brute_draw(docs, items)[0] if r[5]}
    assert {r["doc_id"] for r in drawn.collect()} == ids


def test_draws_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([("some item",)], "text string")
    assert importance.importance_ranks(docs, items).collect() == []
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string")
    assert [r["rank"] for r in importance.importance_ranks(some, items.limit(0)).collect()] == [None, None]


def test_radix_places_by_many_blocks(spark, monkeypatch):
    """Several passes and blocks, ties and the ends of the range of bigint."""
    monkeypatch.setattr(importance, "BLOCK_ROWS", (16, 64))
    rng = random.Random(4)
    rows = [(rng.choice([-3, 5, 5, 700000]), rng.choice([rng.randint(-(2**63), 2**63 - 1), 9])) for _ in range(700)] + [(5, -(2**63)), (5, 2**63 - 1)]
    got = importance.radix_places(spark.createDataFrame(rows, "a bigint, b bigint").repartition(5), ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["place"])] == sorted(rows)
    assert sorted(r["place"] for r in got) == list(range(len(rows)))


def test_word_codes_are_crc32():
    texts = [["a", "b" * 200, "é", "c"], [], ["x"], ["a", "d" * 63, "d" * 64]]
    codes = importance.WordCodes()
    for _ in range(2):
        for words, got in zip(texts, codes.features(texts, 10000)):
            assert got.tolist() == [zlib.crc32(x.encode()) % 10000 for x in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]
        codes.MOST = 0  # the next call starts anew


def direct_scores(net, text):
    """The network by its definition: each window's sum, the greatest in each chunk, the greatest over chunks."""
    half, width = byte_cnn.HALF, byte_cnn.WIDTH
    n = -(-(len(text) + width - 1) // half)
    data = b"\0" * (width - 1) + text + b"\0" * (n * half - len(text))
    answers = np.array([sum(net.filters[k, data[a + k]] for k in range(width)) for a in range(n * half)])
    top = np.full(byte_cnn.HIDDEN, -np.inf)
    for c in range(n):
        pooled = np.maximum(answers[c * half : min(c + 2, n) * half].max(axis=0) + net.bias, 0)
        top = np.maximum(top, np.maximum(pooled @ net.hidden + net.hidden_bias, 0))
    return 1 / (1 + math.exp(-(float(top @ net.out) + float(net.out_bias[0]))))


def test_byte_net_is_its_definition(spark):
    net, rng = byte_cnn.ByteNet(3, 0.8), random.Random(2)
    net.bias[:] = np.linspace(-1, 1, byte_cnn.FILTERS)
    texts = ["", None, "é", "x" * 123, "x" * 124, "x" * 125, "y" * 128, "z" * 129, prose(rng, 400), "日本" * 50]
    table = spark.createDataFrame([(i, t, "c", 1.5) for i, t in enumerate([*texts, texts[8]])] + [(None, "no id", "c", 0.5)], "doc_id bigint, text string, raw string, score double").repartition(2)
    got = {r["doc_id"]: r["score"] for r in byte_cnn.quality_scores(table, net).collect()}
    assert len(got) == 12
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(direct_scores(net, (t or "").encode()), rel=1e-4)
    assert got[0] == got[1] and got[8] == got[10]
    assert byte_cnn.quality_scores(table.limit(0), net).collect() == []


def test_gradients():
    """Each part's gradient against differences of the loss."""
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (40, 300, 700)]
    y, w = np.array([1, 0, 1], np.float32), np.ones(3, np.float32)
    seen = []
    net = byte_cnn.ByteNet(5)
    for p in net.parts():
        p[...] = p.astype(np.float64)
    learner = byte_cnn.Learner(net)
    learner._move = lambda grads: seen.append(grads)
    learner.step(texts, y, w)
    for part, grad in zip(net.parts(), seen[0]):
        flat, at = part.reshape(-1), int(np.abs(grad).argmax())
        eps, before = 1e-2, float(part.reshape(-1)[at])
        losses = []
        for d in (eps, -eps):
            flat[at] = before + d
            losses.append(learner.step(texts, y, w))
        flat[at] = before
        assert (losses[0] - losses[1]) / (2 * eps) == pytest.approx(float(grad.reshape(-1)[at]), rel=0.1, abs=2e-4)


def test_quality_is_learnt(spark):
    """Held-out rows of planted junk; rows with null labels and ids, ids labelled twice, no labels at all."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        rows.append((i, prose(rng, rng.randint(20, 120)) if good else " ".join(w + rng.choice(["###", "$$$"]) for w in prose(rng, 60).split()), 1))
        if i % 2:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame([*rows, rows[1], (None, "x", 1), (900, None, 1)], "doc_id bigint, text string, quality int")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (2, None, 0), (labels[0][0], labels[0][1], 1)], "doc_id bigint, quality int, text int")
    got = {r["doc_id"]: r["score"] for r in byte_cnn.quality_scores(docs, byte_cnn.learn(docs, marks)).collect()}
    wrong = sum((got[i] >= 0.7) != ("###" not in t and "$$$" not in t) for i, t, _ in rows if not i % 2)
    assert wrong <= 4 and len(got) == 402
    prior = {r["score"] for r in byte_cnn.quality_scores(docs, byte_cnn.learn(docs, marks.limit(0))).collect()}
    assert prior == {0.5}


def test_op11(spark, tables):  # noqa: F811
    check(spark, tables, "op11_spelling_variants", brute_variants([d[:2] for d in tables[1]]))


def test_op12(spark, tables):  # noqa: F811
    want, _ = brute_draw([d[:2] for d in tables[1]], [t for _, t in tables[2]])
    check(spark, tables, "op12_importance_ranks", [(r[0], *r[2:]) for r in want])


def test_op13(spark, tables):  # noqa: F811
    path = tables[0]
    labels = [(d[0], int(len(d[1] or "") > 200), 0) for d in tables[1]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    got = registered.queries()["op13_byte_cnn_quality"](spark, path).collect()
    assert len(got) == len(tables[1])
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
    # labels of held-out rows change nothing
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    spark.createDataFrame(flipped, "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    again = registered.queries()["op13_byte_cnn_quality"](spark, path).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
