"""The registered queries over a small folder of tables, every column against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import BYTES, PIECES, brute_bytes, brute_groups, brute_words, low, prose, words

from barloom.llm import quality
from barloom.llm import queries as registered

LANGS = ["en", "de", "fr", "es", None]
UNIT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    item, passage = prose(rng, 15), prose(rng, 70)
    plain = lambda n: " ".join(rng.choice(quality.COMMON_WORDS["en"]) if rng.random() < 0.4 else prose(rng, 1) for _ in range(n))
    texts = [plain(rng.randint(60, 160)) for _ in range(14)]
    texts += [texts[0], texts[1] + " end", f"{plain(60)} {passage}", f"{passage}\n{plain(60)}", f"{plain(50)} {item.upper()} x", plain(3000), "", None, " \n\t", "one two", "la " * 90, "§$# " * 200, "é日本 " * 60, f"line\nline\n{plain(60)}"]
    docs = [(i, t, LANGS[i % 2], "s", len(t or "")) for i, t in enumerate(texts)]
    docs.append(docs[3])
    items = [("b", item), ("a", " ".join(texts[2].split()[5:15])), ("c", None), ("d", "§$#")]
    pages = [(0, "http://A.Example.com/en/7?x", "<p>ok"), (1, "https://x.org/es/", "ok"), (2, "http://free-bets.example.net/q", "ok"), (3, "http://h.test/p#1", "a ### b"), (4, "http://h.test/p", "fine"), (5, "http://h.test/other", "fine"), (6, None, "***"), (7, "nothing", None), (8, "http://a.net/de/1", "%%%")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, docs, items


def check(spark, tables, name, want):
    got = registered.queries()[name](spark, tables[0]).collect()
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def histograms(text, lang):
    """Character classes and counts of the language's common words, then of all other pieces."""
    kinds = {"capital": "[A-Z]", "digit": "[0-9]", "space": "[\x20\x09-\x0d]", "point": "[.,;:!?'\"()\\[\\]\\-/]", "symbol": "[#*$%&|<>{}=+_\\\\^~`@]", "small": "[a-z]"}
    n = {k: len(re.findall(p, text)) for k, p in kinds.items()}
    n["other"] = len(text) - sum(n.values())
    pieces = re.split("[\x20\x09-\x0d.,;:!?'\"()\\[\\]\\-/]+", text.lower())
    listed = quality.COMMON_WORDS.get(lang)
    common = [pieces.count(w) for w in listed] if listed else None
    return [n[c] for c in quality.CLASSES], None if common is None else [*common, len(pieces) - sum(common)]


def jensen_shannon(p, q):
    a, b = np.array(p) / sum(p), np.array(q) / sum(q)
    m = (a + b) / 2
    half = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m) if u > 0)
    return math.sqrt(max(0.0, (half(a) + half(b)) / 2))


def test_op1(spark, tables):
    rows, sums = [], {}
    for i, t, lang, *_ in tables[1]:
        w = words(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        h = histograms(t or "", lang)
        rows.append((i, lang, h, failed, (i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), failed)))
        if not failed:
            s = sums.setdefault(lang, [np.zeros(len(quality.CLASSES)), np.zeros(25)])
            s[0] += h[0]
            s[1] += h[1]
    want = []
    for _, lang, (classes, common), failed, base in rows:
        odd = False
        if not failed:
            odd = sum(classes) >= quality.LEAST_CHARS and jensen_shannon(classes, sums[lang][0]) > quality.MOST_CLASS_DISTANCE
            odd |= jensen_shannon(common, sums[lang][1]) ** 2 > quality.WORD_SQUARE + quality.WORD_NOISE / base[1]
        want.append((*base, not failed and not odd))
    assert len({w[-1] for w in want}) == 2
    check(spark, tables, "op1_distribution_divergence", want)


def test_op2(spark, tables):
    check(spark, tables, "op2_minhash_near_dedup", brute_groups([d[:2] for d in tables[1]]))


def test_op3(spark, tables):
    docs = [d[:2] for d in tables[1]]
    count = Counter()
    for _, t in docs:
        b = (t or "").encode()
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    spans = []
    for _, t in docs:
        b, end, n = (t or "").encode(), -1, 0
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                n, end = n + (k > end), k + 200
        spans.append(n)
    check(spark, tables, "op3_suffix_array_dedup", [(i, size, gone, n, digest) for (i, size, gone, digest), n in zip(brute_bytes(docs, 200), spans)])


def test_op4(spark, tables):
    wins = defaultdict(set)
    for n, t in tables[2]:
        w = UNIT.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].add(n)
    want = []
    for i, t, *_ in tables[1]:
        w = UNIT.findall(low(t))
        mark, found = [0] * len(w), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    mark[k : k + size] = [1] * size
                    found |= wins[tuple(w[k : k + size])]
        want.append((i, len(w), sum(mark), len(found), sha(",".join(sorted(found))), sum(mark) > 0))
    assert any(w[-1] for w in want)
    check(spark, tables, "op4_benchmark_decontamination", want)


def test_op5_and_op10(spark, tables):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = [(i, t or "", sp.encode(t or "")) for i, t, *_ in tables[1]]
    check(spark, tables, "op5_token_counts", [(i, len(t.encode()), len(x), len(x) > 4096) for i, t, x in ids])
    check(spark, tables, "op10_sentencepiece_codec", [(i, len(x), sha(",".join(map(str, x))), sha(sp.decode(x))) for i, _, x in ids])


def test_op6(spark, tables):
    check(spark, tables, "op6_substring_dedup", [(i, n, gone, sha(kept)) for i, n, gone, kept in brute_words([d[:2] for d in tables[1]], 50)])


def test_op7(spark, tables):
    want = [(0, "a.example.com", "/en/7", "example.com/en/7", "allow"), (1, "x.org", "/es/", "org/es/", "block"), (2, "free-bets.example.net", "/q", None, "block"), (3, "h.test", "/p", None, "block"), (4, "h.test", "/p", None, "block"), (5, "h.test", "/other", None, "allow"), (6, "", "", None, "block"), (7, "", "", None, "block"), (8, "a.net", "/de/1", "net/de/", "allow")]
    check(spark, tables, "op7_url_filters", want)


def test_op8(spark, tables):
    from tokenizers import Tokenizer

    lib, want, start = Tokenizer.from_file(BYTES), [], 0
    for i, t, *_ in sorted(tables[1], key=lambda d: d[0]):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    check(spark, tables, "op8_bit_plane_ids", want)


def test_op9(spark, tables):
    got = registered.queries()["op9_pitman_yor_scores"](spark, tables[0]).collect()
    toks = {i: [*words(low(t)), None] for i, t, *_ in tables[1]}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, *_ in tables[1] if not held(i) for w in toks[i])
    n, v = sum(c.values()), len(c)
    base = {i: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for i, ws in toks.items()}
    assert len(got) == len(tables[1])
    for r in got:
        i = r["doc_id"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(toks[i]), sum(c[w] > 0 for w in toks[i]), n)
        assert abs(r["base_score"] - base[i]) < 1e-6 and math.isfinite(r["score"]) and r["score"] < 0
    trained = [r for r in got if not r["held_out"]]
    assert sum(r["score"] for r in trained) > sum(r["base_score"] for r in trained)
