"""The pipeline over a small corpus, against the stages' brute-force versions."""

import re

import corpus_pipeline
import pytest
from test_operators import WORD, brute_groups, brute_words, prose


@pytest.fixture
def corpus(spark, tmp_path):
    import random

    from barloom.llm.quality import COMMON_WORDS

    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(COMMON_WORDS["en"]) if rng.random() < 0.4 else prose(rng, 1) for _ in range(n))
    passage, item = text(60), text(20)
    texts = [text(150) for _ in range(20)]
    texts += [texts[0], texts[1] + " more", f"{text(80)} {passage} {text(40)}", f"{text(80)} {passage} {text(40)}", f"{text(80)} {item} {text(40)}", "too short", "word " * 200, None]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), texts, item, passage


def test_stages(spark, corpus):
    path, texts, item, passage = corpus
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.run(spark, path).collect()}
    ids = [(i, texts[i]) for i in range(25)]
    kept = [(i, t) for (i, t), g in zip(ids, brute_groups(ids)) if g[3]]
    cut = {i: s for i, _, _, s in brute_words(kept, 50)}
    assert set(got) == set(cut)
    for i, t in got.items():
        want = cut[i].replace(item, "") if i == 24 else cut[i]
        assert WORD.findall(t) == WORD.findall(want)
    assert sum(passage in t for t in got.values()) == 1
    assert not any(item in t for t in got.values())


def test_near_dedup_from_80(spark):
    """Pairs of a similarity from 0.80 to below 0.85, of which 85 percent would keep both, and one below 0.80."""
    import random

    rng, rows = random.Random(6), []
    for i, changed in enumerate([4, 4, 4, 4, 4, 4, 5]):
        w = prose(rng, 200).split()
        other = list(w)
        for k in range(changed):
            other[20 + 30 * k] = f"changed{k}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    assert all(g[3] for g in brute_groups(rows))
    want = {g[0] for g in brute_groups(rows, 80) if g[3]}
    assert want == {0, 2, 4, 6, 8, 10, 12, 13}
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert {r["doc_id"] for r in got.collect()} == want


def test_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus[0])
        assert docs.columns == names
    assert re.match("quality", corpus_pipeline.STAGES[0][0])


def test_empty_table(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus[0])
        assert docs.count() == 0


def test_repeated_null_and_long_rows(spark, corpus, tmp_path):
    """Of repeated rows one stays; rows without an id stay; a very long text goes through whole."""
    import random

    from barloom.llm.quality import COMMON_WORDS

    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(COMMON_WORDS["en"]) if rng.random() < 0.4 else prose(rng, 1) for _ in range(n))
    one, long, lost = text(120), text(30_000), text(120)
    rows = [(1, one), (1, one), (2, long), (None, lost), (3, None), (4, "")] + [(10 + i, text(150)) for i in range(6)]
    folder = str(tmp_path / "more")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{corpus[0]}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    got = [(r["doc_id"], len(WORD.findall(r["text"]))) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got, key=str) == sorted([(1, 120), (2, 30_000), (None, 120)] + [(10 + i, 150) for i in range(6)], key=str)
