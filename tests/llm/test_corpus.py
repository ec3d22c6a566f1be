"""Quality trees, tokenizer alignment and phrases against brute force."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import alignments, phrases as all_phrases, statistics
from holdfast.llm import align, phrases, quality
from holdfast.llm.langid import fold
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"
ODD = [
    None, "", " ", "  two  blanks ", "one", "a\x00b", "line\nline\n\nline", "日本語 é ß 🙂🙂", "<|endoftext|> <s> </s> <unk> <0x41>",
    "▁block ▁", "  x", "tab\tand\r\nreturn", "AAAA" * 300, "the of and " * 5000,
]


# quality


def test_statistics_are_those_of_the_texts():
    texts = [t or "" for t in ODD] + ["Word word WORD.", "Same line\nSame line\nother", "x " * 100]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    found = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert found.shape == (len(texts), len(quality.FEATURES)) and np.isfinite(found).all()
    for row, text in zip(found, texts):
        for name, value in statistics(text).items():
            assert row[quality.FEATURES.index(name)] == pytest.approx(value, abs=1e-6), (name, text[:20])
    assert not found[texts.index("")].any()


def plain_margin(forest, row):
    total, depth = forest.base, int(np.log2(forest.leaf.shape[1]))
    for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf):
        node = 0
        for _ in range(depth):
            node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
        total += leaf[node - (2**depth - 1)]
    return total


def test_trees_take_the_best_cuts():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (400, 4)).astype(np.float32)
    y = ((x[:, 1] > 5) ^ (x[:, 3] > 7)).astype(float)
    weight = rng.integers(1, 4, 400).astype(float)
    forest = quality.fit(x, y, weight, trees=1, depth=1)
    p = np.average(y, weights=weight)
    g, h = weight * (p - y), weight * p * (1 - p)
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.L2)
    gains = {(f, c): part(x[:, f] <= c) + part(x[:, f] > c) for f in range(4) for c in range(11)}
    assert gains[int(forest.feature[0, 0]), int(forest.cut[0, 0])] == pytest.approx(max(gains.values()))
    forest = quality.fit(x, y, weight, trees=20, depth=3)
    assert ((forest.probability(x) >= 0.5) == y).mean() > 0.95
    assert forest.margin(x[:50]) == pytest.approx([plain_margin(forest, r) for r in x[:50]])


def test_weights_are_copies():
    rng = np.random.default_rng(4)
    x = rng.random((100, 3)).astype(np.float32)
    y, n = (x[:, 0] > 0.4).astype(float), rng.integers(1, 5, 100)
    once, copied = (
        quality.fit(np.repeat(x, k, axis=0), np.repeat(y, k), np.repeat(w, k).astype(float), trees=5, depth=2)
        for k, w in ((1, n), (n, np.ones(100)))
    )
    assert once.probability(x) == pytest.approx(copied.probability(x))


def test_held_out_quality_is_told(spark):
    out = quality.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert len(out) > 50 and (out.predicted == out.quality).mean() > 0.95
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_quality_of_odd_rows(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(ODD)] + [(0, None, "x", 0), (None, "no id", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, vector string, quality int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    out = quality.score(docs, labels, fold("doc_id", 3) == 1, trees=3).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 0}) == 1
    assert [r.held_out for r in out if r.doc_id is None] == [None]
    for some in (labels.limit(0), labels.filter("quality IS NULL")):
        assert {r.score for r in quality.score(docs, some, fold("doc_id", 3) == 1).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels, fold("doc_id", 3) == 1).count() == 0


def test_a_text_decides_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    other = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("z")).repartition(13)
    want, got = (
        {r.doc_id: r.score for r in quality.score(d, labels, fold("doc_id", 3) == 1, trees=10).collect()} for d in (docs, other)
    )
    assert got == want


# alignment


def tokenizers():
    path_a, path_b = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    return (lambda t: a.encode(t, add_special_tokens=False).ids, align.byte_level_entries(path_a), b.encode, align.piece_entries(b))


def test_alignment_is_that_of_all_tokens(spark, monkeypatch):
    rng = random.Random(2)
    some = ["the", "thereof", "Übung", "naïve", "3.14", "  ", "\n", "été", "zzzz", "<|endoftext|>", "x"]
    rows = [(i, t[:2000] if t else t) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choices(some, k=rng.randint(1, 40)))) for i in range(60)]
    rows += [rows[20], (None, "the thereof")]
    want, counts = alignments(rows, *tokenizers())
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    monkeypatch.setattr(align, "CHUNK_BYTES", 600)
    for parts in (1, 5):
        df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, place int, chunk string")
        out, pairs = align.align(df.repartition(parts))
        got = [(r.doc_id, *[r[c] for c in columns]) for r in out.collect()]
        key = lambda r: tuple((v is None, v) for v in r)
        assert sorted(got, key=key) == sorted([(i, *w) for (i, _), w in zip(rows, want)], key=key)
        assert {(r.a, r.b): r["count"] for r in pairs.collect()} == dict(counts)


@pytest.mark.parametrize("n", [1, 9, 3000])
def test_postings_round_trip(n):
    rng = np.random.default_rng(n)
    cells = np.unique(rng.integers(0, 3, n) << 16 | rng.integers(0, 40 if n > 100 else 60000, n))
    pair, place, times = cells >> 16, cells & 0xFFFF, rng.integers(1, 9, len(cells)) ** 2 * (cells >> 16) + 1
    packed = align.pack(pair, place, times)
    row, there, number = align.unpack(packed["n_docs"], packed["docs"], packed["planes"])
    assert (packed["pair"][row] == pair).all() and (there == place).all() and (number == times).all()
    assert packed["n_links"].sum() == times.sum()


def test_nothing_to_align(spark):
    out, pairs = align.align(spark.createDataFrame([], "doc_id string, text string"))
    assert out.count() == 0 and pairs.count() == 0
    out, pairs = align.align(spark.createDataFrame([("a", None), ("b", "")], "doc_id string, text string"))
    assert sorted((r.doc_id, r.n_links, r.groups_sha256) for r in out.collect()) == [("a", 0, ""), ("b", 0, "")]


# phrases


def corpus(seed):
    rng = random.Random(seed)
    words = ["of", "the", "a", "Red", "sea", "é", "日本", "x-y", "sea.", "go,", "so\nit", "\tno"]
    rows = []
    for lang in ("en", "en", None, "und", "zz"):
        for _ in range(30):
            rows.append((" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 60))), lang))
        rows += [("a long passage, that all repeat; it is copied often here", lang)] * rng.randint(3, 9)
    return rows + [(None, "en"), ("", None), ("once", "only")]


@pytest.mark.parametrize("top, widen", [(2000, (4, 64, None)), (7, (1, 2, None)), (3, (1, None))])
def test_phrases_are_the_best_of_all(spark, monkeypatch, top, widen):
    monkeypatch.setattr(phrases, "WIDEN", widen)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 500)
    rows = corpus(top)
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "text string, lang string, w1 int, word string").repartition(5)
    out = phrases.mine(df, least=4, top=top)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out.collect())
    assert got == all_phrases(rows, 4, 4, top, 80)


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_phrases_of_other_lengths(spark, longest):
    rows = corpus(longest)
    out = phrases.mine(spark.createDataFrame(rows, "text string, lang string"), least=3, longest=longest, holds=60, top=50)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out.collect())
    assert got == all_phrases(rows, 3, longest, 50, 60)


def test_no_phrases(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert phrases.mine(df).count() == 0
    assert phrases.mine(spark.createDataFrame([("one two", "en")], df.schema)).count() == 0


def test_one_very_long_text(spark):
    rows = [("some words. and more of them, again " * 40_000, "en"), ("some words", "en")]
    out = phrases.mine(spark.createDataFrame(rows, "text string, lang string")).collect()
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out)
    assert got == all_phrases(rows, 30, 4, 2000, 80)
