"""Near-duplicates, contamination and exact search against brute force."""

import hashlib
import random

import numpy as np
import pytest
from brute import contamination, groups, words

from holdfast.llm import components, minhash, topk, winnow

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY) + "x"
    return " ".join(w)


ODD = [None, "", "  \n\t", "one", "One", "two words", "two  WORDS\n", "a b c", "a b c a b c a b c", "é ß 日本 é ß 日本"]


@pytest.fixture(scope="module")
def copies():
    """Odd texts, exact copies, chains of near copies, and a crowd around one text."""
    texts = list(ODD)
    base = prose(120)
    texts += [base] * 5 + [base.upper(), base.replace(" ", "\n")]
    chain = prose(150)
    for _ in range(8):
        chain = edited(chain, 3)
        texts.append(chain)
    crowd = prose(100)
    texts += [edited(crowd, rng.randint(1, 7)) for _ in range(60)]
    texts += [prose(rng.randint(1, 60)) for _ in range(40)]
    docs = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    return docs + [docs[0], docs[0], (None, base), (None, "alone in the world")]


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_groups_are_those_of_all_pairs(spark, copies, n, percent, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 16)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in copies], "doc_id long, text string, class string, bands int")
    got = minhash.near_duplicates(df, words=n, percent=percent).drop("text_hash").collect()
    want = [(i, s, c, i == c) for (i, _), (s, c) in zip(copies, groups(copies, n, percent))]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_one_document_of_each_group_stays(spark, copies):
    df = spark.createDataFrame([(i, t, "x") for i, t in copies], "doc_id long, text string, class string")
    out = minhash.deduplicate(df, words=3, percent=85)
    assert out.columns == df.columns
    found = groups(copies, 3, 85)
    want = {(i, t) for (i, t), (n, c) in zip(copies, found) if i == c}
    rows = [(r.doc_id, r.text) for r in out.collect()]
    assert set(rows) == want
    repeated = [r for r in rows if rows.count(r) > 1]
    assert not [t for _, t in repeated if words(t)]


def test_very_long_texts_are_compared_whole(spark):
    long = " ".join(f"w{i % 70_001}x{i % 11}" for i in range(200_000))
    near, far = long + " a few words more", " ".join(reversed(long.split(" ")))
    df = spark.createDataFrame([(1, long), (2, near), (3, far), (4, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert [got[i][1] for i in (1, 2, 3, 4)] == [1, 1, 3, 4] and got[1][0] == len(set(zip(*[long.split(" ")[k:] for k in range(5)])))
    passage = " ".join(f"item{i}" for i in range(40))
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    df = spark.createDataFrame([(1, f"{long} {passage}"), (2, f"{passage} {long} {passage}")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in winnow.contamination(df, items).collect()}
    assert got == {1: (200_040, 40, 1, False), 2: (200_080, 80, 1, False)}


def test_no_documents_no_groups(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).collect() == [] and minhash.deduplicate(empty).collect() == []
    blank = spark.createDataFrame([(1, ""), (2, ""), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash.deduplicate(blank).collect()) == [1, 2, 3]


def test_bands_miss_next_to_nothing():
    for similarity in (0.5, 0.8, 0.85, 0.95):
        bands = minhash.n_bands(similarity)
        assert (1 - similarity**minhash.ROWS) ** bands <= 1e-6


def test_small_sets_agree_less_and_are_not_missed(spark):
    """Of five shingles four in common: every such pair among all pairs is found."""
    assert minhash.agreement(0.8) == pytest.approx(0.6) and minhash.agreement(0.85) < 0.85**2
    docs = []
    for i in range(0, 600, 2):
        w = [f"{i}w{k}" for k in range(9)]
        docs += [(i, " ".join(w[:8])), (i + 1, " ".join([*w[:8], w[8]]))]  # 4 and 5 shingles of five words
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(600)}


def test_signature_agreement_is_the_similarity():
    shared, a, b = (np.random.default_rng(i).integers(0, 2**63, n).astype(np.uint64) for i, n in ((0, 800), (1, 100), (2, 100)))
    values = np.concatenate([np.sort(np.r_[shared, a]), np.sort(np.r_[shared, b])])
    keys = minhash.band_keys(values, np.array([0, 900, 1800]), 2000, rows=2)
    assert abs((keys[0] == keys[1]).mean() - 0.8**2) < 0.04


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    rng.shuffle(links)
    got = {r.id: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_contaminated_words_are_those_of_any_window(spark):
    items = [(i, prose(rng.randint(14, 40))) for i in range(12)]
    items += [(12, "short one here"), (13, "SHORT, one; here"), (14, ""), (15, None), (None, prose(20)), (16, "w"), (3, prose(15))]
    items.append((17, items[0][1] + " " + items[1][1]))
    docs = [(i, t) for i, t in enumerate(ODD)]
    for i in range(100, 140):
        parts = [prose(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(items)[1])
            low = rng.randrange(len(w) + 1)
            parts += [", ".join(w[low : low + rng.randint(1, 30)]), prose(rng.randint(0, 9))]
        docs.append((i, " ".join(parts)))
    docs += [(7, "and a short one here too"), (7, "and a short one here too"), (None, items[2][1]), (200, items[5][1] * 1)]
    docs.append((201, "-".join([items[4][1]] * 50)))
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, span int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, length int")
    got = [tuple(r) for r in winnow.contamination(df, bench).drop("text_hash").collect()]
    want = []
    for doc_id, text in docs:
        n, hit, found = contamination(text, items)
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        want.append((doc_id, n, hit, len(found), digest, hit > 0 and 20 * hit >= n))
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = sorted((tuple(r) for r in winnow.decontaminate(df, bench).collect()), key=str)
    assert kept == sorted(((i, t, 0) for (i, t), w in zip(docs, want) if not w[-1]), key=str)


def test_nothing_to_decontaminate(spark):
    docs = spark.createDataFrame([(1, prose(30)), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in winnow.contamination(docs, none).collect()] == [0, 0]
    assert winnow.contamination(docs.limit(0), docs.toDF("item_id", "text")).collect() == []
    assert winnow.decontaminate(docs, none).count() == 2


def exact(rows, queries, k):
    out = []
    for q, v in queries:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in set(rows) if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [9, 10**6, 10**9])
def test_search_finds_the_best_and_breaks_ties(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "CHUNK", 7)
    r = np.random.default_rng(scale)
    rows = [(i, tuple(r.integers(-scale, scale, 5).tolist())) for i in range(240)]
    rows += [(i, rows[3][1]) for i in range(300, 400)] + [rows[9], rows[9]]
    rows += [(500, (0,) * 5), (501, (1, 2)), (550, (3, 4)), (600, (1,) * 7)]
    queries = [x for x in dict.fromkeys(rows) if x[0] % 50 == 0]
    df = spark.createDataFrame([(i, list(v)) for i, v in rows] + [(None, [1] * 5), (650, None), (700, [])], "vec_id long, vector array<long>")
    got = sorted(tuple(x) for x in topk.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect())
    assert got == exact(rows, queries, 5)


def test_walk_stops_before_the_end():
    r = np.random.default_rng(0)
    vectors = r.integers(-5, 5, (4000, 3))
    vectors[17] = 90
    lists = topk.Lists(np.arange(4000), vectors, 1, np.float32)
    scored = []

    class Counting(np.ndarray):
        def __matmul__(self, other):
            scored.append(len(self) if self.ndim == 2 else 0)
            return np.asarray(self) @ other

    lists.vectors = lists.vectors.view(Counting)
    ids, _ = lists.top(np.array([1, 2, 3], dtype=np.float32), -1, 1)
    assert ids.tolist() == [17] and sum(scored) < 1000


def test_components_that_take_no_part(spark):
    rows = [(0, [0.5, 1.0]), (1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, None), (4, [float("inf"), 0.0]), (5, [-0.001, 0.999])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.v for r in df.select("vec_id", topk.quantised().alias("v")).collect()}
    assert got == {0: [128, 256], 1: None, 2: None, 3: None, 4: None, 5: [-1, 255]}
    assert topk.top_k(df.select("vec_id", topk.quantised().alias("vector")).limit(0), df.select("vec_id", topk.quantised().alias("vector"))).collect() == []


def test_other_columns_of_a_search_do_not_matter(spark):
    rows = [(i, [i, 3 - i, i % 2]) for i in range(7)]
    plain = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    clashing = plain.selectExpr("vec_id", "vector", "1 AS score", "'x' AS part", "2 AS query_id", "3 AS rank", "4 AS size", "5 AS block")
    want, got = (sorted(map(tuple, topk.top_k(d, d.filter("vec_id < 3"), 2).collect())) for d in (plain, clashing))
    assert got == want and len(want) == 6
