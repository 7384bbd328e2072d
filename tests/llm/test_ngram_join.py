import random
import re

import numpy as np
import pytest

from webdiag.llm import ngram_join as nj


def _sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def _components(ids, texts):
    sets, parent = _sets(texts), list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, k in enumerate(ids):
        least[root(i)] = min(least.get(root(i), k), k)
    return [(k, len(sets[i]), least[root(i)]) for i, k in enumerate(ids)]


@pytest.fixture(scope="module")
def corpus(odd_texts):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts = list(odd_texts) + ["a b c", "A b C", "a b", "x", "x ", "One line. More", "é É", "é é"]
    for _ in range(25):  # groups of near copies, with distances around the threshold
        n = rnd.choice([4, 5, 6, 7, 9, 12, 30, 64, 65, 127, 129, 300])
        base = [rnd.choice(words) for _ in range(n)]
        for _ in range(rnd.randint(1, 6)):
            own = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, max(1, n // 60), max(1, n // 40)])):
                k = rnd.randrange(len(own))
                own[k:k + 1] = rnd.choice([[], [rnd.choice(words)], [own[k], rnd.choice(words)]])
            texts.append(" ".join(own))
    for _ in range(40):  # one frequent passage
        texts.append(passage + " " + " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 60))))
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return order, texts


@pytest.mark.parametrize("leaf_bytes, broadcast", [(nj.LEAF_BYTES, 1_000_000), (4000, -1)])
def test_equals_brute_force(spark, corpus, monkeypatch, leaf_bytes, broadcast):
    monkeypatch.setattr(nj, "LEAF_BYTES", leaf_bytes)
    monkeypatch.setattr(nj, "BROADCAST_ROWS", broadcast)
    ids, texts = corpus
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)],
                               "doc_id long, text string, component int, set string").repartition(5)
    got = sorted((r.id, r.n_shingles, r.component) for r in nj.join(df).collect())
    assert got == sorted(_components(ids, texts))


def test_null_and_repeated_ids(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text), (None, "alone on its own"), (4, text), (4, text), (2, text), (2, "other words of another text"),
                                (None, None)], "doc_id long, text string")
    got = sorted(((r.id, r.n_shingles, r.component) for r in nj.join(df).collect()), key=str)
    assert got == sorted([(None, 3, 2), (None, 1, None), (4, 3, 2), (4, 3, 2), (2, 3, 2), (2, 1, 2), (None, 0, None)], key=str)
    assert nj.join(df.limit(0)).count() == 0


def test_bounds_never_lose_a_pair():
    rnd = np.random.default_rng(3)
    for n in (5, 9, 40, 200, 1000, 3000):
        for _ in range(20):
            a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
            keep = a[rnd.permutation(len(a))[:int(np.ceil(len(a) * rnd.uniform(.8, 1)))]]
            b = np.unique(np.concatenate([keep, rnd.integers(0, 1 << 63, rnd.integers(0, max(1, n // 9)), dtype=np.uint64)]))
            if not nj.linked(a, b):
                continue
            assert len(np.intersect1d(nj.nodes_of(a), nj.nodes_of(b)))
            counts = nj.points_of([nj.point_of(a), nj.point_of(b)])
            assert 1 in nj.CountTree(counts, np.array([len(a), len(b)])).search(counts[0], len(a))


def test_small_linked_sets_share_a_node():
    """Below EXACT shingles without exception: 100,000 random linked pairs."""
    rnd = np.random.default_rng(5)
    pairs = 0
    while pairs < 100_000:
        n = int(rnd.integers(1, 20))
        pool = rnd.integers(0, 1 << 63, 24, np.uint64) * np.uint64(2)
        a = np.unique(pool[:n])
        for lost in range(4):
            for more in range(4):
                b = np.unique(np.concatenate([a[lost:], pool[20:20 + more]]))
                if len(b) and nj.linked(a, b):
                    pairs += 1
                    assert np.intersect1d(nj.nodes_of(a), nj.nodes_of(b)).size


def test_nine_words_and_their_first_eight(spark):
    text = "word3931 word2860 word4852 word1194 word1514 word3909 word1805 word2910 word2482"
    docs = spark.createDataFrame([(1, text), (2, text.rsplit(" ", 1)[0]), (3, "other words")], "doc_id long, text string")
    assert {r["id"]: r["component"] for r in nj.join(docs).collect()} == {1: 1, 2: 1, 3: 3}
