import numpy as np
import pytest

from webdiag.llm import embedding_forest as ef


def _brute(rows):
    fine = []
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v):
            fine.append((i, np.array(v, np.float32).astype(float), label))
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fine)):
        for b in range(a):
            (i, x, k), (j, y, m) = fine[a], fine[b]
            if k == m and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= ef.COSINE:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted([(r[0], links[i], least.get(root(i))) for i, r in enumerate(rows)], key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(6)
    out = []
    for c in range(40):
        base = rnd.standard_normal(64)
        base /= np.linalg.norm(base)
        for _ in range(rnd.integers(1, 25)):
            out.append((base + rnd.standard_normal(64) * rnd.choice([0, .01, .018, .025]), c % 3))
    rows = [(int(i), [float(x) for x in np.float32(v)], k) for i, (v, k) in zip(rnd.permutation(len(out)), out)]
    some = rows[0][1]
    return rows + [(5000, None, 1), (5001, some, None), (5002, [0.0] * 64, 1), (5003, [float("nan")] + some[1:], rows[0][2]),
                   (5004, [None] + some[1:], rows[0][2]), (5005, [float("inf")] + some[1:], rows[0][2]), (5006, [], 1),
                   (5007, [1.0, 2.0], 1), (5008, [2.0, 4.0], 1), (None, some, rows[0][2]), (5009, some, rows[0][2]), (5009, some, rows[0][2])]


@pytest.mark.parametrize("block, leaf", [(ef.BLOCK, ef.LEAF), (16, 40)])
def test_equals_brute_force(spark, rows, monkeypatch, block, leaf):
    monkeypatch.setattr(ef, "BLOCK", block)
    monkeypatch.setattr(ef, "LEAF", leaf)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "vec_id long, embedding array<float>, label int, node string, copies int").repartition(3)
    got = sorted(((r.id, r.n_links, r.component) for r in ef.links(df).collect()), key=str)
    assert got == _brute(rows)


def test_empty_table(spark, rows):
    df = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, label int")
    assert ef.links(df.limit(0)).count() == 0
    assert ef.links(df.filter("label IS NULL")).count() == 0


def _brute_links(ids, x, labels, cosine):
    """Number of links per id, block by block."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    n = np.zeros(len(x), int)
    for at in range(0, len(x), 1000):
        n[at:at + 1000] = ((u[at:at + 1000] @ u.T >= cosine) & (labels[at:at + 1000, None] == labels[None, :])).sum(axis=1) - 1
    return dict(zip(ids.tolist(), n.tolist()))


def _frame(spark, ids, x, labels):
    import pandas as pd
    return spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": list(x), "label": labels}),
                                 "vec_id long, embedding array<double>, label int").repartition(4)


def test_leaves_stay_small_beyond_the_sample(spark, monkeypatch):
    """The sample's medians alone would make leaves of more than twice the bound."""
    for name, value in (("SAMPLE", 256), ("LEAF", 128), ("REFIT", 1024), ("BLOCK", 64)):
        monkeypatch.setattr(ef, name, value)
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal((1000, 48))
    x = np.concatenate([base, base + rnd.standard_normal(base.shape) * 0.12, rnd.standard_normal((800, 48))])
    ids, labels = np.arange(len(x)), np.concatenate([np.zeros(2000, int), np.ones(800, int)])
    seen = {}
    divided = ef._divided

    def watch(placed, cosine):
        seen["first"] = ef._sizes(placed).agg({"rows": "max"}).first()[0]
        placed, sizes = divided(placed, cosine)
        seen["last"] = sizes.agg({"rows": "max"}).first()[0]
        return placed, sizes
    monkeypatch.setattr(ef, "_divided", watch)
    got = {r.id: r.n_links for r in ef.links(_frame(spark, ids, x, labels)).collect()}
    assert seen["first"] > 2 * ef.FULL * ef.LEAF >= 2 * seen["last"]
    assert got == _brute_links(ids, x, labels, ef.COSINE)


def test_tight_group_lies_in_one_leaf_of_a_tree(spark, monkeypatch):
    monkeypatch.setattr(ef, "LEAF", 64)
    rnd = np.random.default_rng(4)
    centre = rnd.standard_normal(32)
    x = np.concatenate([centre + rnd.standard_normal((900, 32)) * 0.01, rnd.standard_normal((900, 32))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for tree in range(ef.TREES):
        spill = ef.margin(32, ef.COSINE)
        leaves = ef.route(unit, tree, ef.grow(unit, tree, 64, spill), spill)
        whole = [leaf for leaf, hit in leaves if (hit < 900).sum() == 900]
        assert 1 <= len(whole) <= 4  # splits made for the other vectors may pass through the group
        tight = ef.grow(unit[:900], tree, 64, spill)
        assert tight == {}
    ids, labels = np.arange(len(x)), np.zeros(len(x), int)
    got = {r.id: r.n_links for r in ef.links(_frame(spark, ids, x, labels)).collect()}
    assert got == _brute_links(ids, x, labels, ef.COSINE)
