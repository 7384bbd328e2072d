"""Near-duplicate embeddings by a forest of random-projection trees.

A tree splits the unit vectors again and again at the median of their
projections on a random direction. Vectors within a margin of the split go to
both sides (spill overlap). The margin is ``SPILL`` standard deviations of the
projection of the longest linked difference, so that a split parts a linked
pair only when their projections lie more than twice that apart and on either
side; with ``TREES`` independent trees a pair is missed when every tree parts
it (about 1e-8). Directions follow from a seed; the first medians come from a
bounded sample of ``SAMPLE`` vectors, and every vector is indexed. A leaf that
holds more than ``FULL`` times the aim is split further, by medians of a sample
of its own rows (``REFIT`` expected) taken by one task a leaf, again and again:
the size of leaves does not grow with the number of vectors. A split that
leaves most rows within its margin is not made, since either side would hold
nearly all of them: a tight group stays in one leaf of a tree.

Vectors of equal label and size meet in the leaves. Equal vectors are one row
there. A leaf of more than ``BLOCK`` rows is cut into blocks that meet
pairwise, so no leaf is collected whole. A pair that shares several leaves is
counted in the first. Tasks return link counts and a forest of links, not
pairs.

Rows: a null label or vector, null or non-finite components and zero vectors
link with nothing (0 links, a component of their own); rows with equal ids are
vectors of their own; rows without an id get the smallest id of their
component, null where there is none. An empty table gives no row. Other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, groups_of, map_arrow, table
from .graph import components

COSINE = 0.98
TREES = 4
SPILL = 1.3
SAMPLE = 65_536
LEAF = 2048           # vectors of all labels that a leaf aims at
FULL = 4              # a leaf of more than so many times LEAF vectors of a label is split further
REFIT = 2048          # vectors expected in the sample of such a leaf
LEAST = 32            # sampled vectors that a median needs
TIGHT = 0.3           # no split where more than this share of rows lies within the margin: both sides would grow faster than they part
DEEP = 44             # bits of a node's number within its tree
BLOCK = 2048          # rows of a leaf that one task compares with as many
NEAR = 1e-9           # products this close to the threshold are computed by the definition
SEED = 20_240_601


def direction(tree: int, node: int, size: int) -> np.ndarray:
    v = np.random.default_rng([SEED, tree, node, size]).standard_normal(size)
    return v / np.linalg.norm(v)


def margin(size: int, cosine: float) -> float:
    return SPILL * np.sqrt((2 - 2 * cosine) / size)


def grow(vectors: np.ndarray, tree: int, least: int, spill: float, root: int = 1) -> dict[int, float]:
    """Medians of the inner nodes below ``root`` of a tree over sampled unit
    vectors; node n's children are 2n and 2n + 1. A node of at most ``least``
    sampled vectors is a leaf."""
    splits: dict[int, float] = {}
    todo = [(root, np.arange(len(vectors)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= least or node >= 1 << (DEEP - 4):
            continue
        p = vectors[rows] @ direction(tree, node, vectors.shape[1])
        t = float(np.median(p))
        low = p <= t
        if low.all() or not low.any() or (np.abs(p - t) <= spill).mean() > TIGHT:
            continue
        splits[node] = t
        todo += [(2 * node, rows[low]), (2 * node + 1, rows[~low])]
    return splits


def route(vectors: np.ndarray, tree: int, splits: dict[int, float], spill: float, root: int = 1) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows) of unit vectors below ``root`` of a tree."""
    out, todo = [], [(root, np.arange(len(vectors)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        t = splits.get(node)
        if t is None:
            out.append((node, rows))
            continue
        p = vectors[rows] @ direction(tree, node, vectors.shape[1])
        todo += [(2 * node, rows[p <= t + spill]), (2 * node + 1, rows[p > t - spill])]
    return out


def _unit(lists: list) -> np.ndarray:
    x = np.array(lists, np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _close(a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of a and b have at least the cosine; u and v are their unit vectors."""
    got = u @ v.T
    yes = got >= cosine
    for i, j in zip(*np.nonzero(np.abs(got - cosine) <= NEAR)):
        yes[i, j] = float(np.dot(a[i], b[j])) / (float(np.sqrt(np.dot(a[i], a[i]))) * float(np.sqrt(np.dot(b[j], b[j])))) >= cosine
    return yes


def compare(ids, x, copies, leaves, side, leaf: int, cosine: float):
    """(id, links, other) of a leaf's rows: links counts copies of linked rows
    that share no earlier leaf, other is a row it is connected with."""
    n = len(ids)
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    yes = _close(x, x, u, u, cosine)
    np.fill_diagonal(yes, False)
    if 1 in side:
        side = np.array(side)
        yes &= side[:, None] != side[None, :]
    earlier = sorted({k for row in leaves for k in row if k < leaf})
    fresh = yes
    if earlier:
        place = {k: c for c, k in enumerate(earlier)}
        has = np.zeros((n, len(earlier)), np.float32)
        for r, row in enumerate(leaves):
            for k in row:
                if k < leaf:
                    has[r, place[k]] = 1
        fresh = yes & ((has @ has.T) == 0)
    links = fresh @ np.array(copies, np.int64)
    label = np.arange(n)
    while True:  # smallest row of each component of the leaf
        new = np.minimum(label, np.where(yes, label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(ids[i], int(links[i]), ids[label[i]]) for i in range(n) if links[i] or label[i] != i]


def _planted(own: DataFrame, cosine: float) -> dict[int, list[dict[int, float]]]:
    """Trees per vector length, for lengths that more than LEAF vectors have;
    vectors of another length are one leaf. The medians are those of at most
    SAMPLE vectors of a length, taken by smallest hash."""
    forests = {}
    for size, n in own.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).filter(F.col("n") > LEAF).collect():
        some = own.filter(F.size("v") == size).orderBy("node").limit(SAMPLE)
        least = max(LEAST, min(n, SAMPLE) * LEAF // n)
        forest = [dict() for _ in range(TREES)]
        for t, node, split in map_arrow(some.select("v").coalesce(1), _trainer(least, margin(size, cosine)),
                                        "tree int, node long, split double").collect():
            forest[t][node] = split
        forests[size] = forest
    return forests


def _dealer(forests, cosine: float):
    """Rows of (node, copies, v, family) with the leaves they belong to."""
    def deal(batches):
        for batch in batches:
            v = batch.column(2).to_pylist()
            by_size: dict[int, list[int]] = {}
            for k, x in enumerate(v):
                by_size.setdefault(len(x), []).append(k)
            found = [[] for _ in v]
            for size, at in by_size.items():
                u = _unit([v[k] for k in at])
                for t, splits in enumerate(forests.get(size, [{}])):
                    for leaf, hit in route(u, t, splits, margin(size, cosine)):
                        for k in hit:
                            found[at[k]].append(t << DEEP | leaf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))],
                                             ["node", "copies", "v", "family", "leaves"])

    return deal


def _refitter(cosine: float, aim: int):
    """Splits below full leaves; for sampled rows (family, leaf, rows, v) sorted by leaf."""
    def refit(batches):
        for (family, leaf), slices in groups_of(batches, 2):
            u = _unit([x for s in slices for x in s.column(3).to_pylist()])
            least = max(LEAST, len(u) * aim // slices[0].column(2)[0].as_py())
            got = grow(u, leaf >> DEEP, least, margin(u.shape[1], cosine), leaf & ((1 << DEEP) - 1))
            if got:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([family], pa.int64()), pa.array([leaf], pa.int64()),
                     pa.array([list(got)], pa.list_(pa.int64())), pa.array([list(got.values())], pa.list_(pa.float64()))],
                    ["family", "leaf", "nodes", "splits"])

    return refit


def _onward(cosine: float):
    """(node, gone, new): the leaves that take the place of a full one, for
    rows (family, leaf, node, v, nodes, splits)."""
    def onward(batches):
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                groups.setdefault(key, []).append(k)
            v, new = batch.column(3).to_pylist(), [[] for _ in range(batch.num_rows)]
            for (_, leaf), at in groups.items():
                splits = dict(zip(batch.column(4)[at[0]].as_py(), batch.column(5)[at[0]].as_py()))
                u, tree = _unit([v[k] for k in at]), leaf >> DEEP
                for child, hit in route(u, tree, splits, margin(u.shape[1], cosine), leaf & ((1 << DEEP) - 1)):
                    for k in hit:
                        new[at[k]].append(tree << DEEP | child)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(new, pa.list_(pa.int64()))],
                                             ["node", "gone", "new"])

    return onward


def _sizes(placed: DataFrame) -> DataFrame:
    return cut(placed.select("family", F.explode("leaves").alias("leaf")).groupBy("family", "leaf").agg(F.count("*").alias("rows"))
               .filter("rows > 1"))


def _divided(placed: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(placed, sizes of its leaves) once no leaf of more than FULL * LEAF rows
    can be split. Each round divides such leaves by up to REFIT / LEAST and ends
    with fewer rows or deeper nodes, so there are few."""
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = _sizes(placed)
    while True:
        full = sizes.filter(F.col("rows") > FULL * LEAF)
        if full.isEmpty():
            return placed, sizes
        in_full = placed.select("family", F.explode("leaves").alias("leaf"), "node", "v").join(full, ["family", "leaf"])
        share = F.pmod(F.xxhash64("node", "leaf"), F.lit(1 << 30)) * F.col("rows") < (REFIT << 30)
        sampled = (in_full.filter(share).select("family", "leaf", "rows", "v")
                   .repartition(parts, "family", "leaf").sortWithinPartitions("family", "leaf"))
        splits = cut(map_arrow(sampled, _refitter(cosine, LEAF), "family long, leaf long, nodes array<long>, splits array<double>"))
        if splits.isEmpty():
            return placed, sizes
        moving = in_full.join(splits, ["family", "leaf"]).select("family", "leaf", "node", "v", "nodes", "splits")
        moved = (map_arrow(moving, _onward(cosine), "node long, gone long, new array<long>").groupBy("node")
                 .agg(F.collect_list("gone").alias("gone"), F.flatten(F.collect_list("new")).alias("new")))  # a row's own leaves
        placed = cut(placed.join(moved, "node", "left").select(
            "node", "copies", "v", "family", F.when(F.col("gone").isNull(), F.col("leaves")).otherwise(
                F.concat(F.array_except("leaves", "gone"), "new")).alias("leaves")))
        sizes = _sizes(placed)


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
          cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component) per vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    fine = (F.col("label").isNotNull() & F.col("v").isNotNull()
            & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
            & F.exists("v", lambda c: c != 0))
    rows = rows.withColumn("node", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("label", F.size("v"), "v")))
    # a row for equal vectors
    own = cut(rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("id").alias("least"), F.any_value("label").alias("label"), F.any_value("v").alias("v")))
    placed = cut(map_arrow(own.select("node", "copies", "v", F.xxhash64("label", F.size("v")).alias("family")),
                           _dealer(_planted(own, cosine), cosine),
                           "node long, copies long, v array<double>, family long, leaves array<long>"))
    placed, sizes = _divided(placed, cosine)
    in_leaf = placed.withColumn("leaf", F.explode("leaves"))
    # what shares a leaf's family with nothing needs no comparison
    counts = sizes.select("family", "leaf", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = (in_leaf.join(counts, ["family", "leaf"]).withColumn("own", block)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("family", "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                      "own", "node", "copies", "v", "leaves"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartition(parts, "family", "leaf", "i", "j").sortWithinPartitions("family", "leaf", "i", "j")

    def meet(batches):
        for (_, leaf, i, j), slices in groups_of(batches, 4):
            own, node, copies, v, lists = ([x for s in slices for x in s.column(k).to_pylist()] for k in range(4, 9))
            side = [int(i != j and o == j) for o in own]
            got = compare(node, np.array(v, np.float64), copies, lists, side, leaf, cosine)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in range(3)],
                                                 ["node", "links", "other"])

    met = cut(map_arrow(dealt, meet, "node long, links long, other long"))
    counted = met.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(met.select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = (own.select("node", "copies", "least").join(counted, "node", "left")
             .join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
    smallest = known.groupBy("root").agg(F.min("least").alias("component"))
    by_node = (known.join(smallest, "root")
               .select(F.col("node").alias("of"), "component",
                       (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return (rows.select("id", "node").join(by_node, F.col("node") == F.col("of"), "left")
            .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("component")).alias("component")))


def _trainer(least: int, spill: float):
    def train(batches):
        lists = [x for b in batches for x in b.column(0).to_pylist()]
        unit = _unit(lists) if lists else None
        rows = [(t, node, split) for t in range(TREES if lists else 0) for node, split in grow(unit, t, least, spill).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                          pa.array([r[2] for r in rows], pa.float64())], ["tree", "node", "split"])

    return train


def op10_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
