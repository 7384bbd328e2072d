"""N-gram Jaccard join over count vectors.

A text's set is its distinct 5-word shingles (fewer words: the whole sequence
as one). Every shingle is hashed into groups and a set becomes the point of its
group counts. The overlap of two sets is at most the sum over the groups of the
smaller count, so the points' L1 distance is at most that of the sets: with
100 |A n B| >= 80 |A u B| it is at most (|A| + |B|) / 9.

The upper levels of the tree over the points spread over the cluster. Sizes
are cut into bands [L, 2L); within a band the coordinates are cut into slabs,
more than the distance can reach, so two linked sets agree exactly in some
slab that is not empty, and a node of the tree is a slab with its content.
Each set goes to the nodes of its band, and to those of the band below when it
is small enough to have partners there. Below ``EXACT`` shingles each shingle
is a slab of its own, so that linked sets share a node whatever their hashes.
With ``FINE`` slabs per shingle for small sets and ``COARSE`` for larger ones a
linked pair shares none with a probability below 1e-12: all of the m shingles
it shares, m at least 16 and four fifths of the union, would have to lie in the
slabs of the at most m / 4 others. A node's sets all
go to the smallest of them, the node's centre, and nodes with one centre form
one leaf: its centre and every set that shares a node with it.

In a leaf, an R-tree over the group counts finds the members whose overlap the
bound by summed minima cannot rule out, box by box. First only the points
travel, and members whose bound fails with all others leave the leaf; the
shingles of the rest follow, and exact intersections verify the pairs that
survive. Members linked with the centre are one component already and are not
compared again with each other, so a leaf of n near copies costs n
verifications. Large leaves are cut into blocks that meet pairwise, each with
the centre; no group is collected whole. Links come out as edges of a forest,
and alternating stars join them over all leaves.

Sets are identified by 64-bit hashes of their content, shingles by 64-bit
hashes. Equal sets are one node from the start.

Rows: null and empty texts have the empty set and are linked with nothing, not
even each other; rows with equal ids are rows of their own, linked when their
sets are; rows without an id come back with the smallest id of their component,
which is null when none has one. An empty table gives no row. Other columns
are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, cut, forget_newer, groups_of, map_arrow, table, whole_text
from .graph import components

SHINGLE = 5
PERCENT = 80          # 100 * intersection >= PERCENT * union
EXACT = 16            # shingles of the first band with slabs of several shingles
FINE, COARSE, SMALL = 4.0, 0.75, 64   # slabs per shingle of a band below and from SMALL
GROUPS = 64           # least coordinates of a point; sets of [2^b, 2^(b+1)) shingles have 2^(b-1)
NODE = 32             # points in a box
LEAF_BYTES = 48 << 20  # of points or shingles that one task holds of a leaf, twice
MEMO_WORDS = 300_000
SEND_NODES = 400_000  # of documents that a task sends together
BROADCAST_ROWS = 1_000_000

_U = np.uint64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], _U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(29))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


class Shingler:
    """Sets of texts; remembers the hashes of words."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.memo = size, {}

    def set_of(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of a text's shingles."""
        words = text.encode("utf-8", "replace").translate(LOWER).split()  # at bytes 9 to 13 and 32
        n, memo = len(words), self.memo
        if not n:
            return np.empty(0, _U)
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), _U, n)
        if len(memo) > MEMO_WORDS:
            forget_newer(memo)
        k = min(n, self.size)
        out = h[:n - k + 1] * ODD[0]
        for i in range(1, k):
            out = (out ^ (out >> _U(31))) * ODD[1] + h[i:n - k + 1 + i] * ODD[i % 5]
        return np.unique(_mix(out + _U(k)))


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    total = _mix(shingles ^ ODD[2]).sum(dtype=_U) + _U(len(shingles))
    return int(_mix(np.array([total], _U)).view(np.int64)[0])


def nodes_of(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes of the tree's nodes that a set belongs to."""
    n = len(shingles)
    top = int(n).bit_length() - 1
    bands = [top]
    if top and n * percent <= 100 * ((1 << top) - 1):
        bands.append(top - 1)  # partners down to percent of its size
    out = []
    content = _mix(shingles ^ ODD[3])
    place = _mix(shingles ^ ODD[4]) >> _U(32)
    for band in bands:
        low = 1 << band
        if low < EXACT:
            out.append(_mix(content + _U(band) * ODD[1]))
            continue
        slabs = max(2, int(low * (FINE if low < SMALL else COARSE)))
        slab = (place * _U(slabs)) >> _U(32)
        order = np.argsort(slab, kind="stable")
        slab = slab[order]
        at = np.flatnonzero(np.r_[True, slab[1:] != slab[:-1]])
        sums = np.add.reduceat(content[order], at)
        out.append(_mix(sums + (slab[at] << _U(8) | _U(band)) * ODD[1]))
    return np.concatenate(out)


def point_of(shingles: np.ndarray) -> bytes:
    """A set's group counts: the size of a number, then the numbers."""
    groups = max(GROUPS, 1 << max(0, len(shingles).bit_length() - 2))
    counts = np.bincount((shingles & _U(groups - 1)).astype(np.int64), minlength=groups)
    kind = "<u1" if counts.max() < 256 else "<u4"
    return bytes([int(kind[2])]) + counts.astype(kind).tobytes()


def points_of(blobs: list[bytes]) -> np.ndarray:
    """Points with as many coordinates as the smallest has: groups are the low
    bits of a hash, so that halves can be added up."""
    rows = [np.frombuffer(b, f"<u{b[0]}", offset=1) for b in blobs]
    least = min(len(r) for r in rows)
    return np.stack([r.reshape(-1, least).sum(axis=0, dtype=np.int32) for r in rows])


class CountTree:
    """R-tree of group counts: boxes of ``NODE`` points in order of size and
    of their largest coordinates; a box keeps its largest counts and sizes."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        main = counts.astype(np.int32) @ np.sign(np.random.default_rng(7).standard_normal((counts.shape[1], 1))).astype(np.int32)
        self.order = np.lexsort((main[:, 0], sizes))
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        at = np.arange(0, len(sizes), NODE)
        self.high = np.maximum.reduceat(self.counts, at, axis=0)
        self.small, self.large = np.minimum.reduceat(self.sizes, at), np.maximum.reduceat(self.sizes, at)

    def search(self, point: np.ndarray, size: int, percent: int = PERCENT) -> np.ndarray:
        """Indices of the points whose overlap may suffice."""
        def may(counts, least):
            # overlap o suffices if 100 o >= percent (size + other - o)
            return (100 + percent) * np.minimum(counts, point).sum(axis=1, dtype=np.int64) >= percent * (size + least)

        box = np.flatnonzero((self.large * 100 >= percent * size) & (self.small * percent <= 100 * size))
        box = box[may(self.high[box], self.small[box])]
        rows = (box[:, None] * NODE + np.arange(NODE)).ravel()
        rows = rows[rows < len(self.sizes)]
        return self.order[rows[may(self.counts[rows], self.sizes[rows])]]


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets are linked."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) * 100 < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def leaf_edges(ids: list[int], sets: list[np.ndarray], side: list[int], centre: int, percent: int = PERCENT):
    """Forest edges among a leaf's members; ``side`` is 0 or 1, members of one
    block (side 2: the centre) are compared only when all are of side 0."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    rest = []
    for i in range(len(ids)):
        if i != centre:
            if linked(sets[centre], sets[i], percent):
                parent[i] = centre
            else:
                rest.append(i)
    if rest and len(ids) > 2:
        sizes = np.array([len(s) for s in sets])
        counts = points_of([point_of(s) for s in sets])
        tree = CountTree(counts, sizes)
        crossed = 1 in side
        for i in rest:
            for j in tree.search(counts[i], int(sizes[i]), percent):
                if j == centre or j == i or crossed and side[i] == side[j] or root(i) == root(j):
                    continue
                if linked(sets[i], sets[j], percent):
                    parent[root(i)] = root(j)
    return [(ids[i], ids[root(i)]) for i in range(len(ids)) if root(i) != i]


def leaf_members(points: np.ndarray, sizes: np.ndarray, side: list[int], centre: int, percent: int = PERCENT) -> np.ndarray:
    """Which members of a leaf have another one that the bound doesn't rule out."""
    enough = (100 + percent) * np.minimum(points, points[centre]).sum(axis=1, dtype=np.int64) >= percent * (sizes + sizes[centre])
    enough &= (sizes * 100 >= percent * sizes[centre]) & (sizes * percent <= 100 * sizes[centre])
    enough[centre] = False
    found = enough.copy()
    rest = np.flatnonzero(~enough)
    if len(rest) > 1 and len(sizes) > 2:
        tree = CountTree(points, sizes)
        crossed = 1 in side
        for i in rest:
            if i == centre:
                continue
            near = tree.search(points[i], int(sizes[i]), percent)
            near = near[(near != i) & (near != centre)]
            if crossed:
                near = near[np.array(side)[near] != side[i]]
            if len(near):
                found[i] = True
                found[near] = True
    return found


def _first_pass(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows of documents (kind 1: id, set, n, mark, point) and pairs of sets and their
    leaves' centres (kind 0: centre, member), the latter once per partition."""
    src = docs.select(F.col("id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = 8 * parts  # nodes travel in as many cells, dealt by hash

    def emit(batches):
        shingler = Shingler(size)
        for batch in batches:
            for part in batches_of(batch, 2048):
                keys, marks, sets, ns, points, nodes, held = [], [], [], [], [], [], 0
                for key, text, mark in zip(*[c.to_pylist() for c in part.columns]):
                    s = shingler.set_of(text)
                    keys.append(key)
                    marks.append(mark)
                    sets.append(set_id(s))
                    ns.append(len(s))
                    points.append(point_of(s) if len(s) else None)
                    nodes.append(nodes_of(s, percent) if len(s) else np.empty(0, _U))
                    held += len(nodes[-1])
                    if held >= SEND_NODES:
                        yield packed(keys, marks, sets, ns, points, nodes)
                        keys, marks, sets, ns, points, nodes, held = [], [], [], [], [], [], 0
                if keys:
                    yield packed(keys, marks, sets, ns, points, nodes)

    def packed(keys, marks, sets, ns, points, nodes):
        """A row per cell with the nodes in it, and a row per document."""
        owner = np.repeat(np.arange(len(nodes)), [len(x) for x in nodes])
        node = np.concatenate(nodes)
        cell = (node >> _U(40)) % _U(cells)
        order = np.argsort(cell, kind="stable")
        node, owner, cell = node[order], np.array(sets, np.int64)[owner[order]], cell[order]
        bounds = np.searchsorted(cell, np.arange(cells + 1).astype(_U))
        blobs, which = [], []
        for c in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[c], bounds[c + 1]
            # owners once, then each node's owner's place and its lower 32 bits
            own, at = np.unique(owner[a:b], return_inverse=True)
            blobs.append(len(own).to_bytes(4, "little") + own.tobytes() + at.astype("<u2").tobytes()
                         + node[a:b].astype("<u4").tobytes())
            which.append(int(c))
        k = len(blobs)
        return pa.RecordBatch.from_arrays(
            [pa.array([0] * k + [1] * len(keys), pa.int32()), pa.array(which + [x % cells for x in sets], pa.int32()),
             pa.array([None] * k + keys, pa.int64()), pa.array([None] * k + sets, pa.int64()),
             pa.array([None] * k + ns, pa.int64()), pa.array([None] * k + marks, pa.int64()),
             pa.array(blobs + points, pa.binary())], ["kind", "cell", "a", "b", "n", "mark", "blob"])

    sent = map_arrow(src, emit, "kind int, cell int, a long, b long, n long, mark long, blob binary")

    def meet(batches):
        """Cells of a partition one after the other: sets that share a node."""
        for (cell, kind), slices in groups_of(batches, 2):
            if kind == 1:
                for s in slices:
                    yield pa.RecordBatch.from_arrays([s.column(k) for k in range(1, 7)], ["kind", "a", "b", "n", "mark", "blob"])
                continue
            nodes, owners = [], []
            for s in slices:
                for blob in s.column(6).to_pylist():
                    k = int.from_bytes(blob[:4], "little")
                    own = np.frombuffer(blob, np.int64, k, 4)
                    m = (len(blob) - 4 - 8 * k) // 6
                    owners.append(own[np.frombuffer(blob, "<u2", m, 4 + 8 * k)])
                    nodes.append(np.frombuffer(blob, "<u4", m, 4 + 8 * k + 2 * m))
            node, owner = np.concatenate(nodes), np.concatenate(owners)
            order = np.lexsort((owner, node))
            node, owner = node[order], owner[order]
            first = np.r_[True, node[1:] != node[:-1]]
            centre = owner[np.flatnonzero(first)][np.cumsum(first) - 1]
            other = owner != centre
            pairs = np.unique(np.stack([centre[other], owner[other]]), axis=1)
            m = pairs.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(m, np.int32)), pa.array(pairs[0]), pa.array(pairs[1]), *[pa.nulls(m, pa.int64())] * 2, pa.nulls(m, pa.binary())],
                ["kind", "a", "b", "n", "mark", "blob"])

    dealt = sent.select("cell", "kind", "a", "b", "n", "mark", "blob").repartition(parts, "cell").sortWithinPartitions("cell", "kind")
    return map_arrow(dealt, meet, "kind int, a long, b long, n long, mark long, blob binary")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
         percent: int = PERCENT) -> DataFrame:
    """(id, mark, set, n_shingles, component): a row per document; component is
    the smallest id reachable by links, its own included, mark xxhash64(text)."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(F.col(text_col)).alias("text"))
    passed = cut(_first_pass(rows, size, percent))
    slim = passed.filter("kind = 1").select(F.col("a").alias("id"), F.col("b").alias("set"), F.col("n").alias("n"), "mark",
                                             F.col("blob").alias("point"))
    pairs = cut(passed.filter("kind = 0").select(F.col("a").alias("centre"), F.col("b").alias("member")).distinct())
    edges = _verified(rows, slim, pairs, size, percent)
    found = components(edges)
    smallest = (slim.filter("n > 0").join(found, F.col("set") == F.col("node"), "left")
                .groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("id").alias("component")))
    # one row per set, so that equal texts do not meet in one task
    sets = slim.filter("n > 0").select("set").distinct().join(found, F.col("set") == F.col("node"), "left")
    by_set = (sets.select("set", F.coalesce("root", "set").alias("root")).join(smallest, "root")
              .select(F.col("set").alias("of"), "component"))
    return (slim.join(by_set, (F.col("set") == F.col("of")) & (F.col("n") > 0), "left")
            .select("id", "mark", "set", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component"))
                    .otherwise(F.col("id")).alias("component")))


def _leaves(pairs: DataFrame, weights: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (centre, i, j, member, own, and the columns of ``known``) of each
    leaf, the centre's own among them, sorted so that what is compared together
    follows each other. Leaves of more than LEAF_BYTES by ``weights(set,
    weight)`` are cut into blocks, and block i meets every block j. Places are
    worked out on narrow rows; what ``known`` has of a set joins them last."""
    members = pairs.unionAll(pairs.select("centre", F.col("centre").alias("member")).distinct())
    blocks = (members.join(weights.withColumnRenamed("set", "member"), "member").groupBy("centre")
              .agg(F.ceil(F.sum("weight") / LEAF_BYTES).cast("int").alias("blocks")))
    centre = F.col("centre") == F.col("member")
    spread = (members.join(blocks, "centre").withColumn("own", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.when(centre, F.sequence(F.lit(0), F.expr("blocks * blocks - 1")))
                                             .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
              .withColumn("i", F.when(centre, F.floor(F.col("other") / F.col("blocks"))).otherwise(F.least("own", "other")).cast("int"))
              .withColumn("j", F.when(centre, F.col("other") % F.col("blocks")).otherwise(F.greatest("own", "other")).cast("int"))
              .filter("i <= j").select("centre", "i", "j", "member", "own"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = spread.join(known.withColumnRenamed("set", "member"), "member")
    return (full.select("centre", "i", "j", "member", "own", *[c for c in known.columns if c != "set"])
            .repartition(parts, "centre", "i", "j").sortWithinPartitions("centre", "i", "j", "member"))


def _sides(members: list[int], own: list[int], centre: int, i: int, j: int) -> list[int]:
    return [2 if m == centre else int(i != j and o == j) for m, o in zip(members, own)]


def _verified(rows: DataFrame, slim: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): edges of a forest of the links among each leaf's members."""
    points = slim.filter("n > 0").groupBy("set").agg(F.max("n").alias("n"), F.any_value("point").alias("point"))

    def prune(batches):
        for (centre, i, j), slices in groups_of(batches, 3):
            members, own, n, blobs = ([x for s in slices for x in s.column(k).to_pylist()] for k in range(3, 7))
            if len(members) < 2:
                continue
            found = leaf_members(points_of(blobs), np.array(n, np.int64), _sides(members, own, centre, i, j),
                                 members.index(centre), percent)
            kept = [m for m, f in zip(members, found) if f and m != centre]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([centre] * len(kept), pa.int64()), pa.array(kept, pa.int64())],
                                                 ["centre", "member"])

    # a point as the task holds it: four bytes a count, in two copies besides
    weights = points.select("set", (12 * F.octet_length("point")).alias("weight"))
    near = map_arrow(_leaves(pairs, weights, points), prune, "centre long, member long")
    near = cut(near.distinct())
    wanted = near.select(F.explode(F.array("centre", "member")).alias("set")).distinct()
    wanted = cut(wanted.join(slim.groupBy("set").agg(F.min(F.struct("id", "mark")).alias("one")), "set")
                 .select(F.col("set").alias("want"), F.col("one.id").alias("key"), F.col("one.mark").alias("key_mark")))
    small = wanted.count() <= BROADCAST_ROWS
    texts = (rows.withColumn("mark", F.xxhash64("text"))
             .join(F.broadcast(wanted) if small else wanted,
                   F.col("id").eqNullSafe(F.col("key")) & (F.col("mark") == F.col("key_mark"))).select("want", "text"))

    def shingles(batches):
        shingler = Shingler(size)
        for batch in batches:
            for part in batches_of(batch, 512):
                out = [shingler.set_of(text) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in out], pa.int64()),
                                                  pa.array([x.tobytes() for x in out], pa.binary())], ["set", "n", "shingles"])

    # rows equal in id and text come several times; they are told apart below
    sets = map_arrow(texts, shingles, "set long, n long, shingles binary")

    def compare(batches):
        for (centre, i, j), slices in groups_of(batches, 3):
            members, own, sets = [], [], []
            for s in slices:
                for m, o, data in zip(*[s.column(k).to_pylist() for k in (3, 4, 6)]):
                    if not members or m != members[-1]:
                        members.append(m)
                        own.append(o)
                        sets.append(np.frombuffer(data, _U))
            if len(members) < 2:
                continue
            edges = leaf_edges(members, sets, _sides(members, own, centre, i, j), members.index(centre), percent)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    weights = points.select("set", (8 * F.col("n")).alias("weight"))
    return map_arrow(_leaves(near, weights, sets), compare, "a long, b long")


def op1_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
