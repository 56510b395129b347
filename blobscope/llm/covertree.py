"""All pairs of vectors above a cosine, by dual traversal of a cover tree.

On the unit sphere a cosine of at least c is a distance of at most t = sqrt(2 - 2c). A tree covers all
vectors: each node has a centre, which is one of its vectors and of its first child too, and a covering radius
that is measured, not assumed; its children are a net of half its radius, as far as their number allows.

The upper levels are built level by level over DataFrames. A node that holds few vectors, or only such as all
link with each other, is a leaf there; its vectors are stored in blocks of bounded size, and each block is
stored with its part of the tree, built once. Then the tree meets itself from the root down: pairs of nodes
whose centres are further apart than t and both radii are dropped before any vector moves, pairs that lie
within t altogether are linked as wholes, and only blocks under the pairs of leaves that remain are compared,
again node by node. Where few pairs remain, their blocks are shuffled to meet; else they meet in rounds, each of
which broadcasts some blocks and streams the others past them: disk grows with the vectors, not with the pairs.
Products are taken in single precision, with a bound on their error; what the bound leaves open is decided in
double precision.

Copies of a vector are one node with a count, so a hot vector is never compared with itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import append, discard, materialize, release
from .workers import bounded, task

#: Vectors of a block, about; children of a node of the upper levels at most, and vectors of a node, about, that
#: its children are chosen among (all of them are then placed, and radii are measured over all).
BLOCK, CHILDREN, SAMPLE = 8192, 16, 1024
#: Vectors that pairs of blocks may move by shuffles, as a multiple of all; bytes of the blocks of a round beyond that.
SHUFFLED, ROUND_BYTES = 1.5, 32 << 20
#: Vectors of a leaf inside a block.
LEAF = 16
#: A level has gained nothing if a child keeps so much of its parent's vectors and of its radius.
KEEPS_ROWS, KEEPS_RADIUS = 0.9, 0.75
#: Slack for rounding in distances; only what it decides is compared exactly.
SLACK = 1e-6
#: Pairs looked at together, and pairs of children from which on a product of matrices is taken.
CHUNK, DENSE = 1 << 17, 4096


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = x.astype(np.float64)
    scaled = x / np.abs(x).max(axis=1, initial=0)[:, None]
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def _net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """A net of the rows of x: the centre that each row goes to, by number, and the rows that are centres."""
    reach = 1 - radius * radius / 2  # cosine at this distance
    owner, centres = np.zeros(len(x), np.int64), np.zeros(0, np.int64)
    for at in range(0, len(x), 512):
        rows = np.arange(at, min(at + 512, len(x)))
        if len(centres):
            near = x[rows] @ x[centres].T
            best = near.argmax(axis=1)
            owner[rows] = best
            rows = rows[near[np.arange(len(rows)), best] < reach]
        near, open_, new = x[rows] @ x[rows].T, np.ones(len(rows), bool), []
        for i in range(len(rows)):
            if open_[i]:
                own = open_ & (near[i] >= reach)
                own[i] = True
                owner[rows[own]] = len(centres) + len(new)
                new.append(i)
                open_ &= ~own
        centres = np.concatenate([centres, rows[new]])
    return owner, centres


class Tree:
    """A block's vectors in the order of the tree, and its nodes: the range of rows, the row that is the centre,
    the covering radius, and the range of nodes that are children (none: a leaf). The root is node 0."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray, spans: np.ndarray, radius: np.ndarray):
        self.nodes, self.copies = nodes, copies
        self.exact = units(vectors)
        self.single = self.exact.astype(np.float32)
        self.start, self.stop, self.centre, self.low, self.high = spans
        self.radius = radius
        self.summed = np.concatenate([[0], np.cumsum(copies)])

    def held(self, i: np.ndarray) -> np.ndarray:
        """Rows under nodes, copies counted."""
        return self.summed[self.stop[i]] - self.summed[self.start[i]]


def grow(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows, the nodes' (start, stop, centre, low, high) and radii of a tree over vectors, where a
    node of more than `leaf` rows has children."""
    u = units(vectors)
    x, order = u.astype(np.float32), np.arange(len(u))
    spans, radius, limit = [[0, len(u), 0, 0, 0]], [float(np.sqrt(((u - u[0]) ** 2).sum(axis=1)).max()) + SLACK / 8], [2.0]
    at = 0
    while at < len(spans):
        s, e = spans[at][:2]
        if e - s > leaf and radius[at] > SLACK:
            rows, half = order[s:e].copy(), min(limit[at], radius[at]) / 2
            owner, centres = _net(x[rows], half)
            apart = np.sqrt(((u[rows] - u[rows[centres]][owner]) ** 2).sum(axis=1))
            reach = np.zeros(len(centres))
            np.maximum.at(reach, owner, apart)
            rank = np.argsort(-reach, kind="stable")  # the widest first
            place = np.argsort(rank)
            order[s:e] = rows[np.argsort(place[owner], kind="stable")]
            ends = s + np.cumsum(np.bincount(place[owner], minlength=len(centres)))
            spans[at][3:] = [len(spans), len(spans) + len(centres)]
            spans += [[a, b, c, 0, 0] for a, b, c in zip([s, *ends[:-1].tolist()], ends.tolist(), rows[centres[rank]].tolist(), strict=True)]
            radius += (reach[rank] + np.where(np.diff([s, *ends]) > 1, SLACK / 8, 0)).tolist()
            limit += [half] * len(centres)
        at += 1
    table = np.array(spans, np.int32).T.copy()
    table[2] = np.argsort(order)[table[2]]
    return order, table, np.array(radius)


def _expand(first: np.ndarray, n: np.ndarray, second: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of the ranges (first, n) and (second, m), in chunks: number of the range, and the pair."""
    size = n * m
    cuts = np.cumsum(size) // CHUNK
    for k in range(int(cuts[-1]) + 1 if len(cuts) else 0):
        own = np.flatnonzero(cuts == k)
        which = np.repeat(own, size[own])
        at = np.arange(len(which)) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
        yield which, first[which] + at // m[which], second[which] + at % m[which]


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n points the smallest point that links (i, j) reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


class Meeting:
    """Dual traversal of two trees, or of one with itself."""

    def __init__(self, a: Tree, b: Tree, cosine: float):
        self.a, self.b, self.same, self.cosine = a, b, a is b, cosine
        self.t = np.sqrt(2 - 2 * cosine)
        self.error = (a.single.shape[1] + 8) * 2.0**-22  # of a product in single precision
        self.links = [np.zeros(len(a.nodes) + 1, np.int64), np.zeros(len(b.nodes) + 1, np.int64)]  # of rows
        self.whole = [np.zeros(len(a.nodes) + 1, np.int64), np.zeros(len(b.nodes) + 1, np.int64)]  # changes from row to row
        if self.same:
            self.links[1], self.whole[1] = self.links[0], self.whole[0]
        self.itself = np.zeros(len(a.nodes) + 1, np.int64)
        self.shift = 0 if self.same else len(a.nodes)
        self.points = self.shift + len(b.nodes)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_edges = 0
        self.open: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while self.open:
            self._visit(*self.open.pop())

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Rows i and j (points of both trees) are in one component."""
        self.edges.append((i, j))
        self.n_edges += len(i)
        if self.n_edges > 1 << 21:
            label = stars(self.points, *(np.concatenate(x) for x in zip(*self.edges, strict=True)))
            i = np.flatnonzero(label != np.arange(self.points))
            self.edges, self.n_edges = [(i, label[i])], 0

    def _visit(self, p: np.ndarray, q: np.ndarray) -> None:
        a, b = self.a, self.b
        n, m = a.high[p] - a.low[p], b.high[q] - b.low[q]
        leaves = (n == 0) & (m == 0)
        if leaves.any():
            self._rows(p[leaves], q[leaves])
        p, q, n, m = (x[~leaves] for x in (p, q, n, m))
        first, second = np.where(n > 0, a.low[p], p), np.where(m > 0, b.low[q], q)
        n, m = np.maximum(n, 1).astype(np.int64), np.maximum(m, 1).astype(np.int64)
        dense = n * m >= DENSE
        for k in np.flatnonzero(dense):
            self._product(np.arange(first[k], first[k] + n[k]), np.arange(second[k], second[k] + m[k]), self.same and p[k] == q[k])
        p, q, first, n, second, m = (x[~dense] for x in (p, q, first, n, second, m))
        for which, i, j in _expand(first, n, second, m):
            if self.same:
                ordered = (p[which] != q[which]) | (i <= j)
                i, j = i[ordered], j[ordered]
            self._judge(i, j, np.einsum("ij,ij->i", a.single[a.centre[i]], b.single[b.centre[j]]))

    def _product(self, left: np.ndarray, right: np.ndarray, square: bool) -> None:
        a, b = self.a, self.b
        for s in range(0, len(left), 512):
            i = left[s : s + 512]
            for e in range(0, len(right), 2048):
                j = right[e : e + 2048]
                if square and j[-1] < i[0]:
                    continue
                dot = a.single[a.centre[i]] @ b.single[b.centre[j]].T
                reach = self.t + a.radius[i].max() + b.radius[j].max() + SLACK
                y, z = np.nonzero(dot >= (1 - min(reach, 2.0) ** 2 / 2 - self.error))
                if square:
                    ordered = i[y] <= j[z]
                    y, z = y[ordered], z[ordered]
                self._judge(i[y], j[z], dot[y, z])

    def _judge(self, i: np.ndarray, j: np.ndarray, dot: np.ndarray) -> None:
        """Drop pairs of nodes that are too far apart, link those that are close as wholes, open the others."""
        a, b, both = self.a, self.b, self.a.radius[i] + self.b.radius[j]
        near = dot + self.error >= 1 - np.minimum(self.t + both + SLACK, 2.0) ** 2 / 2
        room = self.t - both - SLACK
        inside = near & (room >= 0) & (dot - self.error >= 1 - np.maximum(room, 0) ** 2 / 2)
        if self.same:
            alone = (i == j) & (a.stop[i] - a.start[i] == 1)
            near &= ~alone
            inside &= ~alone
        open_ = near & ~inside
        if open_.any():
            self.open.append((i[open_], j[open_]))
        i, j = i[inside], j[inside]
        if not len(i):
            return
        if self.same:
            own = i[i == j]
            np.add.at(self.whole[0], a.start[own], a.held(own))
            np.add.at(self.whole[0], a.stop[own], -a.held(own))
            np.add.at(self.itself, a.start[own], 1)
            np.add.at(self.itself, a.stop[own], -1)
            apart = i != j
        else:
            apart = np.ones(len(i), bool)
        for tree, x, more, change in ((a, i[apart], b.held(j[apart]), self.whole[0]), (b, j[apart], a.held(i[apart]), self.whole[1])):
            np.add.at(change, tree.start[x], more)
            np.add.at(change, tree.stop[x], -more)
        for tree, x, shift in ((a, np.unique(i), 0), (b, np.unique(j), self.shift)):
            x = x[tree.stop[x] - tree.start[x] > 1]
            size = (tree.stop[x] - tree.start[x]).astype(np.int64)
            for which, _, row in _expand(np.zeros(len(x), np.int64), np.ones(len(x), np.int64), tree.start[x].astype(np.int64), size):
                self._join(tree.start[x[which]] + shift, row + shift)
        self._join(a.start[i].astype(np.int64), b.start[j].astype(np.int64) + self.shift)

    def _rows(self, p: np.ndarray, q: np.ndarray) -> None:
        """Compare all rows of leaves."""
        a, b = self.a, self.b
        for which, i, j in _expand(a.start[p].astype(np.int64), (a.stop[p] - a.start[p]).astype(np.int64), b.start[q].astype(np.int64), (b.stop[q] - b.start[q]).astype(np.int64)):
            if self.same:
                ordered = (p[which] != q[which]) | (i < j)
                i, j = i[ordered], j[ordered]
            dot = np.einsum("ij,ij->i", a.single[i], b.single[j]).astype(np.float64)
            unsure = np.abs(dot - self.cosine) <= self.error
            dot[unsure] = np.einsum("ij,ij->i", a.exact[i[unsure]], b.exact[j[unsure]])
            hit = dot >= self.cosine
            i, j = i[hit], j[hit]
            np.add.at(self.links[0], i, b.copies[j])
            np.add.at(self.links[1], j, a.copies[i])
            self._join(i, j + self.shift)

    def result(self) -> dict[str, np.ndarray]:
        """node, links (of rows that have some) and hub (a node of the same component)."""
        trees = [self.a] if self.same else [self.a, self.b]
        nodes = np.concatenate([x.nodes for x in trees])
        links = np.concatenate([(self.links[k] + np.cumsum(self.whole[k]))[:-1] for k in range(len(trees))])
        if self.same:
            links -= self.a.copies * np.cumsum(self.itself)[:-1]
        i, j = (np.concatenate(x) for x in zip(*self.edges, strict=True)) if self.edges else (np.zeros(0, np.int64),) * 2
        label = stars(self.points, i, j)
        some = np.flatnonzero((links > 0) | (label != np.arange(len(label))))
        return {"node": nodes[some], "links": links[some], "hub": nodes[label[some]]}


def _stack(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """The vectors of a binary column, of one length."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _choose(kind: str, block: int, children: int):
    """A sample of a node (its centre, where it has one, comes first) -> the centres of its children."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("first", "descending"), ("node", "ascending")])
        points = _stack(t.column("point"), kind)
        u, want = units(points), int(min(children, -(-t.column("n")[0].as_py() // block) + 1))
        half = max(t.column("radius")[0].as_py() / 2, SLACK)
        # farthest points first: every prefix is a net of its own radius
        chosen, far = [0], 2 - 2 * (u @ u[0])
        while len(chosen) < want and far.max() > min(half * half, 1.0) / 4:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, 2 - 2 * (u @ u[chosen[-1]]))
        return pa.table({"path": [t.column("path")[0].as_py()], "centres": pa.array([[points[c].tobytes() for c in chosen]], pa.list_(pa.binary()))})

    return run


def _place(kind: str):
    """Rows of a node with the centres of its children -> the child that each row falls to."""

    def run(rows: pa.Table, centres: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"path": pa.array([], pa.string()), "node": pa.array([], pa.int64()), "copies": pa.array([], pa.int64()), "dist": pa.array([], pa.float64()), "point": pa.array([], pa.binary())})
        points = centres.column("centres")[0].as_py()
        u, c = units(_stack(rows.column("point"), kind)), units(np.frombuffer(b"".join(points), kind).reshape(len(points), -1))
        child = (u @ c.T).argmax(axis=1)
        apart = np.sqrt(((u - c[child]) ** 2).sum(axis=1))
        path = rows.column("path")[0].as_py()
        return pa.table({"path": pa.array([f"{path}/{k}" for k in child], pa.string()), "node": rows.column("node"), "copies": rows.column("copies"), "dist": pa.array(apart + SLACK / 8), "point": rows.column("point")})

    return run


def _prune(kind: str, threshold: float):
    """Pairs of nodes -> those that may hold links; `inside`: all their vectors are linked."""
    t = np.sqrt(2 - 2 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n) for n in b.schema.names}
            same = np.array([x == y for x, y in zip(c["a"].to_pylist(), c["b"].to_pylist(), strict=True)], bool)
            apart = np.zeros(b.num_rows)
            by_width: dict[int, list[int]] = {}
            left, right = c["centre_a"].to_pylist(), c["centre_b"].to_pylist()
            for i in np.flatnonzero(~same):
                by_width.setdefault(len(left[i]), []).append(i)
            for at in by_width.values():
                x, y = (units(np.frombuffer(b"".join([side[i] for i in at]), kind).reshape(len(at), -1)) for side in (left, right))
                apart[at] = np.sqrt(((x - y) ** 2).sum(axis=1))
            both = c["radius_a"].to_numpy(zero_copy_only=False) + c["radius_b"].to_numpy(zero_copy_only=False)
            leaves = np.asarray(c["leaf_a"].to_pylist(), bool) & np.asarray(c["leaf_b"].to_pylist(), bool)
            keep = pa.array(apart <= t + both + SLACK)
            out = [c["a"], c["b"], pa.array(leaves & (apart + both <= t - SLACK)), pa.array(leaves)]
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in out], ["a", "b", "inside", "leaves"])

    return run


def _pack(kind: str, leaf: int):
    """The rows of a block with the tree over them."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        points = _stack(t.column("point"), kind)
        order, spans, radius = grow(points, leaf)
        nodes, copies = t.column("node").to_numpy()[order], t.column("copies").to_numpy()[order]
        stored = {k: v.tobytes() for k, v in (("nodes", nodes), ("copies", copies), ("points", points[order]), ("spans", spans), ("radius", radius))}
        return pa.table({"path": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int32()), "rows": pa.array([len(order)], pa.int32()), "bytes": [sum(map(len, stored.values()))], **{k: [v] for k, v in stored.items()}})

    return run


def _unpack(row: dict, kind: str) -> Tree:
    n = row["rows"]
    return Tree(np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["copies"], np.int64), np.frombuffer(row["points"], kind).reshape(n, -1), np.frombuffer(row["spans"], np.int32).reshape(5, -1), np.frombuffer(row["radius"], np.float64))


def _upper_levels(rows: DataFrame, kind: str, threshold: float) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of rows with the path of their leaf, and the nodes of each level: parent, path, centre, radius, n, copies,
    hub (a vector of it), leaf. Each level is a table; the driver only learns whether it has leaves and others. Rows
    stay in one table each: those of leaves go to a table of theirs where a level has both."""
    t = float(np.sqrt(2 - 2 * threshold))
    centres = rows.select("path").distinct().select(F.lit(None).cast("string").alias("parent"), "path", F.lit(None).cast("binary").alias("centre"), F.lit(None).cast("long").alias("parent_n"), F.lit(None).cast("double").alias("parent_radius"))
    levels, done, spark = [], [], rows.sparkSession
    while True:
        sums = rows.groupBy("path").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.sum("copies").alias("copies"), F.min("node").alias("hub"))
        stuck = F.coalesce((F.col("n") > KEEPS_ROWS * F.col("parent_n")) & (F.col("radius") > KEEPS_RADIUS * F.col("parent_radius")), F.lit(False))
        level = materialize(sums.join(centres, "path").select("parent", "path", "centre", "radius", "n", "copies", "hub", ((F.col("n") * 2 <= 3 * BLOCK) | (2 * F.col("radius") <= t - SLACK) | stuck).alias("leaf")), "tree-level")
        levels.append(level)
        opened = level.where(~F.col("leaf"))
        if opened.isEmpty():
            return [*done, rows], levels
        if not level.where("leaf").isEmpty():
            done.append(materialize(rows.join(level.where("leaf").select("path"), "path", "left_semi"), "leaf-rows"))
        inner = rows.join(opened.select("path", "n", "radius"), "path")
        draw = F.pmod(F.xxhash64(F.lit(len(levels)), "node"), F.lit(1 << 32)) / float(1 << 32)
        heads = opened.where(F.col("centre").isNotNull()).select("path", "n", "radius", F.lit(-1).cast("long").alias("node"), F.col("centre").alias("point"), F.lit(True).alias("first"))
        sample = inner.where(draw < float(SAMPLE) / F.col("n")).select("path", "n", "radius", "node", "point", F.lit(False).alias("first"))
        chosen = materialize(sample.unionByName(heads).groupBy("path").applyInArrow(_choose(kind, BLOCK, CHILDREN), "path string, centres array<binary>"), "tree-centres")
        parts = F.ceil(F.col("n") / BLOCK).cast("int")
        left_side = inner.select("path", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node", "copies", "point")
        right_side = chosen.join(opened.select("path", "n"), "path").select("path", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "centres")
        placed = left_side.groupBy("path", "part").cogroup(right_side.groupBy("path", "part")).applyInArrow(_place(kind), "path string, node long, copies long, dist double, point binary")
        last, rows = rows, materialize(placed, "placed")
        if hasattr(last, "scratch_path"):
            discard(last)
        del inner, sample, left_side, right_side, placed
        release(spark)
        centres = chosen.join(opened.select("path", F.col("n").alias("parent_n"), F.col("radius").alias("parent_radius")), "path").select(F.col("path").alias("parent"), "parent_n", "parent_radius", F.posexplode("centres").alias("k", "centre"))
        centres = centres.select("parent", F.concat_ws("/", "parent", F.col("k").cast("string")).alias("path"), "centre", "parent_n", "parent_radius")


def _meet(levels: list[DataFrame], kind: str, threshold: float) -> DataFrame:
    """Pairs (a, b) of leaves that may hold links, and whether all their vectors are linked (inside)."""
    pairs = levels[0].select(F.col("path").alias("a"), F.col("path").alias("b"), (F.col("leaf") & (2 * F.col("radius") <= float(np.sqrt(2 - 2 * threshold)) - SLACK)).alias("inside"), F.col("leaf").alias("leaves"))
    settled, leaves = [], levels[0].where("leaf")
    for level in levels[1:]:
        settled.append(pairs.where("leaves"))
        # a leaf that meets an inner node stays as it is
        kept = level.unionByName(leaves.withColumn("parent", F.col("path")))
        side = lambda x: kept.select(F.col("parent").alias(f"parent_{x}"), F.col("path").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("centre", "radius", "leaf")))
        met = pairs.where("not leaves").select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b")).join(side("a"), "parent_a").join(side("b"), "parent_b")
        met = met.where((F.col("parent_a") != F.col("parent_b")) | (F.col("a") <= F.col("b"))).select("a", "b", "centre_a", "radius_a", "leaf_a", "centre_b", "radius_b", "leaf_b")
        pairs = materialize(met.mapInArrow(_prune(kind, threshold), "a string, b string, inside boolean, leaves boolean"), "tree-pairs")
        leaves = leaves.unionByName(level.where("leaf"))
    settled.append(pairs)
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.select("a", "b", "inside")


#: Rows of the tables of blocks and of links.
_BLOCK = "path string, part int, rows int, bytes long, nodes binary, copies binary, points binary, spans binary, radius binary"
_LINKS = "node long, links long, hub long"


def _meet_blocks(stored: DataFrame, met: DataFrame, kind: str, threshold: float) -> DataFrame:
    """The links between the blocks (path, part) of `stored` that the pairs (a, part_a, b, part_b) of `met` name."""
    spark, columns = stored.sparkSession, stored.columns
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("hub", pa.int64())])
    # which of two is broadcast is drawn, so that no block streams past all the others
    swap = F.xxhash64("a", "part_a", "b", "part_b") % 2 == 0
    met = materialize(met.select(*(F.when(swap, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("part_a", "part_b"), ("b", "a"), ("part_b", "part_a")))), "block-pairs")
    sizes = stored.select("path", "part", "rows", "bytes")
    total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    one = F.struct(F.col("a").alias("path"), F.col("part_a").alias("part"))
    two = F.struct(F.col("b").alias("path"), F.col("part_b").alias("part"))
    ends = met.select(F.concat_ws(" ", "a", "part_a", "b", "part_b").alias("pair"), F.explode(F.array_distinct(F.array(one, two))).alias("e")).select("pair", "e.*")
    moved = ends.join(sizes, ["path", "part"]).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if moved <= SHUFFLED * total["rows"]:

        def compare(t: pa.Table) -> pa.Table:
            trees = [_unpack(r, kind) for r in t.drop_columns(["pair"]).to_pylist()]
            return pa.table(Meeting(trees[0], trees[-1], threshold).result(), schema=schema)

        found = materialize(ends.join(stored, ["path", "part"]).groupBy("pair").applyInArrow(compare, _LINKS), "vector-links")
        discard(met)
        return found

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, None  # the block that streams past, which meets several
        for batch in batches:
            for r in batch.to_pylist():
                if key != (r["path"], r["part"]):
                    key, kept = (r["path"], r["part"]), _unpack(r, kind)
                other = kept if key == (r["with_path"], r["with_part"]) else _unpack({c: r[f"with_{c}"] for c in columns}, kind)
                links = Meeting(other, kept, threshold).result()
                yield pa.RecordBatch.from_arrays([pa.array(links[c]) for c in schema.names], schema=schema)

    rounds = -(-total["bytes"] // ROUND_BYTES)
    turn = lambda path, part: F.pmod(F.xxhash64(path, part), F.lit(rounds))
    found = None
    for k in range(rounds):
        held = stored.where(turn("path", "part") == k).select(*(F.col(c).alias(f"with_{c}") for c in columns))
        pairs = met.where(turn("a", "part_a") == k).select(F.col("a").alias("with_path"), F.col("part_a").alias("with_part"), F.col("b").alias("path"), F.col("part_b").alias("part"))
        work = stored.join(F.broadcast(pairs), ["path", "part"]).join(F.broadcast(held), ["with_path", "with_part"])
        found = append(work.mapInArrow(task(stream), _LINKS), found, "vector-links")
        del held, pairs, work
        release(spark)
    discard(met)
    return found


def near_vectors(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`id`, n_links (other rows linked directly), component_id (smallest id that links reach), kept.

    Rows link at a cosine of at least `threshold`, in double precision. Null, empty and zero vectors and
    those with null or non-finite components link with nothing; vectors of different lengths don't link.
    Repeated rows and copies are rows of their own and link with each other. An empty table gives none. All
    pairs above the threshold are found: samples decide how vectors are grouped and nothing else."""
    kind = "<f4" if df.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    element = "float" if kind == "<f4" else "double"
    rows = bounded(df).select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    classes = rows.where(usable).groupBy("v").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    release(df.sparkSession)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, n = b.column(0), b.num_rows
            ends, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False).astype(kind)
            points = [flat[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([str(len(x)) for x in points], pa.string()), b.column(1), b.column(2), pa.array(np.full(n, 2.0)), pa.array(points, pa.binary())], ["path", "node", "copies", "dist", "point"])

    points = classes.select("v", "node", "copies").mapInArrow(task(start), "path string, node long, copies long, dist double, point binary")
    placed, levels = _upper_levels(points, kind, threshold)
    tree = levels[0]
    for level in levels[1:]:
        tree = tree.unionByName(level)
    leaves = tree.where("leaf").select("path", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), "copies", "hub")
    blocked = reduce(DataFrame.unionByName, placed).join(leaves.select("path", "parts"), "path").select("path", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "copies", "point")
    stored = materialize(blocked.groupBy("path", "part").applyInArrow(_pack(kind, LEAF), _BLOCK), "blocks")
    discard(*(x for x in placed if hasattr(x, "scratch_path")))
    del blocked
    release(df.sparkSession)
    pairs = materialize(_meet(levels, kind, threshold), "leaf-pairs")

    # pairs of leaves that are linked as wholes: sums for their rows, without a comparison
    whole = pairs.where("inside").join(leaves.select(F.col("path").alias("a"), F.col("copies").alias("copies_a"), F.col("hub").alias("hub_a")), "a").join(leaves.select(F.col("path").alias("b"), F.col("copies").alias("copies_b"), F.col("hub").alias("hub_b")), "b")
    itself = F.col("a") == F.col("b")
    more = whole.select(F.col("a").alias("path"), F.col("hub_a").alias("hub"), F.col("copies_b").alias("more"), itself.cast("int").alias("itself")).unionByName(whole.where(~itself).select(F.col("b").alias("path"), F.col("hub_b").alias("hub"), F.col("copies_a").alias("more"), F.lit(0).alias("itself")))
    more = more.groupBy("path", "hub").agg(F.sum("more").alias("more"), F.max("itself").alias("itself"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                nodes, copies = np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["copies"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(r["more"] - r["itself"] * copies), pa.array(np.full(len(nodes), r["hub"]))], ["node", "links", "hub"])

    as_wholes = stored.select("path", "nodes", "copies").join(more, "path").select("nodes", "copies", "more", "itself", "hub").mapInArrow(task(add), _LINKS)
    hubs = whole.where(~itself).select(F.col("hub_a").alias("node"), F.lit(0).cast("long").alias("links"), F.col("hub_b").alias("hub"))

    # the others: every block of one leaf with every block of the other
    part = lambda x: F.explode(F.sequence(F.lit(0), F.col(f"parts_{x}") - 1)).alias(f"part_{x}")
    met = pairs.where("not inside").join(leaves.select(F.col("path").alias("a"), F.col("parts").alias("parts_a")), "a").join(leaves.select(F.col("path").alias("b"), F.col("parts").alias("parts_b")), "b")
    met = met.select("a", "b", part("a"), "parts_b").select("a", "b", "part_a", part("b")).where((F.col("a") != F.col("b")) | (F.col("part_a") <= F.col("part_b")))
    found = append(as_wholes.unionByName(hubs), _meet_blocks(stored, met, kind, threshold), "vector-links")
    discard(stored)
    release(df.sparkSession)
    roots = materialize(components(found.select(F.col("node").alias("a"), F.col("hub").alias("b"))), "roots")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labelled = classes.join(counts, "node", "left").join(roots, "node", "left").select("v", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labelled = labelled.join(lowest, "root").select("v", "n_links", "component_id", F.lit(True).alias("is_class"))
    out = rows.withColumn("k", F.when(usable, F.col("v"))).join(labelled.withColumnRenamed("v", "k"), "k", "left")
    component = F.when(F.col("is_class"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
