"""Embedding near-duplicates by cover trees and dual traversal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm._graph import components
from tidelens.llm._shared import materialise, need
from tidelens.llm._vectors import matrix, pack_doubles, valid

#: Vectors sampled for the cells' centres, vectors a cell should hold, vectors of a block, of a leaf, centres tried a node, points of a child
#: at least, rounding allowance of a distance.
SAMPLE, CELL, BLOCK, LEAF, CHILDREN, FEWEST, SLACK = 4096, 4096, 2048, 64, 64, 4, 1e-7
#: Cells with their radii that are sent to every task; with more, each vector is joined to those of its label.
BROADCAST_NODES = 1 << 17


class CoverTree:
    """Nested levels over unit vectors. A node's children cover its points within half its level's radius; each
    node knows its covering radius, the largest distance from its centre to a point below it.

    At most CHILDREN centres are tried a node. Points around centres that cover fewer than FEWEST, and those left
    over, are a last child, a leaf about the node's own centre (``rests``): where points have no structure at a radius, a
    matrix product compares them faster than nodes of one point would.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.centre, self.radius, self.members, self.children, self.rests = [], [], [], [], set()
        self.root = self._node(np.arange(len(points)), 0)
        todo = [(self.root, 2.0)]
        while todo:
            node, radius = todo.pop()
            index, at = self.members[node], self.centre[node]
            if len(index) <= self.leaf or self.radius[node] <= SLACK:
                continue
            radius = min(radius, self.radius[node]) / 2
            rest, alone = index, []
            for _ in range(CHILDREN):
                if not len(rest):
                    break
                near = _distance(self.points[rest], self.points[at]) <= radius
                near[rest == at] = True
                if near.sum() >= FEWEST:
                    self.children[node].append(self._node(rest[near], at))
                    todo.append((self.children[node][-1], radius))
                else:
                    alone.append(rest[near])
                rest = rest[~near]
                at = rest[0] if len(rest) else at
            rest = np.concatenate([*alone, rest])
            if self.children[node] and len(rest):
                self.children[node].append(self._node(rest, self.centre[node]))
                self.rests.add(self.children[node][-1])

    def _node(self, index: np.ndarray, centre: int) -> int:
        self.centre.append(centre)
        self.radius.append(float(_distance(self.points[index], self.points[centre]).max()))
        self.members.append(index)
        self.children.append([])
        return len(self.centre) - 1


def _distance(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Between unit vectors, right to within SLACK."""
    return np.sqrt(np.maximum(2 - 2 * (points @ centre), 0.0))


def dual(a: CoverTree, b: CoverTree, within: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of index sets that may hold pairs within the distance, and whether all their pairs do.

    A pair of nodes whose centres are farther apart than the distance and both radii is pruned; one whose
    centres are so near that no pair can be farther is taken as a whole. With ``a is b`` each unordered pair of
    sets comes once.
    """
    frontier = [(a.root, b.root)]
    while frontier:
        i, j = frontier.pop()
        d = float(_distance(a.points[a.centre[i]], b.points[b.centre[j]]))
        ra, rb = a.radius[i], b.radius[j]
        if d > ra + rb + within + SLACK:
            continue
        if d + ra + rb <= within - SLACK:
            yield a.members[i], b.members[j], True
        elif not a.children[i] and not b.children[j]:
            yield a.members[i], b.members[j], False
        elif a is b and i == j:
            kids = a.children[i]
            frontier += [(x, y) for n, x in enumerate(kids) for y in kids[n:]]
        elif a.children[i] and (not b.children[j] or ra >= rb):
            kids = np.array(a.children[i])
            away = _distance(a.points[np.array(a.centre)[kids]], b.points[b.centre[j]])
            frontier += [(x, j) for x in kids[away <= np.array(a.radius)[kids] + rb + within + SLACK].tolist()]
        else:
            kids = np.array(b.children[j])
            away = _distance(b.points[np.array(b.centre)[kids]], a.points[a.centre[i]])
            frontier += [(i, y) for y in kids[away <= np.array(b.radius)[kids] + ra + within + SLACK].tolist()]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of all rows of x with all rows of y, in double precision."""
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    return (x @ y.T) / np.sqrt((x * x).sum(axis=1))[:, None] / np.sqrt((y * y).sum(axis=1))[None, :]


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _compare(cos: float) -> Callable:
    """Links between the vectors of a block and those sent to it: for each vector the number of vectors found in the
    other part, and links that connect what is linked, of which there are fewer than vectors."""
    within = float(np.sqrt(2 - 2 * cos))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        home = pdf["home"].to_numpy(bool)
        x = np.frombuffer(b"".join(pdf["embedding"]), np.float64).reshape(len(pdf), -1)
        ids, times = pdf["vec_id"].to_numpy(np.int64), pdf["times"].to_numpy(np.int64)
        unit, links, forest, edges = _unit(x), np.zeros(len(pdf), np.int64), _Forest(len(pdf)), []
        ours, others = np.flatnonzero(home), np.flatnonzero(~home)
        own = CoverTree(unit[ours]) if len(ours) else None

        def take(i: np.ndarray, j: np.ndarray, whole: bool, same: bool) -> None:
            hit = np.ones((len(i), len(j)), bool) if whole else cosines(x[i], x[j]) >= cos
            twice = same and np.array_equal(i, j)
            if twice:
                hit = hit & ~np.eye(len(i), dtype=bool)
            links[i] += hit @ times[j]
            if not twice:
                links[j] += times[i] @ hit
            # A spanning forest of the hits: rows by their first column, columns by their first row.
            for r in np.flatnonzero(hit.any(axis=1)):
                c = int(np.argmax(hit[r]))
                if forest.join(int(i[r]), int(j[c])):
                    edges.append((i[r], j[c]))
                if hit[r].sum() > 1:
                    roots = np.flatnonzero(hit[r] & (forest.up[j] != forest.root(int(i[r]))))
                    for c in roots:
                        if forest.join(int(i[r]), int(j[c])):
                            edges.append((i[r], j[c]))

        if own is not None:
            if pdf["within"].any():
                for i, j, whole in dual(own, own, within):
                    take(ours[i], ours[j], whole, True)
            if len(others):
                for i, j, whole in dual(own, CoverTree(unit[others]), within):
                    take(ours[i], others[j], whole, False)
        found = np.flatnonzero(links)
        u, v = ids[[e[0] for e in edges]], ids[[e[1] for e in edges]]
        return pd.DataFrame({"vec_id": np.r_[ids[found], u], "other": np.r_[np.full(len(found), -1), v], "n": np.r_[links[found], np.zeros(len(u), np.int64)], "edge": np.r_[np.zeros(len(found), bool), np.ones(len(u), bool)]})

    return run


def _assigned(centres: np.ndarray) -> Callable:
    """Each vector's nearest cell and its distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("embedding"))
            cell, away = np.zeros(len(x), np.int64), np.zeros(len(x))
            if centres.shape[1] == x.shape[1]:
                u = _unit(x)
                for at in range(0, len(u), 1024):
                    d = np.sqrt(np.maximum(2 - 2 * (u[at : at + 1024] @ centres.T), 0.0))
                    cell[at : at + 1024], away[at : at + 1024] = d.argmin(axis=1), d.min(axis=1)
            yield b.append_column("cell", pa.array(cell)).append_column("away", pa.array(away))

    return run


def _sent(centres: np.ndarray, within: float, radii: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] | None) -> Callable:
    """For each vector the other cells, of higher number, that may hold a vector within the distance.

    A cell's points lie within its covering radius of its centre (point against node), and a point whose nearest
    centre is c lies in a cell d only if no nearer to d's centre (hyperplane between centres). ``radii`` has the cells of
    each label and length with their radii; without it each row carries those of its own (column ``radii``).
    """

    def fits(u: np.ndarray, cell: np.ndarray, to: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(u) if u.shape[1] == centres.shape[1] else 0, 1024):  # vectors of other lengths are one cell
            x, c = u[at : at + 1024], cell[at : at + 1024]
            d = np.sqrt(np.maximum(2 - 2 * (x @ centres[to].T), 0.0))
            own = np.sqrt(np.maximum(2 - 2 * (centres[c] * x).sum(axis=1), 0.0))
            i, j = np.nonzero((to[None, :] > c[:, None]) & (d <= most[None, :] + within + SLACK) & (d <= own[:, None] + 2 * within + SLACK))
            rows.append(i + at)
            cells.append(to[j])
        return np.concatenate(rows), np.concatenate(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u, cell = _unit(matrix(b.column("embedding"))), b.column("cell").to_numpy()
            rows, cells = [], []
            if radii is not None:
                labels, dim = np.array(b.column("label").to_pylist(), object), int(b.column("dim")[0].as_py())
                for label in dict.fromkeys(labels):
                    mine = np.flatnonzero(labels == label)
                    i, to = fits(u[mine], cell[mine], *radii[label, dim])
                    rows.append(mine[i])
                    cells.append(to)
            else:
                for k, r in enumerate(b.column("radii")):
                    i, to = fits(u[k : k + 1], cell[k : k + 1], np.asarray(r.values.field(0)), np.asarray(r.values.field(1)))
                    rows.append(i + k)
                    cells.append(to)
            at, to = np.concatenate(rows), np.concatenate(cells)
            if len(at):
                part = b.select(["vec_id", "embedding", "times", "label", "dim"]).take(pa.array(at))
                yield part.append_column("cell", pa.array(to, pa.int64()))

    return run


def _radii(nodes: DataFrame) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] | None:
    """The cells of each label and length with their radii, if there are few enough to send to every task."""
    if nodes.count() > BROADCAST_NODES:
        return None
    t = nodes.select("label", "dim", "cell", "radius").toArrow()
    label, dim, cell, radius = t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2).to_numpy(), t.column(3).to_numpy()
    of: dict[tuple[str, int], list[int]] = {}
    for i, key in enumerate(zip(label, dim, strict=True)):
        of.setdefault(key, []).append(i)
    return {key: (cell[i], radius[i]) for key, i in of.items()}


def near_duplicates(vectors: DataFrame, cos: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Two vectors are linked if their labels are equal and not null, their lengths are equal and their cosine in
    double precision is at least ``cos``. ``n_links`` counts the other rows linked to a row, ``component_id`` is the
    smallest vec_id reachable and ``kept`` says whether it is the row's own. Vectors that take no part (null,
    empty, zero, null or non-finite components, null label) have no links and are their own component; a null
    vec_id links like any other and is never a component's id. Rows that repeat a vec_id with equal vectors
    count as rows. An empty table gives an empty one.

    Equal vectors are one point with a multiplicity. A label's points are dealt to cells around centres (from a
    bounded sample; the top level of the tree), each cell to blocks of bounded size. A point goes to its own
    cell's blocks and to those of other cells that the bounds leave; in every block two cover trees are
    traversed against each other. Blocks return counts and spanning links, never all pairs.
    """
    spark = vectors.sparkSession
    v = valid(vectors, "label").where("label is not null").select("vec_id", F.col("label").cast("string"), F.size("embedding").alias("dim"), "embedding")
    v = v.mapInArrow(pack_doubles, "vec_id bigint, label string, dim int, embedding binary")
    v = materialise(v.withColumn("print", F.concat(F.unhex(F.sha1("embedding")), F.unhex(F.hex(F.xxhash64("embedding"))))), "vectors")
    points = v.groupBy("label", "dim", "print").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times"), F.min("embedding").alias("embedding"))
    points = materialise(points.withColumn("point", F.xxhash64("label", "dim", "print")), "points")
    total, groups = points.agg(F.count("*"), F.count_distinct("label", "dim")).first()
    sample = [np.frombuffer(r[0], np.float64) for r in points.orderBy(F.xxhash64("print", F.lit(1)), "point").limit(SAMPLE).select("embedding").collect()]
    dims = [len(x) for x in sample]
    dim = max(set(dims), key=dims.count) if dims else 1
    sample = [x for x in sample if len(x) == dim]
    cells = min(len(sample), max(1, -(-total // (max(1, groups) * CELL))))
    centres = _unit(np.stack(sample))[_net(_unit(np.stack(sample)), cells)] if sample else np.zeros((1, 1))

    p = points.select(F.col("point").alias("vec_id"), "embedding", "times", "label", "dim")
    p = p.repartition("vec_id").mapInArrow(_by_dim(_assigned(centres)), "vec_id bigint, embedding binary, times bigint, label string, dim int, cell bigint, away double")
    p = materialise(p, "cells")
    nodes = p.groupBy("label", "dim", "cell").agg(F.count("*").alias("size"), F.max("away").alias("radius"))
    nodes = materialise(nodes.withColumn("blocks", F.ceil(F.col("size") / BLOCK)), "nodes")
    within, radii, columns = float(np.sqrt(2 - 2 * cos)), _radii(nodes), ["vec_id", "embedding", "times", "label", "dim", "cell"]
    sent = p.select(columns)
    if radii is None:
        sent = p.join(nodes.groupBy("label", "dim").agg(F.collect_list(F.struct("cell", "radius")).alias("radii")), ["label", "dim"]).select(*columns, "radii")
    sent = sent.mapInArrow(_by_dim(_sent(centres, within, radii)), "vec_id bigint, embedding binary, times bigint, label string, dim int, cell bigint")

    def home_block(rows: DataFrame) -> DataFrame:
        return rows.join(nodes.select("label", "dim", "cell", "blocks"), ["label", "dim", "cell"]).withColumn("own", F.pmod("vec_id", "blocks"))

    # Blocks of a cell against each other: a point goes to the later blocks; a visitor goes to all blocks, and in
    # each the visitors are split by their number too.
    own = home_block(p.drop("away"))
    home = own.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).where("own <= block")
    visits = home_block(sent).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    counts = home.where("own < block").groupBy("label", "dim", "cell", "block").agg(F.count("*").alias("n"))
    counts = counts.union(visits.groupBy("label", "dim", "cell", "block").agg(F.count("*").alias("n"))).groupBy("label", "dim", "cell", "block").agg(F.ceil(F.sum("n") / BLOCK).alias("parts"))
    counts = materialise(counts, "parts")
    key = ["label", "dim", "cell", "block"]
    columns = [*key, "part", "vec_id", "embedding", "times", "home", "within"]
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)) - 1))
    at_home = home.where("own = block").join(counts, key, "left").withColumn("part", every).withColumn("home", F.lit(True)).withColumn("within", F.col("part") == 0)
    others = home.where("own < block").select(*key, "vec_id", "embedding", "times").union(visits.select(*key, "vec_id", "embedding", "times"))
    others = others.join(counts, key).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).withColumn("home", F.lit(False)).withColumn("within", F.lit(False))
    both = at_home.select(columns).union(others.select(columns))
    found = both.groupBy(*key, "part").applyInPandas(_sorted(_compare(cos)), "vec_id bigint, other bigint, n bigint, edge boolean")
    found = materialise(found, "found")

    parts = components(found.where("edge").select("vec_id", "other"))
    links = found.where("not edge").groupBy(F.col("vec_id").alias("point")).agg(F.sum("n").alias("n"))
    of = points.select("label", "dim", "print", "point", "times", F.col("vec_id").alias("first")).join(links, "point", "left")
    of = of.join(parts.select(F.col("node").alias("point"), F.col("component").alias("part")), "point", "left").withColumn("part", F.coalesce("part", "point"))
    least = of.groupBy("part").agg(F.min("first").alias("component_id"))
    of = materialise(of.join(least, "part").select("label", "dim", "print", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "classes")
    linked = v.drop("embedding").join(of, ["label", "dim", "print"]).select("vec_id", "n_links", "component_id")
    rest = need(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"), "label")
    out_of_it = _no_part(rest).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(out_of_it).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _no_part(rows: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.where(~F.coalesce(fine & F.col("label").isNotNull(), F.lit(False)))


def _sorted(run: Callable) -> Callable:
    return lambda pdf: run(pdf.sort_values("vec_id", kind="stable").reset_index(drop=True))


def _by_dim(run: Callable) -> Callable:
    """``run`` on the rows of a batch by length of their vectors."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                yield from run([b if (dims == d).all() else b.filter(pa.array(dims == d))])

    return split


def _net(points: np.ndarray, n: int) -> np.ndarray:
    """n points far apart: each next is the one farthest from those before it."""
    chosen, away = [0], _distance(points, points[0])
    while len(chosen) < n:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _distance(points, points[chosen[-1]]))
    return np.array(chosen)
