"""Embedding near-duplicates by cover trees and dual traversal: exact threshold links by cosine, within equal labels.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so the threshold is a radius. Vectors of one label are laid into
blocks of about ``block`` vectors: by the nearest of at most 64 seeded anchors (as many as the label fills blocks), and by a hash where an
anchor attracts more. Each block's cover tree has nested levels with halving radii; every node keeps the true radius of what it
covers. Pairs of blocks, then pairs of nodes, are dropped where the centres' distance exceeds both radii and the threshold, taken whole where
the distance plus both radii stays within it, and opened otherwise; small nodes are compared in double precision.

A pair of blocks is one row of work with a bounded amount of data, so a label may hold any share of all rows. Vectors
that repeat exactly are one class with one representative, the smallest id. Work yields a link count per vector and a
spanning edge to its local root, never all pairs of a group; components follow from the edges.

On data without structure in many dimensions no bound prunes between blocks, and the number of block pairs grows
as the square of a label's blocks; results stay exact.

Defined results: null, empty or zero vectors, null or non-finite components and null labels link with nothing, nor do vectors of
different lengths. Rows with a null id have no links, a null component, and stay. Repeated rows count as vectors of
their own. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._join import left_join_by_weight
from ._scratch import Scratch

MOST_ANCHORS = 64
LEAF = 48
SLACK = 1e-7  # above the rounding of distances between nearly equal vectors


@dataclass
class Node:
    centre: int
    radius: float
    points: np.ndarray
    children: list[Node]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def build(x: np.ndarray, points: np.ndarray | None = None, centre: int = 0, level_radius: float = 2.0) -> Node:
    """A cover tree over unit vectors. Children cover half their parent's level radius, and the centre stays a centre below."""
    points = np.arange(len(x)) if points is None else points
    d = _distance(x[points], x[centre : centre + 1])[:, 0]
    node = Node(centre, float(d.max()), points, [])
    if len(points) <= LEAF or node.radius < 1e-7:
        return node
    half = level_radius / 2
    while half >= node.radius and half > 1e-8:
        half /= 2
    left = points[d > half]
    groups: list[tuple[int, list[np.ndarray]]] = [(centre, [points[d <= half]])]
    while len(left):
        head = left[:128]
        inner = _distance(x[head], x[head])
        chosen: list[int] = []
        for k in range(len(head)):
            if all(inner[k, c] > half for c in chosen):
                chosen.append(k)
        to = _distance(x[left], x[head[chosen]])
        near = to.argmin(1)
        covered = to[np.arange(len(left)), near] <= half
        for k, c in enumerate(chosen):
            groups.append((int(head[c]), [left[covered & (near == k)]]))
        left = left[~covered]
    node.children = [build(x, np.concatenate(p), c, half) for c, p in groups]
    return node


class Links:
    """Link counts weighted by class sizes and a union-find over local points."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.count, self.root = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))

    def _find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        differ = self.root[a] != self.root[b]
        for i, j in zip(a[differ].tolist(), b[differ].tolist()):
            i, j = self._find(i), self._find(j)
            if i != j:
                self.root[max(i, j)] = min(i, j)

    def settle(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return up
            self.root = up


def traverse(x: np.ndarray, one: Node, two: Node, cosine: float, links: Links, same: bool) -> None:
    """Add all links between the points of two trees over ``x``; ``same``: the trees are one, each pair counts once."""
    reach = math.sqrt(max(2 - 2 * cosine, 0))
    todo = [(one, two, same)]
    while todo:
        a, b, own = todo.pop()
        if own and (not a.children):
            _compare(x, a.points, a.points, cosine, links, True)
            continue
        if own:
            kids = a.children
            todo += [(k, k, True) for k in kids]
            pairs = _near(x, kids, kids, reach, True)
        else:
            small_a, small_b = not a.children, not b.children
            if small_a and small_b:
                _compare(x, a.points, b.points, cosine, links, False)
                continue
            # Open the wider node, or both where they are alike.
            open_a = not small_a and (small_b or a.radius >= b.radius / 2)
            open_b = not small_b and (small_a or b.radius >= a.radius / 2)
            pairs = _near(x, a.children if open_a else [a], b.children if open_b else [b], reach, False)
        for p, q, d in pairs:
            if d + p.radius + q.radius <= reach - SLACK:
                _whole(p.points, q.points, links)
            else:
                todo.append((p, q, False))


def _near(x: np.ndarray, left: list[Node], right: list[Node], reach: float, own: bool) -> Iterator[tuple[Node, Node, float]]:
    ca, cb = np.array([n.centre for n in left]), np.array([n.centre for n in right])
    ra, rb = np.array([n.radius for n in left]), np.array([n.radius for n in right])
    for at in range(0, len(left), 512):
        d = _distance(x[ca[at : at + 512]], x[cb])
        close = d <= reach + ra[at : at + 512, None] + rb[None, :] + SLACK
        if own:
            close &= np.arange(at, at + len(d))[:, None] < np.arange(len(right))[None, :]
        for i, j in zip(*np.nonzero(close)):
            yield left[at + i], right[j], float(d[i, j])


def _whole(p: np.ndarray, q: np.ndarray, links: Links) -> None:
    links.count[p] += links.weight[q].sum()
    links.count[q] += links.weight[p].sum()
    links.join(np.full(len(q), p[0]), q)
    links.join(p, np.full(len(p), q[0]))


def _compare(x: np.ndarray, p: np.ndarray, q: np.ndarray, cosine: float, links: Links, own: bool) -> None:
    for at in range(0, len(p), 1024):  # a node of exact repeats within rounding may be large
        part = p[at : at + 1024]
        hit = x[part] @ x[q].T >= cosine
        if own:
            hit[np.arange(len(part)), np.arange(at, at + len(part))] = False
        links.count[part] += hit @ links.weight[q]
        if not own:
            links.count[q] += links.weight[part] @ hit
        i, j = np.nonzero(hit)
        links.join(part[i], q[j])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, dim, hi, lo, vector): little-endian doubles, null where a vector can't link."""
    for batch in batches:
        hi, lo, dims, vectors = [], [], [], []
        column = batch.column(2)
        column = column.cast(pa.list_(pa.float64())) if not pa.types.is_null(column.type) else column
        usable = batch.column(0).is_valid().to_numpy(False) & batch.column(1).is_valid().to_numpy(False)
        for k, ok in enumerate(usable):
            v = column[k].values if ok else None
            if v is not None and len(v) and not v.null_count:
                x = v.to_numpy()
                norm = float((x * x).sum())
                if np.isfinite(x).all() and norm > 0:
                    if not (1e-200 < norm < 1e200):  # the square leaves the range of doubles
                        x = x / np.abs(x).max()
                    data = (x + 0.0).astype("<f8").tobytes()
                    d = xxhash.xxh3_128_intdigest(data)
                    hi.append((d >> 64) - 2**63)
                    lo.append((d & (2**64 - 1)) - 2**63)
                    dims.append(len(x))
                    vectors.append(data)
                    continue
            for a in (hi, lo, dims, vectors):
                a.append(None)
        arrays = [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(vectors, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "dim", "hi", "lo", "vector"])


def _cells(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: dict[int, np.ndarray] = {}
        for batch in batches:
            dims, total = batch.column(batch.schema.get_field_index("dim")).to_numpy(), batch.column(batch.schema.get_field_index("in_label")).to_numpy()
            vectors = batch.column(batch.schema.get_field_index("vector")).to_pylist()
            cell = np.zeros(batch.num_rows, np.int32)
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                x = _unit(np.frombuffer(b"".join(vectors[k] for k in at), "<f8").reshape(len(at), dim))
                if dim not in anchors:
                    anchors[dim] = _unit(np.random.default_rng(dim).normal(size=(MOST_ANCHORS, dim)))
                used = np.clip(-(-total[at] // block), 1, MOST_ANCHORS)
                score = x @ anchors[dim].T
                score[np.arange(MOST_ANCHORS)[None, :] >= used[:, None]] = -2
                cell[at] = score.argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


def _blocks(table: pa.Table) -> pa.Table:
    """One row per group: its ids, class sizes and vectors, with the mean direction as centre and the true radius."""
    dim = table["dim"][0].as_py()
    x = np.frombuffer(b"".join(table["vector"].to_pylist()), "<f8").reshape(-1, dim)
    u = _unit(x)
    centre = u.mean(0)
    radius = float(np.sqrt(((u - centre) ** 2).sum(1)).max())
    first = lambda c: table[c].slice(0, 1)
    ids, sizes = table["rep"].to_numpy(), table["members"].to_numpy()
    return pa.table({
        "label": first("label"), "dim": first("dim"), "cell": first("cell"), "part": first("part"), "centre": pa.array([centre.tolist()]), "radius": [radius],
        "ids": pa.array([ids.astype("<i8").tobytes()]), "sizes": pa.array([sizes.astype("<i8").tobytes()]), "vectors": pa.array([x.tobytes()]),
    })


def _pairs(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                one = row["a_block"] == row["b_block"]
                sides = "a" if one else "ab"
                dim = row["dim"]
                part = [_unit(np.frombuffer(row[f"{s}_vectors"], "<f8").reshape(-1, dim)) for s in sides]
                ids = np.concatenate([np.frombuffer(row[f"{s}_ids"], "<i8") for s in sides])
                links = Links(np.concatenate([np.frombuffer(row[f"{s}_sizes"], "<i8") for s in sides]))
                x = np.concatenate(part)
                n = len(part[0])
                if one:
                    tree = build(x)
                    traverse(x, tree, tree, cosine, links, True)
                else:
                    traverse(x, build(x, np.arange(n), 0), build(x, np.arange(n, len(x)), n), cosine, links, False)
                root = links.settle()
                hit = np.flatnonzero(links.count)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links.count[hit]), pa.array(ids[root[hit]])], names=["rep", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", cosine: float = 0.98, block: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    scratch = Scratch(vectors.sparkSession, "cover")
    label_type = vectors.select(label_col).schema[0].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = scratch.write(rows.mapInArrow(_classes, f"vec_id long, label {label_type}, dim int, hi long, lo long, vector binary"), "rows")
    total = rows.count()
    key = ["label", "dim", "hi", "lo"]
    usable = rows.where("vector is not null")
    classes = scratch.write(usable.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    one = usable.join(classes.select(F.col("rep").alias("vec_id"), *key, "members"), ["vec_id", *key]).dropDuplicates(["vec_id", *key])
    one = one.select("label", "dim", F.col("vec_id").alias("rep"), "members", "vector")
    in_label = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("in_label"))
    placed = left_join_by_weight(one, in_label, ["label", "dim"], "in_label", total).mapInArrow(_cells(block), f"label {label_type}, dim int, rep long, members long, vector binary, in_label long, cell int")
    placed = scratch.write(placed.drop("in_label"), "placed")
    in_cell = placed.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("in_cell"))
    placed = left_join_by_weight(placed, in_cell, ["label", "dim", "cell"], "in_cell", total)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("in_cell") / block)).cast("int")).drop("in_cell")
    shape = f"label {label_type}, dim int, cell int, part int, centre array<double>, radius double, ids binary, sizes binary, vectors binary"
    blocks = placed.groupBy("label", "dim", "cell", "part").applyInArrow(_blocks, shape)
    blocks = scratch.write(blocks.withColumn("block", F.struct("cell", "part")), "blocks")

    side = lambda s, *cs: blocks.select("label", "dim", *(F.col(c).alias(f"{s}_{c}") for c in cs))
    reach = math.sqrt(max(2 - 2 * cosine, 0))
    apart = F.sqrt(F.aggregate(F.zip_with("a_centre", "b_centre", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, z: s + z))
    work = side("a", "block", "centre", "radius").join(side("b", "block", "centre", "radius"), ["label", "dim"]).where("a_block <= b_block").where(apart <= F.col("a_radius") + F.col("b_radius") + reach + SLACK)
    work = work.select("label", "dim", "a_block", "b_block")
    work = work.join(side("a", "block", "ids", "sizes", "vectors"), ["label", "dim", "a_block"])
    work = work.join(side("b", "block", "ids", "sizes", "vectors"), ["label", "dim", "b_block"])
    work = work.repartition(F.xxhash64("label", "dim", "a_block", "b_block"))
    found = scratch.write(work.mapInArrow(_pairs(cosine), "rep long, links long, root long"), "found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("node", "rep")
    named = classes.join(counts, "rep", "left").join(groups, "rep", "left")
    named = named.select(*key, "members", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = left_join_by_weight(usable.drop("vector"), named, key, "members", total).select("vec_id", "n_links", F.col("component").alias("component_id"))
    bare = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(bare).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
