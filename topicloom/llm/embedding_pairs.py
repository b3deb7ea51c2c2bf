"""Embedding near-duplicates: one cover tree over all vectors, joined with itself by dual traversal.

Equal vectors become one class with a multiplicity. The top of the tree is a bounded set of centres, chosen far
apart among a sample; every class belongs to its nearest centre, and a centre's cell is cut into chunks of at most
about ``CHUNK`` classes. Each chunk holds the tree below: nested nets with halving radii, built once. Cells whose
centres lie further apart than both covering radii and the threshold never meet; the others meet chunk by chunk.
A pair of chunks is one task that walks two trees down together: a pair of nodes is left as soon as the angle of
its centres exceeds both radii and the threshold, and counted as a whole once the angle and both radii lie
within it. Angles obey the triangle inequality, so nothing is missed; what is left is compared in double precision.

Vectors that do not cluster let no bound prune, and then every chunk meets every other: their number of tasks
grows with the square of the input. Pairs are not returned: a task sends degrees and a spanning forest.

Defined results: vectors that are null, empty, zero or hold null or non-finite values link with nothing;
vectors of different length do not link; repeated ids are vectors of their own with the same component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.graph import components, local_components
from topicloom.llm.tables import pack_fields, partitions, unpack_fields
from topicloom.operators.lookup import lookup_join
from topicloom.session import RunFolder

COSINE = 0.9
# Classes of a chunk, and centres of the top at most; a centre is chosen among SAMPLE vectors.
CHUNK = 8192
MOST_CENTRES = 512
SAMPLE = 4
LEVELS = 4
# Nodes of so few points are not split before the points themselves.
LEAF = 16
# Elements of a block of comparisons.
BLOCK = 1 << 21
# More than the rounding of single and of double precision.
SLACK32, SLACK = 1e-5, 1e-7


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


class CoverTree:
    """Nested nets of unit vectors in an order in which every node is a range.

    ``levels`` holds (start of each node's points, its centre, its radius as an angle); level l has nodes of chord
    radius 2 ** -l below the nodes of the level above, and the last one is the points themselves.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        n = len(points)
        self.points, self.order = points, order
        self.single = points.astype(np.float32)
        self.levels = [*levels, (np.arange(n + 1), np.arange(n), np.zeros(n))]

    @staticmethod
    def build(points: np.ndarray, depth: int = LEVELS) -> CoverTree:
        single = points.astype(np.float32)
        member, centre, nets = np.zeros(len(points), np.int64), np.zeros(min(len(points), 1), np.int64), []
        for level in range(1, depth + 1):
            member, centre = _net(single, member, centre, 2.0**-level, whole=level == 1)
            nets.append((member, centre))
        # large nodes first, so that nodes of one point stand together at the end
        size = np.bincount(nets[0][0], minlength=len(nets[0][1]))
        order = np.lexsort((*[m for m, _ in reversed(nets)], -size[nets[0][0]]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        points, levels = points[order], []
        for m, c in nets:
            m = m[order]
            starts = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])[: len(m)]
            centres = place[c[m[starts]]]
            sizes = np.diff(np.r_[starts, len(m)])
            gap = _angle(np.einsum("ij,ij->i", points, points[np.repeat(centres, sizes)]))
            gap[centres] = 0
            levels.append((np.r_[starts, len(m)], centres, np.maximum.reduceat(gap, starts) + SLACK * (sizes > 1)))
        return CoverTree(points, order, levels)

    def size(self, level: int, node: np.ndarray) -> np.ndarray:
        starts = self.levels[level][0]
        return starts[node + 1] - starts[node]

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First node of the next level below each node, and the first one after."""
        starts, below = self.levels[level][0], self.levels[level + 1][0]
        return np.searchsorted(below, starts[node]), np.searchsorted(below, starts[node + 1])


def _net(points: np.ndarray, above: np.ndarray, centres_above: np.ndarray, radius: float, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """A greedy net inside each node of the level above: the node of each point, and the centre of each node."""
    order = np.argsort(above, kind="stable")
    cuts = np.searchsorted(above[order], np.arange(len(centres_above) + 1))
    node, centres, bound = np.full(len(points), -1), [], 1 - radius * radius / 2
    for i, first in enumerate(centres_above.tolist()):
        left = order[cuts[i] : cuts[i + 1]]
        if not whole and (len(left) <= LEAF or (points[left] @ points[first]).min() >= bound):
            node[left] = len(centres)
            centres.append(first)
            continue
        while len(left):
            # take a batch of far-apart points at once: cheap for vectors that do not cluster
            some = left[:64]
            close = points[some] @ points[some].T >= bound
            taken = []
            for j in range(len(some)):
                if not close[j, taken].any():
                    taken.append(j)
            near = points[left] @ points[some[taken]].T
            near[taken, np.arange(len(taken))] = 2
            best = near.argmax(1)
            inside = near[np.arange(len(left)), best] >= bound
            node[left[inside]] = best[inside] + len(centres)
            centres += some[taken].tolist()
            left = left[~inside]
    return node, np.array(centres, np.int64)


class _Links:
    """Degrees and labels of two trees' points while their links come in; a tree may meet itself."""

    def __init__(self, a: CoverTree, b: CoverTree, ma: np.ndarray, mb: np.ndarray):
        self.a, self.b, self.ma, self.mb = a, b, ma, mb
        self.shift = 0 if a is b else len(a.points)
        n = self.shift + len(b.points)
        self.degree, self.label, self.ends, self.held = np.zeros(n, np.int64), np.arange(n), [], 0

    def edges(self, i: np.ndarray, j: np.ndarray) -> None:
        j = j + self.shift
        open_ = self.label[i] != self.label[j]
        if open_.any():
            self.ends.append((i[open_], j[open_]))
            self.held += int(open_.sum())
            if self.held > BLOCK // 4:
                self.settle()

    def settle(self) -> None:
        if self.ends:
            i, j = (np.concatenate(x) for x in zip(*self.ends))
            label = local_components(len(self.label), self.label[i], self.label[j])
            self.label, self.ends, self.held = label[self.label], [], 0

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links point by point."""
        n = len(self.degree)
        self.degree += np.bincount(i, self.mb[j], n).astype(np.int64) + np.bincount(j + self.shift, self.ma[i], n).astype(np.int64)
        self.edges(i, j)

    def whole(self, i: slice, j: slice) -> None:
        """All points of one range with all of another; a range with itself, each point with the others."""
        if self.shift == 0 and i == j:
            self.degree[i] += self.ma[i].sum() - self.ma[i]
            at = np.arange(i.start, i.stop)
            self.edges(at[:-1], at[1:])
            return
        self.degree[i] += self.mb[j].sum()
        self.degree[j.start + self.shift : j.stop + self.shift] += self.ma[i].sum()
        x, y = np.arange(i.start, i.stop), np.arange(j.start, j.stop)
        self.edges(x, np.full(len(x), j.start))
        self.edges(np.full(len(y), i.start), y)

    def dense(self, i: slice, j: slice, cosine: float) -> None:
        """Two ranges compared point by point."""
        same = self.shift == 0 and i == j
        step = max(BLOCK // max(j.stop - j.start, 1), 1)
        for begin in range(i.start, i.stop, step):
            end = min(begin + step, i.stop)
            links = self.a.points[begin:end] @ self.b.points[j].T >= cosine
            if same:
                links &= np.arange(begin, end)[:, None] < np.arange(j.start, j.stop)
            x, y = np.nonzero(links)
            self.pairs(x + begin, y + j.start)


def dual_traversal(a: CoverTree, b: CoverTree, cosine: float, links: _Links) -> int:
    """Reports every pair over the threshold once; returns how many pairs of nodes or points were looked at."""
    theta, same, looked = float(np.arccos(cosine)), a is b, 0

    def meet(level: int, i: slice, j: slice):
        """Pairs of nodes of two ranges whose bound lets them link."""
        nonlocal looked
        (_, ca, ra), (_, cb, rb) = a.levels[level], b.levels[level]
        step = max(min(BLOCK // 1024, i.stop - i.start), 1)
        for x in range(i.start, i.stop, step):
            left = slice(x, min(x + step, i.stop))
            for y in range(j.start, j.stop, 1024):
                right = slice(y, min(y + 1024, j.stop))
                if same and right.stop <= left.start:
                    continue
                dot = a.single[ca[left]] @ b.single[cb[right]].T
                looked += dot.size
                least = np.cos(min(ra[left].max() + rb[right].max() + theta, np.pi)) - SLACK32
                p, q = np.nonzero(dot >= least)
                fine = dot[p, q] >= np.cos(np.minimum(ra[left][p] + rb[right][q] + theta, np.pi)) - SLACK32
                p, q = p[fine] + x, q[fine] + y
                if same:
                    p, q = p[p <= q], q[p <= q]
                yield p, q

    stack = [(0, p, q) for p, q in meet(0, slice(0, len(a.levels[0][1])), slice(0, len(b.levels[0][1])))]
    last = len(a.levels) - 1
    while stack:
        level, p, q = stack.pop()
        (sa, ca, ra), (sb, cb, rb) = a.levels[level], b.levels[level]
        step = max(BLOCK // 8 // max(a.points.shape[1], 1), 1)
        cos = np.concatenate([np.einsum("ij,ij->i", a.points[ca[p[k : k + step]]], b.points[cb[q[k : k + step]]]) for k in range(0, len(p), step)] or [np.zeros(0)])
        one = (a.size(level, p) == 1) & (b.size(level, q) == 1)
        hit = one & (cos >= cosine) & ~((p == q) & same)
        links.pairs(sa[p[hit]], sb[q[hit]])
        angle = np.where((p == q) & same, 0, _angle(cos))
        inside = ~one & (angle + np.where((p == q) & same, 2 * ra[p], ra[p] + rb[q]) <= theta - SLACK)
        for x, y in zip(p[inside].tolist(), q[inside].tolist()):
            links.whole(slice(sa[x], sa[x + 1]), slice(sb[y], sb[y + 1]))
        more = np.flatnonzero(~one & ~inside & (angle <= ra[p] + rb[q] + theta + SLACK))
        if not len(more):
            continue
        p, q = p[more], q[more]
        (pa_, pe), (qa, qe) = a.children(level, p), b.children(level, q)
        for k in range(len(p)):
            i, j = slice(sa[p[k]], sa[p[k] + 1]), slice(sb[q[k]], sb[q[k] + 1])
            nodes, points = (pe[k] - pa_[k]) * (qe[k] - qa[k]), (i.stop - i.start) * (j.stop - j.start)
            if level + 1 == last or points <= 1 << 12 or nodes * 4 > points:
                links.dense(i, j, cosine)
                looked += points
            else:
                stack += [(level + 1, x, y) for x, y in meet(level + 1, slice(pa_[k], pe[k]), slice(qa[k], qe[k])) if len(x)]
    links.settle()
    return looked


def _far_apart(points: np.ndarray, k: int) -> np.ndarray:
    """``k`` of the points, each as far as can be from those before."""
    chosen, near = [], np.full(len(points), -2.0)
    for _ in range(min(k, len(points))):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, points @ points[chosen[-1]])
        near[chosen[-1]] = 3
    return points[chosen]


def vector_links(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``."""
    run = RunFolder(vectors.sparkSession, "vectors")
    value = F.col(column).cast("array<double>")
    fine = F.coalesce(
        F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(value, lambda x: x != 0),
        F.lit(False),
    ) & F.col(vec_id).isNotNull()
    # -0.0 and 0.0 are one value; two hashes of 64 bits name it where it is only looked up
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), fine.alias("fine"), F.when(fine, F.transform(value, lambda x: x + F.lit(0.0))).alias("v"))
    key = F.when(F.col("fine"), F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "v"))))
    rows = run.write(rows.select("vec_id", key.alias("key"), "v"), "rows")
    grouped = rows.where("key is not null").groupBy("key", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    classes = run.write(grouped, "classes").withColumn("length", F.size("v"))
    n = classes.count()
    length = classes.groupBy("length").count().orderBy(F.desc("count"), "length").first()
    length = length["length"] if length else 0
    k = min(max(-(-n // CHUNK), 1), MOST_CENTRES)
    sample = classes.where(F.col("length") == length).orderBy(F.xxhash64("key"), "key").limit(SAMPLE * k).select("v").toArrow()
    centres = _far_apart(_units(np.array(sample["v"].to_pylist(), float).reshape(-1, length)), k) if n else np.zeros((0, length))

    def place(batches):
        """The nearest centre and the angle to it; vectors of another length are a cell of their own for each."""
        for batch in batches:
            size = np.asarray(batch["length"])
            cell, gap = -size.astype(np.int64), np.full(len(size), np.pi)
            usual = np.flatnonzero(size == length)
            for at in np.array_split(usual, -(-len(usual) * max(len(centres), 1) // BLOCK) or 1):
                if len(at):
                    dot = _units(np.asarray(batch["v"].take(pa.array(at)).flatten(), float).reshape(-1, length)) @ centres.T
                    cell[at] = dot.argmax(1)
                    gap[at] = _angle(dot.max(1))
            named = {c: batch[c] for c in ("key", "rep", "m", "v")}
            yield pa.record_batch(named | {"cell": pa.array(cell), "gap": pa.array(gap)})

    placed = classes.select("key", "rep", "m", "v", "length").mapInArrow(place, "key string, rep bigint, m bigint, v array<double>, cell bigint, gap double")
    placed = run.write(placed.withColumn("cls", F.monotonically_increasing_id()), "placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius"))
    cells = run.write(sizes.withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int")), "cells")
    known = {r.cell: r for r in cells.where("cell >= 0").collect()}  # at most MOST_CENTRES
    at = np.array(sorted(known), np.int64)
    radius = np.array([known[c].radius for c in at.tolist()])
    apart = _angle(centres[at] @ centres[at].T) if len(at) else np.zeros((0, 0))
    meets = (apart + apart.T) / 2 <= radius[:, None] + radius[None, :] + np.arccos(cosine) + SLACK
    partners = [(int(c), [(int(d), known[int(d)].parts) for d in at[row]]) for c, row in zip(at, meets)]
    partners = vectors.sparkSession.createDataFrame(partners, "cell bigint, others array<struct<cell bigint, parts int>>")

    def chunk(table: pa.Table) -> pa.Table:
        """One chunk as a tree, its vectors in single precision where that holds them."""
        v, cls, m = table["v"].combine_chunks(), np.asarray(table["cls"]), np.asarray(table["m"])
        x = np.asarray(v.flatten(), float).reshape(len(cls), -1)
        tree = CoverTree.build(_units(x))
        x = x[tree.order]
        single = x.astype(np.float32)
        kept = single if (single == x).all() else x
        flat = np.concatenate([np.r_[len(c), s, c] for s, c, _ in tree.levels[:-1]])
        radii = np.concatenate([r for _, _, r in tree.levels[:-1]])
        data = pack_fields(np.array([x.shape[1], kept.itemsize]), kept.ravel().view(np.uint8), flat, radii, cls[tree.order], m[tree.order])
        return pa.table({"cell": table["cell"][:1], "part": table["part"][:1], "data": pa.array([data], pa.binary())})

    part = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part")
    dealt = placed.join(cells.where("parts > 1").select("cell", "parts"), "cell", "left")
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1))).select("cell", part, "cls", "m", "v")
    chunks = run.write(dealt.groupBy("cell", "part").applyInArrow(chunk, "cell bigint, part int, data binary"), "chunks")
    # a cell of another length meets only itself
    alone = F.array(F.struct("cell", "parts"))
    with_cells = chunks.join(cells.select("cell", "parts"), "cell").join(F.broadcast(partners), "cell", "left")
    other = F.explode(F.flatten(F.transform(F.coalesce("others", alone), lambda c: F.transform(F.sequence(F.lit(0), c.parts - 1), lambda i: F.struct(c.cell.alias("cell"), i.cast("int").alias("part"))))))
    spread = with_cells.select(F.struct("cell", "part").alias("me"), "data", other.alias("with"))
    spread = spread.select(F.least("me", "with").alias("c1"), F.greatest("me", "with").alias("c2"), (F.col("me") > F.col("with")).alias("second"), "data")
    pairs = max(partitions(vectors.sparkSession), min(int(chunks.count()) ** 2 // 2, 4096))

    def join(table: pa.Table) -> pa.Table:
        sides = [_stored(d) for _, d in sorted(zip(table["second"].to_pylist(), table["data"].to_pylist()), key=lambda x: x[0])]
        (a, cls_a, ma), (b, cls_b, mb) = sides[0], sides[-1]
        links = _Links(a, b, ma, mb)
        dual_traversal(a, b, cosine, links)
        cls = cls_a if a is b else np.r_[cls_a, cls_b]
        out = np.flatnonzero(links.degree > 0)
        return pa.table({"a": pa.array(cls[out]), "b": pa.array(cls[links.label[out]]), "n": pa.array(links.degree[out])})

    found = run.write(spread.repartition(pairs, "c1", "c2").groupBy("c1", "c2").applyInArrow(join, "a bigint, b bigint, n bigint"), "found")
    degree = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    label = components(found.select("a", "b"), run, "classes-joined").withColumnRenamed("id", "cls")
    named = placed.select("cls", "key", "rep", "m").join(degree, "cls", "left").join(label, "cls", "left")
    named = run.write(named.select("key", "rep", "m", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("label", "cls").alias("label")), "named")
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    of_label = named.groupBy("label").agg(F.count("*").alias("n"))
    classed = lookup_join(named, least, "label", "key", of_label).select("key", (F.col("n") + F.col("m") - 1).alias("links"), "component")
    copies = named.select("key", F.col("m").alias("n"))
    linked = lookup_join(rows.where("key is not null").select("vec_id", "key"), classed, "key", "vec_id", copies).drop("key")
    none = rows.where("key is null").select("vec_id", F.lit(0).cast("bigint").alias("links"), F.col("vec_id").alias("component"))
    return linked.select("vec_id", "links", "component").unionByName(none).select(
        "vec_id",
        F.col("links").cast("bigint").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"),
    )


def _stored(data: bytes) -> tuple[CoverTree, np.ndarray, np.ndarray]:
    head, raw, flat, radii, cls, m = unpack_fields(data, np.int64, np.uint8, np.int64, np.float64, np.int64, np.int64)
    points = _units(raw.view(np.float32 if head[1] == 4 else np.float64).reshape(-1, head[0]).astype(float))
    levels, at, done = [], 0, 0
    while at < len(flat):
        n = int(flat[at])
        levels.append((flat[at + 1 : at + n + 2], flat[at + n + 2 : at + 2 * n + 2], radii[done : done + n]))
        at, done = at + 2 * n + 2, done + n
    return CoverTree(points, np.arange(len(points)), levels), cls, m
