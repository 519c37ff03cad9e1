"""Embedding near-dedup by a dual traversal of cover trees.

Vectors are normalised, so cosine >= c means a chord of at most sqrt(2 - 2c). Equal vectors are one
row with a multiplicity. The roots of the tree are a net of pivots from a bounded sample; every vector
hangs below its nearest root. A node of more than `block` vectors is split by a net of its own sample,
level by level, so the tree grows with the data; the leaves of this top are chunks. Chunks with their lower
levels, nested nets with radii 1, 1/2, ..., 1/16, are written once, some neighbours of the tree to a row. Pairs of
these rows meet by a product that reads them again and shuffles nothing, so disk grows with the vectors and not with the
pairs. Pairs of rows, then pairs of their chunks, are pruned where they are farther apart than their covering radii and the
threshold allow; a first node takes part only if it is near enough to the partner chunk's ball and to
the bisector of the two cells. For each remaining pair of chunks a task walks down pairs of nodes:

* centres farther apart than threshold + both covering radii: no link below, pruned;
* centres at most threshold - both radii apart: all pairs below are links, counted at once;
* else the finer node pairs, and at the bottom the exact cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import connected_components

COSINE = 0.95
BLOCK = 2_048
PIVOTS = 512
FANOUT = 64  # children of a split node at most
SAMPLE = 1_024  # vectors that a split node's centres are chosen from, about
DEEPEST = 16  # levels of splits; what is still crowded then is dealt by hash
SALT = 32_768  # vectors of a split node that one task places
PARTNERS = 64  # chunks in one row that meets its partners at once, at most
BUNDLE = 16_384  # vectors in such a row, about; of long vectors fewer
BUNDLE_BYTES = 8 << 20
SHARES = 16  # rows that small tables are cut into, about, so that all tasks have work
LEVELS = (1.0, 0.5, 0.25, 0.125, 0.0625)
SLACK = 1e-7  # more than the error of a chord that comes from a cosine
ROUNDING = 1e-5  # more than the error of a dot product of unit vectors in single floats
PAIRS = 1 << 20
SCREEN = 1 << 17  # pairs screened at once: their products stay in the cache


def nets(x: np.ndarray) -> np.ndarray:
    """Of unit vectors: for each level of LEVELS the place of every vector's centre. Level k splits the groups
    of level k - 1, each greedily: the first vector left is a centre and takes all within
    LEVELS[k]. A centre stays one on all finer levels."""
    out = np.empty((len(LEVELS), len(x)), np.int64)
    groups = [np.arange(len(x))]
    for k, rho in enumerate(LEVELS):
        floor, finer = 1.0 - rho * rho / 2.0, []
        for left in groups:
            while len(left) > 1:
                near = x[left] @ x[left[0]] >= floor
                near[0] = True
                out[k, left[near]] = left[0]
                finer.append(left[near])
                left = left[~near]
            if len(left):
                out[k, left] = left
                finer.append(left)
        out[k:, [g[0] for g in finer if len(g) == 1]] = [g[0] for g in finer if len(g) == 1]
        groups = [g for g in finer if len(g) > 1]
    return out


class Tree:
    """A chunk's levels from the centres that nets() chose; the last level is the points themselves. Covering
    radii are measured."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, centre: np.ndarray | None = None):
        self.x, self.weight = x, weight
        self.kids: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # centre, radius, parent of each node
        self.saved: list[tuple[np.ndarray, np.ndarray]] = []
        parent = np.zeros(len(x), np.int64)
        for own in [*(nets(x) if centre is None else centre), np.arange(len(x))]:
            centres, node = np.unique(own, return_inverse=True)
            order = np.argsort(node, kind="stable")
            bounds = np.searchsorted(node[order], np.arange(len(centres) + 1))
            far = chord(np.einsum("ij,ij->i", x, x[own])) * (own != np.arange(len(x)))
            self.levels.append((centres, np.maximum.reduceat(far[order], bounds[:-1]) if len(x) else far, parent[centres]))
            self.saved.append((order, bounds))
            parent = node
        self.single = x[self.levels[0][0]].astype(np.float32)  # first nodes' centres, to screen pairs

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Order and bounds of level + 1's nodes by their parent at level."""
        if level not in self.kids:
            parent = self.levels[level + 1][2]
            order = np.argsort(parent, kind="stable")
            self.kids[level] = order, np.searchsorted(parent[order], np.arange(len(self.levels[level][0]) + 1))
        return self.kids[level]

    def points(self, level: int, node: int) -> np.ndarray:
        order, bounds = self.saved[level]
        return order[bounds[node] : bounds[node + 1]]


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


class Links:
    """Numbers of links and connections found between the points of two trees."""

    def __init__(self, n: int):
        self.count, self.root = np.zeros(n, np.int64), list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)


def _bands(radius: np.ndarray, some: np.ndarray | None = None) -> list[np.ndarray]:
    """Places of the nodes of about equal covering radius: single points, then by halves of the first level's."""
    band = np.digitize(radius, [SLACK, LEVELS[0] / 4, LEVELS[0] / 2])
    if some is not None:
        band = np.where(some, band, -1)
    return [at for k in range(4) if len(at := np.flatnonzero(band == k))]


def dual_links(a: Tree, b: Tree, cosine: float, some_a: np.ndarray | None = None, some_b: np.ndarray | None = None) -> Links:
    """Links between the points of a (numbered first) and of b. If b is a, each point's link with
    itself is counted too. some_*: first nodes that may have links at all (no mask: every node)."""
    same, shift = b is a, 0 if b is a else len(a.x)
    out = Links(len(a.x) + (0 if same else len(b.x)))
    t = math.sqrt(2.0 - 2.0 * cosine)
    last = len(LEVELS)
    joined: set[tuple[int, int, int]] = set()

    def whole(tree: Tree, level: int, node: int, by: int) -> np.ndarray:
        p = tree.points(level, node)
        if (by, level, node) not in joined:
            joined.add((by, level, node))
            at = p + (shift if by else 0)
            for i in at[1:]:
                out.union(int(at[0]), int(i))
        return p

    def visit(level: int, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Settle node pairs of a level; those still open come back."""
        (_, ri, _), (_, rj, _) = a.levels[level], b.levels[level]
        if level == last:
            hit = np.flatnonzero(cos >= cosine)
            np.add.at(out.count, i[hit], b.weight[j[hit]])
            if not same:
                np.add.at(out.count, j[hit] + shift, a.weight[i[hit]])
            for p, q in zip(i[hit].tolist(), (j[hit] + shift).tolist()):
                out.union(p, q)
            return i[:0], j[:0]
        d, r = chord(cos), ri[i] + rj[j]
        inside = d <= t - r - SLACK
        for p, q in zip(i[inside].tolist(), j[inside].tolist()):
            mine, other = whole(a, level, p, 0), whole(b, level, q, 0 if same else 1)
            out.count[mine] += b.weight[other].sum()
            if not same:
                out.count[other + shift] += a.weight[mine].sum()
            out.union(int(mine[0]), int(other[0]) + shift)
        rest = ~inside & (d <= t + r + SLACK)
        return i[rest], j[rest]

    # the root pair: all first-level pairs. Nodes go by bands of radius, so that a block of pairs has one bound;
    # single floats screen against it with room for their rounding, visit() decides in doubles
    (ca, ra, _), (cb, rb, _) = a.levels[0], b.levels[0]
    single_a, single_b = a.single, b.single
    stack = []
    for i in _bands(ra, some_a):
        for j in _bands(rb, some_b):
            floor = np.float32(1.0 - (t + ra[i].max() + rb[j].max()) ** 2 / 2.0 - ROUNDING)
            columns = single_b[j].T
            rows = max(1, SCREEN // len(j))
            for at in range(0, len(i), rows):
                own = i[at : at + rows]
                hit = np.flatnonzero(single_a[own] @ columns >= floor)
                if not len(hit):
                    continue
                p, q = own[hit // len(j)], j[hit % len(j)]
                for s in range(0, len(p), 65536):
                    x, y = p[s : s + 65536], q[s : s + 65536]
                    stack.append((0, *visit(0, x, y, np.einsum("ij,ij->i", a.x[ca[x]], b.x[cb[y]]))))
    while stack:
        level, i, j = stack.pop()
        if not len(i):
            continue
        (oa, ba), (ob, bb) = a.children(level), b.children(level)
        na, nb = ba[i + 1] - ba[i], bb[j + 1] - bb[j]
        size = na * nb
        if size.sum() > PAIRS and len(i) > 1:
            half = len(i) // 2
            stack += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
            continue
        pair = np.repeat(np.arange(len(i)), size)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        ci, cj = oa[ba[i[pair]] + k // nb[pair]], ob[bb[j[pair]] + k % nb[pair]]
        pa_, pb_ = a.levels[level + 1][0][ci], b.levels[level + 1][0][cj]
        cos = np.concatenate([np.einsum("ij,ij->i", a.x[pa_[s : s + 65536]], b.x[pb_[s : s + 65536]]) for s in range(0, len(pair), 65536)])
        stack.append((level + 1, *visit(level + 1, ci, cj, cos)))
    return out


PLACED = ["root", "node", "rep", "copies", "x", "far", "root_far"]


def _placed(kind: str) -> str:
    """PLACED as a schema; kind: float or double, as the vectors came."""
    return f"root long, node string, rep long, copies long, x array<{kind}>, far double, root_far double"


def matrix(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


PACKED = "bundle long, width int, single boolean, x binary, rep binary, copies binary, net binary, size binary, root binary, node array<string>, far binary, middle binary, centre array<double>, radius double"


def _pack(part: pa.Table) -> pa.Table:
    """The chunks of a bundle in one row: vectors by rep, each with its places in the chunk's nested nets, so that a tree is built
    once, whatever the number of partners; of each chunk its size, root, node, covering radius and centre. centre and
    radius are a ball around the bundle."""
    part = part.combine_chunks().sort_by([("chunk", "ascending"), ("rep", "ascending")])
    chunk = part["chunk"].to_numpy()
    first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    size = np.diff(np.r_[first, len(chunk)])
    x = matrix(part["x"], np.float64)
    u = unit(x)
    net = np.concatenate([nets(u[f : f + n]) for f, n in zip(first, size)], 1).astype(np.int32)
    single = pa.types.is_float32(part["x"].type.value_type)
    far = np.maximum.reduceat(part["far"].to_numpy(), first)
    middle = matrix(part["centre"].take(first), np.float64)
    centre = unit(middle.mean(0, keepdims=True)) if np.linalg.norm(middle.mean(0)) > SLACK else middle[:1]
    cells = {
        "bundle": part["bundle"][0].as_py(), "width": x.shape[1], "single": single, "x": x.astype(np.float32 if single else np.float64).tobytes(),
        "rep": part["rep"].to_numpy().tobytes(), "copies": part["copies"].to_numpy().tobytes(), "net": net.tobytes(), "size": size.astype(np.int64).tobytes(),
        "root": part["root"].to_numpy()[first].tobytes(), "node": part["node"].take(first).to_pylist(), "far": far.tobytes(), "middle": middle.tobytes(),
        "centre": centre[0].tolist(), "radius": float(chord(u @ centre[0]).max())
    }
    return pa.table({k: [v] for k, v in cells.items()}).cast(pa.schema([(f, t) for f, t in _PACKED_TYPES.items()]))


_PACKED_TYPES = {
    "bundle": pa.int64(), "width": pa.int32(), "single": pa.bool_(), **dict.fromkeys(["x", "rep", "copies", "net", "size", "root"], pa.binary()),
    "node": pa.list_(pa.string()), "far": pa.binary(), "middle": pa.binary(), "centre": pa.list_(pa.float64()), "radius": pa.float64()
}
SENT = [c for c in _PACKED_TYPES if c not in ("centre", "radius")]


class Bundle:
    """Chunks of one packed row, each with its tree."""

    def __init__(self, row: dict):
        whole = lambda c, t=np.int64: np.frombuffer(row[c], t)
        self.bundle, self.node = row["bundle"], row["node"]
        self.rep, self.copies, self.size, self.root = (whole(c) for c in ("rep", "copies", "size", "root"))
        self.first = np.r_[0, np.cumsum(self.size)[:-1]]
        self.far = whole("far", np.float64)
        self.middle = whole("middle", np.float64).reshape(len(self.size), row["width"])
        x = unit(whole("x", np.float32 if row["single"] else np.float64).astype(np.float64).reshape(len(self.rep), row["width"]))
        net = whole("net", np.int32).astype(np.int64).reshape(len(LEVELS), len(self.rep))
        self.trees = [Tree(x[f : f + n], self.copies[f : f + n], net[:, f : f + n]) for f, n in zip(self.first, self.size)]

    def near(self, k: int, other: Bundle, j: int, pivots: np.ndarray, reach: float) -> np.ndarray:
        """First nodes of chunk k that may link with something in chunk j of the other bundle: near enough to its
        ball and to the bisector between the roots, or between children of one node."""
        tree = self.trees[k]
        c, r = tree.x[tree.levels[0][0]], tree.levels[0][1]
        d = chord(c @ other.middle[j])
        keep = d <= reach + r + other.far[j] + SLACK
        p, q, node, partner = self.root[k], other.root[j], self.node[k], other.node[j]
        if p != q:
            mine, theirs, apart = pivots[p], pivots[q], chord(c @ pivots[q])
        elif node != partner and "." in node and partner.rpartition(".")[0] == node.rpartition(".")[0]:
            mine, theirs, apart = self.middle[k], other.middle[j], d
        else:
            return keep
        gap = float(chord(mine @ theirs))
        return keep & (apart**2 - chord(c @ mine) ** 2 <= 2 * gap * (reach + r + SLACK) + SLACK)


def bundle_links(a: Bundle, b: Bundle, pivots: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, links, root) of the vectors of both that have links between them; if b is a, inside it."""
    reach, same = math.sqrt(2.0 - 2.0 * cosine), b is a
    shift = 0 if same else len(a.rep)
    all_ = Links(shift + len(b.rep))
    rep = a.rep if same else np.concatenate([a.rep, b.rep])
    gap = chord(a.middle @ b.middle.T) <= reach + a.far[:, None] + b.far[None, :] + SLACK
    for i, j in zip(*(v.tolist() for v in np.nonzero(gap | np.eye(len(gap), dtype=bool) if same else gap))):
        if same and i > j:
            continue
        if same and i == j:
            found = dual_links(a.trees[i], a.trees[i], cosine)
            found.count -= a.trees[i].weight  # a vector with itself and its copies
        else:
            found = dual_links(a.trees[i], b.trees[j], cosine, a.near(i, b, j, pivots, reach), b.near(j, a, i, pivots, reach))
        mine = a.first[i] + np.arange(a.size[i])
        place = mine if same and i == j else np.concatenate([mine, shift + b.first[j] + np.arange(b.size[j])])
        all_.count[place] += found.count
        for k in np.flatnonzero(found.count > 0).tolist():
            all_.union(int(place[k]), int(place[found.find(k)]))
    some = np.flatnonzero(all_.count > 0)
    return rep[some], all_.count[some], rep[np.fromiter((all_.find(int(i)) for i in some), np.int64, len(some))]


def _meet(pivots, cosine: float):
    """Rows of two packed bundles each -> (rep, links, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                key = row.column("a_bundle")[0].as_py()
                if a is None or a.bundle != key:
                    a = Bundle({c: row.column(f"a_{c}")[0].as_py() for c in SENT})
                b = a if row.column("b_bundle")[0].as_py() == key else Bundle({c: row.column(f"b_{c}")[0].as_py() for c in SENT})
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in bundle_links(a, b, pivots.value, cosine)], ["rep", "links", "root"])

    return run


def _bundled(chunked: DataFrame, centres: DataFrame, n: int, roots: int, dim: int, block: int) -> DataFrame:
    """Placed rows with chunk -> packed bundles: neighbours in the tree, PARTNERS chunks and about `most` vectors at most. Running
    sums go over chunks, by groups of roots."""
    most = min(max(block, -(-n // SHARES)), max(block, min(BUNDLE, BUNDLE_BYTES // (8 * dim))))
    nodes = chunked.groupBy("chunk").agg(F.first("node").alias("node"), F.first("root").alias("root"), F.count("*").alias("n"))
    together = max(1, roots * most // max(1, n))  # roots that share a bundle where roots are small
    order = W.partitionBy(F.floor(F.col("root") / together)).orderBy("root", "node", "chunk").rowsBetween(W.unboundedPreceding, -1)
    upto, at = F.coalesce(F.sum("n").over(order), F.lit(0)), F.count("*").over(order)
    nodes = nodes.withColumn("bundle", F.xxhash64(F.floor(F.col("root") / together), F.floor(upto / most), F.floor(at / PARTNERS)))
    named = materialize(nodes.join(centres, "node").select("chunk", "bundle", "centre"))
    packed = materialize(chunked.join(named, "chunk").groupBy("bundle").applyInArrow(_pack, PACKED), **{"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"})
    discard(named)
    return packed


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _net(x: np.ndarray, want: int) -> np.ndarray:
    """Up to want pivots of a nested net: centres in the order of halving radii."""
    chosen: list[int] = []
    far = np.full(len(x), np.inf)
    rho = 2.0
    while len(chosen) < want and rho > 1e-3:
        for i in range(len(x)):
            if far[i] > rho and len(chosen) < want:
                chosen.append(i)
                far = np.minimum(far, chord(x @ x[i]))
        rho /= 2
    return x[chosen] if chosen else x[:1]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has no null and only finite components and isn't zero. Vectors whose squares could over- or
    underflow in doubles are scaled by their largest component; floats stay floats."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    x = F.transform("embedding", lambda v: v.cast("float" if single else "double") + F.lit(0.0).cast("float" if single else "double"))  # -0.0 is 0.0
    good = F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    most = F.greatest(F.array_max("x"), -F.array_min("x"))
    kept = vectors.where(F.coalesce(good, F.lit(False))).select("vec_id", x.alias("x")).withColumn("most", most).where("most > 0")
    if single:
        return kept.select("vec_id", "x")
    return kept.select("vec_id", F.when(F.col("most").between(1e-100, 1e100), F.col("x")).otherwise(F.transform("x", lambda v: v / F.col("most"))).alias("x"))


def _place(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(rep, copies, x) below the nearest of a bounded number of pivots."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            if b.num_rows:
                cos = unit(matrix(b.column("x"), np.float64)) @ p.T
                root, far = cos.argmax(1), pa.array(chord(cos.max(1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(root), pa.array(root.astype(str)), b.column("rep"), b.column("copies"), b.column("x"), far, far],
                    PLACED
                )

    return rows.select("rep", "copies", "x").mapInArrow(run, _placed(_kind(rows)))


def _kind(rows: DataFrame) -> str:
    return rows.schema["x"].dataType.elementType.simpleString()


def _own_net(block: int | None):
    def run(part: pa.Table) -> pa.Table:
        """Of a crowded node's sample: centres of its children, in one row."""
        want = 1 if block is None else max(2, min(FANOUT, -(-2 * part["size"][0].as_py() // block)))
        x = _net(unit(matrix(part.sort_by("rep")["x"], np.float64)), want)
        return pa.table({"node": part["node"].slice(0, 1), "net": pa.array([x.ravel().tolist()], pa.list_(pa.float64())), "width": pa.array([len(x)], pa.int32())})

    return run


def _descend(kind: str):
    def run(key: tuple, part: pa.Table, nets_of: pa.Table) -> pa.Table:
        """Each vector of a split node moves to the child whose centre is nearest."""
        if not len(part):
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float32() if kind == "float" else pa.float64()), pa.float64(), pa.float64())
            return pa.table([pa.array([], t) for t in types], names=PLACED)
        x = unit(matrix(part["x"], np.float64))
        cos = x @ np.array(nets_of["net"][0].as_py()).reshape(-1, x.shape[1]).T
        child = cos.argmax(1)
        node = [f"{key[0].as_py()}.{c}" for c in child.tolist()]
        return pa.table([part["root"], pa.array(node), part["rep"], part["copies"], part["x"], pa.array(chord(cos.max(1))), part["root_far"]], names=PLACED)

    return run


def _split(placed: DataFrame, block: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Nodes of more than `block` vectors split by nets of their own samples, level by level, until none is left; a node
    whose sample has only one centre is dealt by hash. (placed rows with chunk; node, centre of the split
    nodes' children; the written levels, for discard()). One loop a level of the tree."""
    spark = placed.sparkSession
    done, centres, now, level, levels = None, spark.createDataFrame([], "node string, centre array<double>"), placed, 0, [placed]
    while True:
        level += 1
        sizes = materialize(now.groupBy("node").agg(F.count("*").alias("size")))
        crowded = sizes.where(F.col("size") > block)
        small = now.join(sizes.where(F.col("size") <= block).select("node"), "node", "left_semi").withColumn("chunk", F.xxhash64("node"))
        done = small if done is None else done.unionByName(small)
        if crowded.isEmpty():
            return done, centres, levels
        held = now.join(crowded, "node")
        sample = held.where(F.pmod(F.xxhash64("rep", "node"), F.col("size")) < SAMPLE).select("node", "rep", "x", "size")
        nets_ = materialize(sample.groupBy("node").applyInArrow(_own_net(block if level <= DEEPEST else None), "node string, net array<double>, width int"))
        split = held.join(nets_.where("width > 1").select("node"), "node", "left_semi")
        flat = held.join(nets_.where("width > 1").select("node"), "node", "left_anti")
        flat = flat.withColumn("chunk", F.xxhash64("node", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / block)))).drop("size")
        done = done.unionByName(flat)
        salted = split.withColumn("salt", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / SALT)))
        salts = nets_.where("width > 1").join(crowded, "node").select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / SALT) - 1)).alias("salt"), "net")
        now = materialize(salted.groupBy("node", "salt").cogroup(salts.groupBy("node", "salt")).applyInArrow(_descend(_kind(placed)), _placed(_kind(placed))))
        levels.append(now)
        one = F.size("net") / F.col("width")
        centre = F.transform(
            F.sequence(F.lit(0), F.col("width") - 1),
            lambda k: F.struct(F.concat_ws(".", "node", k.cast("string")).alias("node"), F.slice("net", (k * one + 1).cast("int"), one.cast("int")).alias("centre"))
        )
        centres = materialize(centres.unionByName(nets_.where("width > 1").select(F.explode(centre).alias("c")).select("c.*")))


def _hash() -> Column:
    return F.xxhash64("x")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors(vec_id, embedding, ...): vec_id, n_links, component_id, kept.

    n_links: other vectors with cosine >= `cosine`; component_id: smallest vec_id reachable by
    links; kept: vec_id = component_id. Null vectors, those with null or non-finite components, of
    length zero or with a null vec_id link with nothing and are kept (component_id is their own
    vec_id). Vectors of another dimension than most link with those of their own only. Rows that
    repeat a vec_id with equal vectors count as copies. Other columns are ignored."""
    spark = vectors.sparkSession
    good = usable(vectors)
    classes = materialize(good.groupBy("x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    reach = math.sqrt(2.0 - 2.0 * cosine)
    edges, counts = None, None
    for (dim,) in classes.select(F.size("x")).distinct().collect():
        own = classes.where(F.size("x") == dim)
        n = own.count()
        sample = unit(np.array([r["x"] for r in own.orderBy(F.xxhash64("rep")).limit(PIVOTS).select("x").collect()], np.float64))
        pivots = _net(sample, max(1, min(PIVOTS, -(-n // block))))
        shared = spark.sparkContext.broadcast(pivots)
        chunked, centres, levels = _split(materialize(_place(own, pivots)), block)
        of_root = spark.createDataFrame([(str(k), v.tolist()) for k, v in enumerate(pivots)], "node string, centre array<double>")
        packed = _bundled(chunked, centres.unionByName(of_root), n, len(pivots), dim, block)
        for x in levels:
            discard(x)
        a, b = (packed.select(*(F.col(c).alias(f"{s}_{c}") for c in packed.columns)) for s in "ab")
        cos = F.aggregate(F.zip_with("a_centre", "b_centre", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        gap = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cos))
        near = (F.col("a_bundle") == F.col("b_bundle")) | ((F.col("a_bundle") < F.col("b_bundle")) & (gap <= reach + F.col("a_radius") + F.col("b_radius") + SLACK))
        pairs = a.join(b.hint("shuffle_replicate_nl"), near).select(*(f"{s}_{c}" for s in "ab" for c in SENT))
        met = materialize(pairs.mapInArrow(_meet(shared, cosine), "rep long, links long, root long"))
        discard(packed)
        e, c = met.select(F.col("rep").alias("src"), F.col("root").alias("dst")), met.groupBy("rep").agg(F.sum("links").alias("links"))
        edges, counts = (e, c) if edges is None else (edges.union(e), counts.union(c))
    if edges is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    parts = connected_components(edges)
    named = (
        classes.withColumn("h", _hash()).join(counts, "rep", "left")
        .join(parts, F.col("rep") == F.col("id"), "left")
        .select("h", "x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    # every row's vector is among the classes, so a hash that one class has tells it; others are told by the vector itself
    clash = materialize(classes.groupBy(_hash().alias("h")).count().where("count > 1").select("h"))
    rows = good.withColumn("h", _hash())
    linked = rows.select("vec_id", "h").join(named.drop("x"), "h").select("vec_id", "n_links", "component_id")
    if not clash.isEmpty():
        told = rows.join(clash, "h", "left_semi").drop("h").join(named.drop("h"), "x").select("vec_id", "n_links", "component_id")
        linked = rows.select("vec_id", "h").join(clash, "h", "left_anti").join(named.drop("x"), "h").select("vec_id", "n_links", "component_id").union(told)
    linked = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
