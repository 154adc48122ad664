"""Exact top-k inner products by best-first search in paged M-trees.

Inner products become Euclidean distances by one more component that gives all vectors one length, so the triangle
inequality holds. A bounded sample of vectors are pivots; every vector lies in the region of its nearest pivot, whose
covering radius is known. A region is cut into blocks of bounded bytes, and each block is one M-tree, built once: an
entry of an inner page has a routing vector, the radius that covers all below it, its distance to its parent's routing
vector and a page; an entry of a leaf has a vector and the distance to its parent's.

Queries travel in groups of one region. Each group first searches a block of its own region, which gives every query a
bound; then it goes to the regions that could still hold something better for one of its queries, and to no others. In
a tree pages are visited by increasing lower bound, entries are skipped by stored parent distances alone where that
is enough, and what remains is scored in integers. A tree is moved once for a number of groups, and the best k of all
blocks are merged per query. Floating point only decides what may be skipped, with slack for its errors.

Vectors that are null or hold null or non-finite components take no part, nor do rows without id. A query id asks once,
with its smallest vector; rows of its id are its own. Every other row is a candidate, repeated rows each by itself.
Vectors of another dimension than the query's are no candidates. Ties go to the smaller id. Scores must fit in a long,
else ValueError. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import drop_tables, materialize, ship_package

#: Bytes of a block's vectors, queries of a group, entries of a page, pivots at most, and groups that share one copy of a tree.
BLOCK_BYTES, QUERIES, PAGE, PIVOTS, SHARED = 8 << 20, 1024, 256, 512, 64


def scores(vectors: np.ndarray, floats: np.ndarray, q: np.ndarray, most: float | None = None) -> np.ndarray:
    """Integer inner products of int64 vectors (and the same as floats) with q; most: their largest absolute component."""
    near = floats @ q.astype(np.float64)
    most = float(np.abs(floats).max(initial=0.0)) if most is None else most
    if most * float(np.abs(q).max(initial=0)) * len(q) < 2.0**53:
        return near.astype(np.int64)
    if np.abs(near).max(initial=0.0) >= 2.0**63 * (1 - 1e-9):
        raise ValueError("an inner product does not fit in 64 bits")
    return vectors @ q  # sums may wrap on the way, the result is exact


class MTree:
    """Pages over vectors: each is (is leaf, objects, distances to parent, radii, child pages)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, np.ascontiguousarray(vectors, np.int64)
        self._measure()
        self.pages: list[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.root = self._build(np.arange(len(ids)), None) if len(ids) else -1
        self._line_up()

    def _line_up(self) -> None:
        """Puts the vectors in the order of the leaves, so that a leaf's vectors lie in a row."""
        order = np.concatenate([np.empty(0, np.int64), *(p[1] for p in self.pages if p[0])]).astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.vectors = self.ids[order], self.vectors[order]
        self.pages = [(leaf, place[obj], *rest) for leaf, obj, *rest in self.pages]
        self._measure()

    def _measure(self) -> None:
        self.floats = self.vectors.astype(np.float64)
        square = (self.floats**2).sum(axis=1)
        self.top = float(square.max(initial=0.0))
        # the further component; routing vectors are vectors of the tree, so they have it too
        self.extra = np.sqrt(np.maximum(0.0, self.top - square))
        self.visited = 0
        self.most = float(np.abs(self.floats).max(initial=0.0))

    def _distance(self, x: int, at: np.ndarray) -> np.ndarray:
        d = self.floats[at] - self.floats[x]
        return np.sqrt((d * d).sum(axis=1) + (self.extra[at] - self.extra[x]) ** 2)

    def _build(self, at: np.ndarray, parent: int | None) -> int:
        """Adds the page over these vectors and all below it; entries: object, distance to parent, radius, page."""
        far = np.zeros(len(at)) if parent is None else self._distance(parent, at)
        if len(at) <= PAGE:
            self.pages.append((True, at, far, np.zeros(len(at)), np.zeros(len(at), np.int64)))
            return len(self.pages) - 1
        n = min(PAGE // 8, -(-2 * len(at) // PAGE))
        pivots = at[np.linspace(0, len(at) - 1, n).astype(np.int64)]
        to = np.stack([self._distance(p, at) for p in pivots])
        nearest = to.argmin(axis=0)
        if len(np.unique(nearest)) == 1:  # equal vectors: by place
            nearest = np.arange(len(at)) * n // len(at)
        rows = []
        for k in np.unique(nearest):
            own = at[nearest == k]
            pivot = int(pivots[k])
            rows.append((pivot, 0.0 if parent is None else float(self._distance(parent, np.array([pivot]))[0]), float(to[k][nearest == k].max()), self._build(own, pivot)))
        obj, dist, radius, page = (np.array(c) for c in zip(*rows, strict=True))
        self.pages.append((False, obj, dist, radius, page))
        return len(self.pages) - 1

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        parts = [np.concatenate([np.empty(0, t), *(p[k] for p in self.pages)]).astype(t) for k, t in ((1, np.int64), (2, float), (3, float), (4, np.int64))]
        sizes = np.array([len(p[1]) for p in self.pages], np.int64)
        np.savez(out, ids=self.ids, vectors=self.vectors, leaf=np.array([p[0] for p in self.pages], bool), sizes=sizes, obj=parts[0], dist=parts[1], radius=parts[2], child=parts[3])
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> MTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as x:
            tree.ids, tree.vectors = x["ids"], x["vectors"]
            cut = np.cumsum(x["sizes"])[:-1]
            columns = [np.split(x[c], cut) for c in ("obj", "dist", "radius", "child")]
            tree.pages = list(zip(x["leaf"].tolist(), *columns, strict=True))
        tree._measure()
        tree.root = len(tree.pages) - 1
        return tree

    def search(self, query_id: int, q: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the best k, without the query's own id, ties to smaller ids; with a floor, none below it."""
        if self.root < 0:
            return []
        as_float = q.astype(np.float64)
        base = float(as_float @ as_float) + self.top
        slack = 1e-6 * (1.0 + np.sqrt(base))

        def reach(score: float) -> float:
            return float(np.sqrt(max(0.0, base - 2 * float(score)))) + slack

        best_s, best_i = np.empty(0, np.int64), np.empty(0, np.int64)
        bound = np.inf if floor is None else reach(floor)
        queue: list[tuple[float, int, float]] = [(0.0, self.root, np.nan)]
        while queue:
            lower, page, near = heapq.heappop(queue)
            if lower > bound:
                break
            self.visited += 1
            leaf, obj, dist, radius, child = self.pages[page]
            near_parent = np.isfinite(near) and np.isfinite(bound)
            if leaf:
                # parent distances rule out entries without a distance; a leaf without any to rule out is a slice
                own = slice(int(obj[0]), int(obj[0]) + len(obj))
                if near_parent:
                    keep = np.abs(dist - near) <= bound
                    if not keep.any():
                        continue
                    if not keep.all():
                        own = obj[keep]
                score, ids = scores(self.vectors[own], self.floats[own], q, self.most), self.ids[own]
                least = best_s[-1] if len(best_s) == k else floor
                ok = ids != query_id
                if least is not None:
                    ok &= score >= least
                if ok.any():
                    s, i = np.concatenate([best_s, score[ok]]), np.concatenate([best_i, ids[ok]])
                    order = np.lexsort((i, ~s))[:k]  # ~s falls as s rises and never overflows
                    best_s, best_i = s[order], i[order]
                    if len(best_s) == k:
                        bound = min(bound, reach(best_s[-1]))
            else:
                if near_parent:
                    keep = np.abs(dist - near) - radius <= bound
                    obj, radius, child = obj[keep], radius[keep], child[keep]
                near_child = np.sqrt(np.maximum(0.0, base - 2 * (self.floats[obj] @ as_float)))
                for low, c, d in zip((near_child - radius).tolist(), child.tolist(), near_child.tolist(), strict=True):
                    if low <= bound:
                        heapq.heappush(queue, (max(low, lower), c, d))
        return [(int(s), int(i)) for s, i in zip(best_s, best_i, strict=True)]


def nearest_pivot(v: np.ndarray, pivots: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the place of its nearest pivot and the distance to it, further component included."""
    v, p = v.astype(np.float64), pivots.astype(np.float64)
    v2, p2 = (v * v).sum(axis=1), (p * p).sum(axis=1)
    ve, pe = np.sqrt(np.maximum(0.0, top - v2)), np.sqrt(np.maximum(0.0, top - p2))
    square = np.maximum(0.0, v2[:, None] + p2[None, :] - 2 * v @ p.T) + (ve[:, None] - pe[None, :]) ** 2
    at = square.argmin(axis=1)
    return at, np.sqrt(square[np.arange(len(v)), at])


class Regions:
    """Pivots by dimension, with each region's covering radius and number of blocks; bounded by PIVOTS and dimensions."""

    def __init__(self, pivots: dict[int, np.ndarray], top: dict[int, float]):
        self.pivots, self.top = pivots, top
        self.radius: dict[tuple[int, int], float] = {}

    def within(self, dim: int, q: np.ndarray, floor: list[int | None]) -> np.ndarray:
        """The regions of a dimension that may hold something as good as its floor for any of the queries."""
        p, q = self.pivots[dim].astype(np.float64), q.astype(np.float64)
        base = (q * q).sum(axis=1) + self.top[dim]
        far = np.sqrt(np.maximum(0.0, base[:, None] - 2 * q @ p.T))
        radius = np.array([self.radius.get((dim, i), -np.inf) for i in range(len(p))])
        least = np.array([np.inf if f is None else np.sqrt(max(0.0, b - 2 * float(f))) for f, b in zip(floor, base, strict=True)])
        slack = 2e-6 * (1.0 + np.sqrt(base))
        return np.flatnonzero((far - radius[None, :] <= (least + slack)[:, None]).any(axis=0))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.array(column.flatten(), np.int64).reshape(-1, dim)


_FOUND = "query_id long, vec_id long, score long"


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit, each unit's tree before its groups of queries."""
    tree, own = None, None
    for batch in batches:
        for r in range(batch.num_rows):
            unit = tuple(batch.column(c)[r].as_py() for c in ("dim", "pivot", "salt", "part"))
            raw = batch.column("tree")[r]
            if raw.is_valid:
                tree, own = MTree.from_bytes(raw.as_py()), unit
                continue
            if unit != own:
                continue
            ids, floor = (batch.column(c)[r].values.to_pylist() for c in ("ids", "floors"))
            q = np.array(batch.column("v")[r].values, np.int64).reshape(len(ids), -1)
            found = [(i, s, c) for i, x, f in zip(ids, q, floor, strict=True) for s, c in tree.search(i, x, k, f)]
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[1], pa.int64())], names=["query_id", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's best k of all other rows by integer inner product of
    floor(scale * component)."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(finite & (F.size("v") > 0))
    whole = materialize(rows.select("vec_id", "is_query", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * scale)).alias("v")), "mtree-vectors")

    # a row per dimension, and a bounded sample of pivots
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    shapes = whole.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("top")).orderBy("dim").collect()
    most = {r["dim"]: max(1, min(PIVOTS, -(-r["n"] * 8 * r["dim"] // BLOCK_BYTES))) for r in shapes}
    pivots = {}
    for dim, n in most.items():
        sample = whole.where(F.col("dim") == dim).orderBy(F.xxhash64("v"), "vec_id").limit(n).select("v").collect()
        pivots[dim] = np.unique(np.array([r["v"] for r in sample], np.int64).reshape(-1, dim), axis=0)
    regions = Regions(pivots, {r["dim"]: r["top"] for r in shapes})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                at, far = nearest_pivot(_vectors(own.column("v"), dim), regions.pivots[dim], regions.top[dim])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(at), pa.array(far)], names=[*own.schema.names, "pivot", "far"])

    placed = whole.mapInArrow(assign, "vec_id long, is_query boolean, dim int, v array<long>, pivot long, far double")
    # numbers of their own, so that repeated rows spread over a region's blocks
    placed = materialize(placed.withColumn("row", F.monotonically_increasing_id()), "mtree-placed")
    size = F.ceil(F.count("*") * F.col("dim") * 8 / BLOCK_BYTES)
    sizes = materialize(placed.groupBy("dim", "pivot").agg(size.alias("blocks"), F.max("far").alias("radius")), "mtree-regions")
    regions.radius = {(r["dim"], r["pivot"]): r["radius"] for r in sizes.collect()}  # at most PIVOTS a dimension
    salted = placed.join(sizes.drop("radius"), ["dim", "pivot"]).withColumn("salt", F.pmod("row", F.col("blocks")))
    blocks = salted.groupBy("dim", "pivot", "salt").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("x"))  # bounded by BLOCK_BYTES, about
    blocks = blocks.select("dim", "pivot", "salt", F.col("x.vec_id").alias("ids"), F.flatten("x.v").alias("v"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, v = (np.array(batch.column(c)[r].values, np.int64) for c in ("ids", "v"))
                raw = MTree(ids, v.reshape(len(ids), -1)).to_bytes()
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(r, 1) for c in ("dim", "pivot", "salt")), pa.array([raw], pa.binary())], names=["dim", "pivot", "salt", "tree"])

    trees = materialize(blocks.mapInArrow(build, "dim int, pivot long, salt long, tree binary"), "mtree-trees")
    asked = placed.where("is_query").groupBy("vec_id").agg(F.min_by(F.struct("dim", "pivot", "v"), F.struct("v")).alias("q")).select(F.col("vec_id").alias("query_id"), "q.*")
    count = asked.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / QUERIES).alias("groups"))
    asked = asked.join(count, ["dim", "pivot"]).withColumn("sub", F.pmod(F.xxhash64("query_id"), F.col("groups"))).drop("groups")
    asked = materialize(asked.join(sizes.select("dim", "pivot", "blocks"), ["dim", "pivot"]).withColumn("home", F.pmod("sub", F.col("blocks"))).drop("blocks"), "mtree-queries")

    def groups(queries: DataFrame) -> DataFrame:
        lists = queries.groupBy("dim", "pivot", "sub", "home").agg(F.sort_array(F.collect_list(F.struct("query_id", "v", "floor"))).alias("x"))
        return lists.select("dim", "pivot", "sub", "home", F.col("x.query_id").alias("ids"), F.flatten("x.v").alias("v"), F.col("x.floor").alias("floors"))

    def search(units: DataFrame, shared: int) -> DataFrame:
        """Units: dim, pivot, salt of a block, part, and a group's ids, v, floors."""
        copies = trees.select("dim", "pivot", "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shared - 1).cast("long"))).alias("part"), "tree")
        copies = copies.join(units.select("dim", "pivot", "salt", "part").distinct(), ["dim", "pivot", "salt", "part"])
        both = copies.unionByName(units, allowMissingColumns=True)
        key = ["dim", "pivot", "salt", "part"]
        return both.repartition(*key).sortWithinPartitions(*key, F.col("tree").isNull()).mapInArrow(lambda it: _search(it, k), _FOUND)

    first = groups(asked.withColumn("floor", F.lit(None).cast("long")))
    first = first.select("dim", "pivot", F.col("home").alias("salt"), F.lit(0).cast("long").alias("part"), "ids", "v", "floors")
    near = materialize(search(first, 1), "mtree-near")
    floors = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    bounded = materialize(groups(asked.join(floors, F.col("query_id") == F.col("id"), "left").drop("id")), "mtree-groups")

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, floors = batch.column("dim")[r].as_py(), batch.column("floors")[r].values.to_pylist()
                at = regions.within(dim, np.array(batch.column("v")[r].values, np.int64).reshape(len(floors), -1), floors)
                one = batch.select(["dim", "pivot", "sub"]).slice(r, 1).take(pa.array(np.zeros(len(at), np.int64)))
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array(at, pa.int64())], names=["dim", "pivot", "sub", "to"])

    shared = max(1, -(-bounded.count() // SHARED))
    goes = bounded.select("dim", "pivot", "sub", "v", "floors").mapInArrow(reached, "dim int, pivot long, sub long, to long")
    goes = goes.join(sizes.select("dim", F.col("pivot").alias("to"), "blocks"), ["dim", "to"]).select("dim", "pivot", "sub", "to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("salt"))
    further = goes.join(bounded, ["dim", "pivot", "sub"]).where("to != pivot or salt != home")
    part = F.pmod(F.xxhash64("pivot", "sub"), F.lit(shared)).alias("part")
    further = further.select("dim", F.col("to").alias("pivot"), "salt", part, "ids", "v", "floors")
    far = materialize(search(further, shared), "mtree-far")
    drop_tables(whole, placed, sizes, trees, asked, bounded)
    return _best(near.unionByName(far), k).select("query_id", "rank", "vec_id", "score")
