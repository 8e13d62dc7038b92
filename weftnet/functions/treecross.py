"""Cross interpolation on trees, of one function or of many regions of it side by side.

Each edge cuts the vertices in two; it holds as many assignments of either side, its pivots. An edge is updated by proposing
more assignments on both sides, from the pivots of neighbouring edges or at random, evaluating the function at all pairs, and
choosing pivots by elimination. State is a table of regions. All regions and all edges of a colour (edges without a common
vertex) are updated by one job, whose groups are region and edge; so jobs depend on the tree's degree and on sweeps only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..index import Index, new_link
from ..plans.network import Network
from ..plans.patches import FREE, SCHEMA, Layout, PatchedTrain
from ..session import cut_lineage
from ..tensor import Tensor

#: Proposers: all combinations of neighbouring pivots; those, or a seeded sample where there are over CANDIDATES; seeded ones only.
DEFAULT, TRUNCATED, SIMPLE = "default", "truncated", "simple"
CANDIDATES = 512
#: Seeded points of a region that its first pivot and its error are taken from.
SAMPLES = 256


@dataclass(frozen=True)
class Tree:
    """Vertices 0, 1, ... with their dimensions, joined by edges."""

    dims: tuple[int, ...]
    edges: tuple[tuple[int, int], ...]

    def __post_init__(self) -> None:
        if len(self.edges) != len(self.dims) - 1 or len(self.walk(0)) != len(self.dims):
            raise ValueError("not a tree")

    def around(self, v: int) -> list[tuple[int, int]]:
        """Neighbours of a vertex and the edges to them."""
        return [(b if a == v else a, e) for e, (a, b) in enumerate(self.edges) if v in (a, b)]

    def walk(self, root: int) -> list[tuple[int, int | None, int | None]]:
        """vertex, parent and the edge to it, leaves first."""
        out, todo, seen = [], [(root, None, None)], {root}
        while todo:
            v, p, e = todo.pop()
            out.append((v, p, e))
            for w, f in self.around(v):
                if w not in seen:
                    seen.add(w)
                    todo.append((w, v, f))
        return out[::-1]

    def half(self, v: int, edge: int) -> int:
        """The number of v's side of an edge: twice the edge, and one more for its second end."""
        return 2 * edge + (self.edges[edge][1] == v)

    def members(self, half: int) -> list[int]:
        edge, side = divmod(half, 2)
        own, other = self.edges[edge][side], self.edges[edge][1 - side]
        out, todo = {own}, [own]
        while todo:
            for w, _ in self.around(todo.pop()):
                if w != other and w not in out:
                    out.add(w)
                    todo.append(w)
        return sorted(out)

    def colours(self) -> list[list[int]]:
        """Edges in classes without a common vertex; as many classes as the largest degree."""
        colour: dict[int, int] = {}
        for v, _, _ in reversed(self.walk(0)):
            used = {colour[e] for _, e in self.around(v) if e in colour}
            free = (c for c in range(len(self.edges)) if c not in used)
            for _, e in self.around(v):
                if e not in colour:
                    colour[e] = next(free)
        return [[e for e in colour if colour[e] == c] for c in sorted(set(colour.values()))]


def eliminate(a: np.ndarray, atol: float, rtol: float, most: int) -> tuple[list[int], list[int], float]:
    """Pivot rows and columns of full-pivot elimination, one at least, and the residual that is left."""
    rest, rows, cols, first = a.copy(), [], [], 0.0
    while True:
        i, j = np.unravel_index(int(np.abs(rest).argmax()), rest.shape)
        size = float(abs(rest[i, j]))
        first = first or size
        if rows and (len(rows) == min(*a.shape, most) or size <= max(atol, rtol * first)):
            return rows, cols, size
        rows.append(int(i)), cols.append(int(j))
        if size == 0:
            return rows, cols, 0.0
        rest = rest - np.outer(rest[:, j], rest[i] / rest[i, j])
        rest[i, :], rest[:, j] = 0, 0


def local_values(tree: Tree, fixed: Sequence[int], v: int) -> np.ndarray:
    out = np.zeros((1 if fixed[v] != FREE else tree.dims[v], len(tree.dims)), np.int64)
    out[:, v] = fixed[v] if fixed[v] != FREE else np.arange(tree.dims[v])
    return out


def combined(parts: Sequence[np.ndarray]) -> np.ndarray:
    """All sums of one row of each part, the last fastest: assignments of disjoint vertices side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = (out[:, None] + p[None]).reshape(-1, out.shape[1])
    return out


def proposed(tree: Tree, fixed: Sequence[int], sets: Sequence[np.ndarray], half: int, proposer: str, seed: int) -> np.ndarray:
    """Candidate assignments of one side of an edge, without repeats; the pivots it has come first unless all combinations do."""
    edge, side = divmod(half, 2)
    own = tree.edges[edge][side]
    parts = [local_values(tree, fixed, own), *(sets[tree.half(w, f)] for w, f in tree.around(own) if f != edge)]
    count = math.prod(len(p) for p in parts)
    if proposer == DEFAULT or (proposer == TRUNCATED and count <= CANDIDATES):
        return combined(parts)
    rng = np.random.default_rng([seed, half, *(c + 1 for c in fixed)])
    if proposer == TRUNCATED:
        more = sum(p[rng.integers(len(p), size=CANDIDATES)] for p in parts)
    elif proposer == SIMPLE:
        more = np.zeros((2 * len(sets[half]) + 2 * tree.dims[own], len(tree.dims)), np.int64)
        for v in tree.members(half):
            more[:, v] = rng.integers(tree.dims[v], size=len(more)) if fixed[v] == FREE else fixed[v]
    else:
        raise ValueError(f"unknown proposer {proposer}")
    rows, first = np.unique(np.concatenate([sets[half], more]), axis=0, return_index=True)
    return rows[np.argsort(first)]


def _arrays(sets: list) -> list[np.ndarray]:
    return [np.array(s, np.int64) for s in sets]


@dataclass
class TreeCross:
    """Cross interpolation of function over regions of a tree's coordinates.

    function takes a column for each vertex and gives a column, or two for complex values; it must have a value everywhere.
    state has fixed (FREE or a coordinate for each vertex), sets (the pivots of each half), errors (by edge), scale, found.
    """

    spark: SparkSession
    function: Callable[..., Column | tuple[Column, Column]]
    tree: Tree
    atol: float = 0.0
    rtol: float = 1e-10
    max_rank: int = 100
    proposer: str = DEFAULT
    seed: int = 0
    state: DataFrame | None = None
    rounds: int = 0
    ranks: list[int] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [f"x{k}" for k in range(len(self.tree.dims))]

    def values(self, points: DataFrame) -> DataFrame:
        """points (with x0, x1, ...) with re and im."""
        got = self.function(*map(F.col, self.names))
        re, im = got if isinstance(got, tuple) else (got, F.lit(0.0))
        return points.withColumns({"re": re.cast("double"), "im": im.cast("double")})

    @property
    def is_complex(self) -> bool:
        return isinstance(self.function(*(F.lit(0) for _ in self.names)), tuple)

    def sampled(self, regions: DataFrame, n: int, seed: int) -> DataFrame:
        """fixed, p, x0, ...: n seeded points of each region."""
        drawn = regions.select("fixed", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("p"))
        at = lambda k, d: F.when(F.get("fixed", F.lit(k)) != FREE, F.get("fixed", F.lit(k))).otherwise(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "p", "fixed"), F.lit(d)))
        return drawn.select("fixed", "p", *(at(k, d).cast("long").alias(x) for k, (x, d) in enumerate(zip(self.names, self.tree.dims, strict=True))))

    def begin(self, regions: DataFrame, start: Sequence[Sequence[int]] = ()) -> None:
        """One pivot for each edge of a region: the largest of seeded points (and of start, which the region should hold)."""
        points = self.sampled(regions, SAMPLES, self.seed)
        for p in start:
            inside = F.lit(True)
            for k, c in enumerate(p):
                inside = inside & F.get("fixed", F.lit(k)).isin(FREE, int(c))
            points = points.unionByName(regions.where(inside).select("fixed", F.lit(-1).alias("p"), *(F.lit(int(c)).cast("long").alias(x) for x, c in zip(self.names, p, strict=True))))
        size = F.col("re") * F.col("re") + F.col("im") * F.col("im")
        best = self.values(points).groupBy("fixed").agg(F.max_by(F.array(*self.names), F.struct(size, *(-F.col(x) for x in self.names))).alias("x"), F.sqrt(F.max(size)).alias("scale"))
        halves = []
        for half in range(2 * len(self.tree.edges)):
            own = self.tree.members(half)
            halves.append(F.array(F.array(*(F.get("x", F.lit(k)) if k in own else F.lit(0).cast("long") for k in range(len(self.tree.dims))))))
        sets = F.array(*halves) if halves else F.array().cast("array<array<array<bigint>>>")
        errors = F.array(*(F.lit(math.inf) for _ in self.tree.edges)).cast("array<double>")
        self.state = cut_lineage(best.select("fixed", sets.alias("sets"), errors.alias("errors"), "scale", F.lit(not self.tree.edges).alias("found")))

    def update(self, edges: Sequence[int]) -> None:
        """New pivots for these edges, which share no vertex, in all regions that are not found yet: one job."""
        tree, proposer, seed, names = self.tree, self.proposer, self.seed + 1000 * self.rounds, self.names
        atol, rtol, most, n = self.atol, self.rtol, self.max_rank, len(self.tree.dims)
        members = {h: np.isin(np.arange(n), tree.members(h)) for e in edges for h in (2 * e, 2 * e + 1)}
        key = "fixed array<bigint>, edge int"

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    sets = _arrays(r["sets"])
                    for e in edges:
                        rows, cols = (proposed(tree, r["fixed"], sets, h, proposer, seed) for h in (2 * e, 2 * e + 1))
                        i, j = np.divmod(np.arange(len(rows) * len(cols)), len(cols))
                        yield _points(r["fixed"], e, i, j, rows[i] + cols[j], names)

        def chosen(table: pa.Table) -> pa.Table:
            e, (i, j, a, x) = table.column("edge")[0].as_py(), _matrix(table, names)
            rows, cols, error = eliminate(a, atol, rtol, most)
            left, right = (np.where(members[h], x[at], 0).tolist() for h, at in ((2 * e, [(k, 0) for k in rows]), (2 * e + 1, [(0, k) for k in cols])) for at in [tuple(zip(*at, strict=True))])
            return pa.Table.from_pylist([{"fixed": table.column("fixed")[0].as_py(), "edge": e, "left": left, "right": right, "error": error, "most": float(np.abs(a).max())}], schema=_CHOSEN)

        open_ = self.state.where("not found")
        points = open_.select("fixed", "sets").mapInArrow(pairs, f"{key}, i bigint, j bigint, " + ", ".join(f"{x} bigint" for x in names))
        new = self.values(points).groupBy("fixed", "edge").applyInArrow(chosen, f"{key}, left array<array<bigint>>, right array<array<bigint>>, error double, most double")
        new = new.groupBy("fixed").agg(F.map_from_entries(F.collect_list(F.struct("edge", F.struct("left", "right", "error", "most")))).alias("new"))
        got = lambda e, part: F.col("new")[F.lit(e)][part]
        sets = [F.coalesce(got(h // 2, ("left", "right")[h % 2]), F.get("sets", F.lit(h))) for h in range(2 * len(tree.edges))]
        errors = [F.coalesce(got(e, "error"), F.get("errors", F.lit(e))) for e in range(len(tree.edges))]
        scale = F.greatest("scale", *(F.coalesce(got(e, "most"), F.lit(0.0)) for e in edges))
        joined = self.state.join(new, "fixed", "left")
        self.state = cut_lineage(joined.select("fixed", F.array(*sets).alias("sets"), F.array(*errors).alias("errors"), scale.alias("scale"), "found"))

    def sweep(self) -> bool:
        """Updates of all edges, colour by colour; have all regions been found, their errors small and their ranks as before?"""
        ranks = F.transform("sets", lambda s: F.size(s))
        before = self.state.select("fixed", ranks.alias("before"))
        for edges in self.tree.colours():
            self.rounds += 1
            self.update(edges)
        small = F.col("worst") <= F.greatest(F.lit(self.atol), F.col("scale") * self.rtol)
        full = F.array_max(ranks) >= self.max_rank
        same = (F.col("before") == ranks) if self.proposer == DEFAULT else F.lit(True)  # sampled candidates need not give the same ranks again
        now = self.state.withColumn("worst", F.array_max("errors")).join(before, "fixed")
        self.state = cut_lineage(now.withColumn("found", F.col("found") | (same & (small | full))).drop("before", "worst"))
        seen = self.state.agg(F.max(F.array_max(ranks)).alias("rank"), F.max(F.array_max("errors") / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)).alias("error"), F.count_if(~F.col("found")).alias("open")).first()
        self.ranks.append(seen.rank or 1), self.errors.append(seen.error or 0.0)
        return not seen.open

    def cores(self, root: int) -> DataFrame:
        """fixed, vertex, shape, core: for each region the values at pivots, times the inverse of the pivots' square; one job.

        Axes are the vertex' coordinate, the bonds to its neighbours away from the root in their order, and that towards it.
        """
        tree, names, n = self.tree, self.names, len(self.tree.dims)
        walk = tree.walk(root)

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    sets = _arrays(r["sets"])
                    for v, _, e in walk:
                        below = [sets[tree.half(w, f)] for w, f in tree.around(v) if f != e]
                        rows = combined([local_values(tree, r["fixed"], v), *below])
                        shape = [1 if r["fixed"][v] != FREE else tree.dims[v], *(len(b) for b in below)]
                        above = sets[tree.half(v, e) ^ 1] if e is not None else np.zeros((1, n), np.int64)
                        i, j = np.divmod(np.arange(len(rows) * len(above)), len(above))
                        yield _points(r["fixed"], v, i, j, rows[i] + above[j], names, shape)
                        if e is not None:  # the square stands below the rows, at negative numbers
                            own = sets[tree.half(v, e)]
                            i, j = np.divmod(np.arange(len(own) * len(above)), len(above))
                            yield _points(r["fixed"], v, -1 - i, j, own[i] + above[j], names, shape)

        rich = self.is_complex

        def solved(table: pa.Table) -> pa.Table:
            i, v = np.asarray(table.column("i")), table.column("edge")[0].as_py()
            shape = table.column("shape")[0].as_py()
            body, square = table.filter(pa.array(i >= 0)), table.filter(pa.array(i < 0))
            a = _matrix(body, names)[2]
            if len(square):
                square = square.set_column(square.schema.get_field_index("i"), "i", pa.array(-1 - np.asarray(square.column("i"))))
                p = _matrix(square, names)[2]
                a = np.linalg.lstsq(p.T, a.T, rcond=None)[0].T
            a = np.ascontiguousarray(a, complex if rich else float) if rich else np.ascontiguousarray(a.real)
            return pa.Table.from_pylist([{"fixed": table.column("fixed")[0].as_py(), "vertex": v, "shape": [*shape, a.shape[1]], "core": a.tobytes()}], schema=_CORE)

        points = self.state.select("fixed", "sets").mapInArrow(wanted, "fixed array<bigint>, edge int, i bigint, j bigint, " + ", ".join(f"{x} bigint" for x in names) + ", shape array<bigint>")
        return cut_lineage(self.values(points).groupBy("fixed", "edge").applyInArrow(solved, "fixed array<bigint>, vertex int, shape array<bigint>, core binary"))

    def sampled_errors(self, cores: DataFrame, root: int, seed: int, n: int = SAMPLES) -> DataFrame:
        """fixed, error, x: the largest difference from function at n seeded points of each region, and where."""
        points = self.values(self.sampled(self.state, n, seed))
        tree, names, rich, walk = self.tree, self.names, self.is_complex, self.tree.walk(root)

        def judged(a: pa.Table, b: pa.Table) -> pa.Table:
            x = np.stack([np.asarray(a.column(c)) for c in names], 1)
            fixed = a.column("fixed")[0].as_py()
            known, own = {}, {r["vertex"]: np.frombuffer(r["core"], complex if rich else float).reshape(r["shape"]) for r in b.to_pylist()}
            for v, _, e in walk:
                t = own[v][x[:, v] if fixed[v] == FREE else np.zeros(len(x), np.int64)]
                for w, f in tree.around(v):
                    if f != e:
                        t = np.einsum("pa,pa...->p...", known[w], t)
                known[v] = t
            off = np.abs(known[walk[-1][0]][:, 0] - (np.asarray(a.column("re")) + 1j * np.asarray(a.column("im"))))
            at = int(off.argmax())
            return pa.Table.from_pylist([{"fixed": fixed, "error": float(off[at]), "x": x[at].tolist()}], schema=pa.schema([("fixed", pa.list_(pa.int64())), ("error", pa.float64()), ("x", pa.list_(pa.int64()))]))

        other = cores.select(F.col("fixed").alias("region"), "vertex", "shape", "core")
        return points.groupBy("fixed").cogroup(other.groupBy("region")).applyInArrow(judged, "fixed array<bigint>, error double, x array<bigint>")

    def add_pivots(self, found: DataFrame) -> None:
        """A further pivot on each half of each edge of the regions in found (fixed, x), which are open again."""
        n = len(self.tree.dims)
        joined = self.state.join(found.select("fixed", "x"), "fixed", "left")
        halves = []
        for half in range(2 * len(self.tree.edges)):
            own = self.tree.members(half)
            new = F.array(F.array(*(F.get("x", F.lit(k)) if k in own else F.lit(0).cast("long") for k in range(n))))
            halves.append(F.when(F.col("x").isNull(), F.get("sets", F.lit(half))).otherwise(F.array_union(F.get("sets", F.lit(half)), new)))
        self.state = cut_lineage(joined.select("fixed", F.array(*halves).alias("sets") if halves else "sets", "errors", "scale", (F.col("found") & F.col("x").isNull()).alias("found")))


_CHOSEN = pa.schema([("fixed", pa.list_(pa.int64())), ("edge", pa.int32()), ("left", pa.list_(pa.list_(pa.int64()))), ("right", pa.list_(pa.list_(pa.int64()))), ("error", pa.float64()), ("most", pa.float64())])
_CORE = pa.schema([("fixed", pa.list_(pa.int64())), ("vertex", pa.int32()), ("shape", pa.list_(pa.int64())), ("core", pa.binary())])


def _points(fixed: list[int], edge: int, i: np.ndarray, j: np.ndarray, x: np.ndarray, names: Sequence[str], shape: list[int] | None = None) -> pa.RecordBatch:
    n = len(x)
    same = lambda v, kind: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(v), pa.int32()), pa.array(np.tile(np.array(v, np.int64), n), kind))
    columns = [same(fixed, pa.int64()), pa.array(np.full(n, edge), pa.int32()), pa.array(i, pa.int64()), pa.array(j, pa.int64()), *(pa.array(x[:, k], pa.int64()) for k in range(x.shape[1]))]
    more = [same(shape, pa.int64())] if shape else []
    return pa.RecordBatch.from_arrays(columns + more, names=["fixed", "edge", "i", "j", *names] + ["shape"] * len(more))


def _matrix(table: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """i, j, the matrix of values, and the point at each entry."""
    i, j = np.asarray(table.column("i")), np.asarray(table.column("j"))
    re, im = (np.asarray(table.column(c), dtype=float) for c in ("re", "im"))
    if not (np.isfinite(re).all() and np.isfinite(im).all()):
        raise ValueError("the function has no finite value at a point")
    a = np.zeros((i.max() + 1, j.max() + 1), complex if im.any() else float)
    a[i, j] = re + 1j * im if im.any() else re
    x = np.zeros((*a.shape, len(names)), np.int64)
    x[i, j] = np.stack([np.asarray(table.column(c)) for c in names], 1)
    return i, j, a, x


def tree_cross_interpolate(
    spark: SparkSession, function: Callable[..., Column | tuple[Column, Column]], sites: Sequence[Index], edges: Sequence[tuple[int, int]], rtol: float = 1e-10, max_rank: int = 100,
    sweeps: int = 20, proposer: str = DEFAULT, start: Sequence[Sequence[int]] = (), root: int = 0, seed: int = 0, searches: int = 3,
) -> tuple[Network, TreeCross]:
    """function of a coordinate for each site, as a network on a tree of one vertex a site.

    Sweeps go on until errors are below rtol of the largest value and ranks stay; then seeded points are compared, and where
    the network is off the worst becomes a pivot and sweeps go on, at most searches times.
    """
    tree = Tree(tuple(s.dim for s in sites), tuple(tuple(e) for e in edges))
    cross = TreeCross(spark, function, tree, rtol=rtol, max_rank=max_rank, proposer=proposer, seed=seed)
    cross.begin(spark.range(1).select(F.array(*(F.lit(FREE).cast("long") for _ in sites)).alias("fixed")), start)
    for search in range(searches + 1):
        for _ in range(sweeps if tree.edges else 0):
            if cross.sweep():
                break
        cores = cross.cores(root)
        if search == searches or not tree.edges:
            break
        off = cut_lineage(cross.sampled_errors(cores, root, seed + 1 + search).join(cross.state.select("fixed", "scale"), "fixed").where(F.col("error") > 10 * rtol * F.col("scale")))
        if off.isEmpty():
            break
        cross.add_pivots(off)
    shapes = {r.vertex: r.shape for r in cores.select("vertex", "shape").collect()}
    links = {e: new_link(shapes[v][-1]) for v, _, e in tree.walk(root) if e is not None}
    tensors = {}
    for v, _, e in tree.walk(root):
        axes = [sites[v], *(links[f] for _, f in tree.around(v) if f != e), *([links[e]] if e is not None else [])]
        tensors[v] = _tensor(cores.where(F.col("vertex") == v), axes, cross.is_complex)
    return Network({v: tensors[v] for v in [*(u for u in tensors if u != root), root]}), cross


def _tensor(core: DataFrame, axes: Sequence[Index], rich: bool) -> Tensor:
    names = [i.column for i in axes]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["core"], complex if rich else float).reshape([i.dim for i in axes])
                at = np.nonzero(a)
                parts = [a[at].real, a[at].imag] if rich else [a[at]]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in at), *(pa.array(np.ascontiguousarray(p)) for p in parts)], names=[*names, "re", "im"][: len(names) + len(parts)])

    schema = ", ".join([*(f"`{c}` bigint" for c in names), "re double", *(["im double"] if rich else [])])
    return Tensor(cut_lineage(core.select("shape", "core").mapInArrow(entries, schema)), tuple(axes), rich)


def _taken(place: int, dim: int) -> Column:
    """The regions that fix one more coordinate, for each of its values."""
    one = lambda c: F.transform("fixed", lambda old, k: F.when(k == place, c).otherwise(old))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), one)


def adaptive_patches(
    spark: SparkSession, function: Callable[..., Column | tuple[Column, Column]], sites: Sequence[Index], order: Sequence[Index], rtol: float = 1e-8, max_rank: int = 20, sweeps: int = 8, seed: int = 0
) -> PatchedTrain:
    """function over a chain of sites as patches, each with bonds of at most max_rank.

    A worklist of regions is interpolated side by side. A region is done if its bonds needed less than max_rank and seeded
    points are within rtol of the largest value seen anywhere; else it is split along the next index of order. A region that
    fixes all of order keeps what it has.
    """
    n = len(sites)
    tree = Tree(tuple(s.dim for s in sites), tuple((k, k + 1) for k in range(n - 1)))
    layout_rich = TreeCross(spark, function, tree).is_complex
    layout = Layout(tuple((s,) for s in sites), tuple(order), layout_rich)
    places = layout.places
    now = spark.range(1).select(F.array(*(F.lit(FREE).cast("long") for _ in sites)).alias("fixed"))
    done, scale = None, 0.0
    pack = layout.pack

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("vertex")
        cores = []
        for r in table.to_pylist():
            a = np.frombuffer(r["core"], complex if layout_rich else float).reshape(r["shape"])
            cores.append(a[:, None, :] if a.ndim == 2 else a)
        row = pack(table.column("fixed")[0].as_py(), [np.moveaxis(c, 0, 1) for c in cores])
        return pa.Table.from_pylist([row], schema=pa.schema([("fixed", pa.list_(pa.int64())), ("bonds", pa.list_(pa.int64())), ("cores", pa.binary())]))

    while True:
        cross = TreeCross(spark, function, tree, rtol=rtol / 10, atol=rtol * scale / 10, max_rank=max_rank, seed=seed)
        cross.begin(now)
        for _ in range(sweeps if tree.edges else 0):
            if cross.sweep():
                break
        scale = max(scale, cross.state.agg(F.max("scale")).first()[0] or 0.0)
        cores = cross.cores(n - 1)
        errors = cross.sampled_errors(cores, n - 1, seed + 1).select("fixed", "error")
        rank = F.coalesce(F.array_max(F.transform("sets", lambda s: F.size(s))), F.lit(1))
        last = F.lit(True)
        for p in places:
            last = last & (F.get("fixed", F.lit(p)) != FREE)
        worst = F.greatest(F.col("error"), F.when(rank >= max_rank, F.coalesce(F.array_max("errors"), F.lit(0.0))).otherwise(0.0))
        judged = cut_lineage(cross.state.join(errors, "fixed").select("fixed", ((worst <= rtol * scale) | last).alias("good")))
        settled = cores.join(judged.where("good").select("fixed"), "fixed").groupBy("fixed").applyInArrow(packed, SCHEMA)
        settled = cut_lineage(settled)
        done = settled if done is None else done.unionByName(settled)
        bad = judged.where("not good").select("fixed")
        if bad.isEmpty():
            return PatchedTrain(layout, done)
        # the first index of order that a region leaves free takes each of its coordinates
        split = F.lit(None).cast("array<array<bigint>>")
        for p in reversed(places):
            split = F.when(F.get("fixed", F.lit(p)) == FREE, _taken(p, layout.flat[p].dim)).otherwise(split)
        now = cut_lineage(bad.select(F.explode(split).alias("fixed")))
