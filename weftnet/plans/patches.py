"""Partitioned trains: disjoint regions of a tensor's coordinates, each with a train of its own.

A patch is a row: the coordinates that its region fixes, and the cores of its train, packed. What is done to a patch (orthogonal
sweeps, slices, products of two) is small dense algebra on its own cores, and all patches of a table are treated by one job:
numbers of jobs depend on how deep regions are nested, never on how many there are. A region fixes a beginning of the
partition's order of indices, so that two regions of a partition's order are nested or disjoint. A tolerance for the whole is dealt
out to patches by their volume.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..index import Index
from ..session import cut_lineage
from ..tensor import Tensor
from .network import Network

FREE = -1
#: Pieces that are added up in a call, values that a task unpacks at a time, stored rows that become one patch, points of a block.
FAN_IN, BLOCK_VALUES, PATCH_ROWS, POINTS = 8, 1 << 20, 512, 1 << 16
#: What a step that only tidies up may lose, as a share of the squared norm.
TIDY = 1e-30
SCHEMA = "fixed array<bigint>, bonds array<bigint>, cores binary"

Cores = list[np.ndarray]


def sweep(cores: Cores) -> Cores:
    """The same train with all cores but the last isometric."""
    out = list(cores)
    for k in range(len(out) - 1):
        l, d, r = out[k].shape  # noqa: E741
        q, x = np.linalg.qr(out[k].reshape(l * d, r))
        out[k], out[k + 1] = q.reshape(l, d, -1), np.tensordot(x, out[k + 1], 1)
    return out


def compress(cores: Cores, budget: float, cap: int | None = None) -> tuple[Cores, float]:
    """Bonds cut by singular values, losing at most budget (squared) unless cap asks for more; and what is lost."""
    out, lost = sweep(cores), 0.0
    share = budget / max(1, len(out) - 1)
    for k in range(len(out) - 1, 0, -1):
        l, d, r = out[k].shape  # noqa: E741
        u, s, v = np.linalg.svd(out[k].reshape(l, d * r), full_matrices=False)
        tail = np.append(np.cumsum((s**2)[::-1])[::-1], 0.0)  # tail[n]: what is lost with n values kept
        n = max(1, int(np.argmax(tail <= max(share, TIDY * tail[0]))))
        n = min(n, cap or n)
        lost += float(tail[n])
        out[k] = v[:n].reshape(n, d, r)
        out[k - 1] = np.tensordot(out[k - 1], u[:, :n] * s[:n], 1)
    return out, lost


def squared_norm(cores: Cores) -> float:
    return float(np.linalg.norm(sweep(cores)[-1]) ** 2)


def dot(a: Cores, b: Cores) -> complex:
    """Sum of conj(a) * b."""
    held = np.ones((1, 1))
    for p, q in zip(a, b, strict=True):
        held = np.einsum("ab,adc,bde->ce", held, p.conj(), q, optimize=True)
    return held[0, 0]


def total(a: Cores, b: Cores) -> Cores:
    """Bonds add up."""
    if len(a) == 1:
        return [a[0] + b[0]]
    out = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if k == 0:
            out.append(np.concatenate([x, y], 2))
        elif k == len(a) - 1:
            out.append(np.concatenate([x, y], 0))
        else:
            both = np.zeros((x.shape[0] + y.shape[0], x.shape[1], x.shape[2] + y.shape[2]), np.result_type(x, y))
            both[: x.shape[0], :, : x.shape[2]], both[x.shape[0] :, :, x.shape[2] :] = x, y
            out.append(both)
    return out


def train_of_rows(digits: np.ndarray, values: np.ndarray, dims: Sequence[int]) -> Cores:
    """A train of stored entries (digits by site, one row each), by one factorization for each bond."""
    cores, left = [], np.zeros((len(values), 1), values.dtype)
    left[:, 0] = 1.0
    # left[e] is entry e's vector over the bond so far; entries that agree in all later digits are one column
    rest, column = np.unique(digits, axis=0, return_inverse=True)
    weight = np.zeros((1, len(rest)), values.dtype)
    np.add.at(weight[0], column.ravel(), values)
    for k, d in enumerate(dims[:-1]):
        later, column = np.unique(rest[:, 1:], axis=0, return_inverse=True)
        a = np.zeros((weight.shape[0], d, len(later)), values.dtype)
        np.add.at(a, (slice(None), rest[:, 0], column.ravel()), weight)
        q, r = np.linalg.qr(a.reshape(-1, len(later))) if a.shape[0] * d >= len(later) else (np.eye(a.shape[0] * d, dtype=values.dtype), a.reshape(-1, len(later)))
        u, s, v = np.linalg.svd(r, full_matrices=False)
        n = max(1, int((s > 1e-15 * s[0]).sum()))
        cores.append((q @ u[:, :n]).reshape(weight.shape[0], d, n))
        weight, rest = s[:n, None] * v[:n], later
    last = np.zeros((weight.shape[0], dims[-1], 1), values.dtype)
    last[:, rest[:, 0], 0] = weight
    return [*cores, last]


@dataclass(frozen=True)
class Layout:
    """How a patch is packed: indices by site, the order in which regions fix them, and whether values are complex."""

    sites: tuple[tuple[Index, ...], ...]
    order: tuple[Index, ...]
    is_complex: bool = False

    @property
    def flat(self) -> list[Index]:
        return [i for s in self.sites for i in s]

    @property
    def places(self) -> list[int]:
        """Where each index of order stands in a region's list of fixed coordinates."""
        return [self.flat.index(i) for i in self.order]

    def dims(self, fixed: Sequence[int]) -> list[list[int]]:
        at = iter(fixed)
        return [[i.dim if next(at) == FREE else 1 for i in s] for s in self.sites]

    def unpack(self, fixed: Sequence[int], bonds: Sequence[int], data: bytes) -> Cores:
        values, start, out = np.frombuffer(data, complex if self.is_complex else float), 0, []
        for k, own in enumerate(self.dims(fixed)):
            shape = ([1, *bonds, 1][k], math.prod(own), [1, *bonds, 1][k + 1])
            out.append(values[start : (start := start + math.prod(shape))].reshape(shape))
        return out

    def pack(self, fixed: Iterable[int], cores: Cores) -> dict:
        kind = complex if self.is_complex else float
        return {"fixed": [int(c) for c in fixed], "bonds": [c.shape[2] for c in cores[:-1]], "cores": b"".join(np.ascontiguousarray(c, kind).tobytes() for c in cores)}

    def volume(self, fixed: Sequence[int]) -> float:
        """A region's share of all coordinates."""
        return 1 / math.prod(i.dim for i, c in zip(self.flat, fixed, strict=True) if c != FREE)

    def sliced(self, fixed: Sequence[int], cores: Cores, index: int, at: int) -> tuple[list[int], Cores]:
        """A patch with one more coordinate fixed, by the index's place in the flat list."""
        out, n = list(cores), 0
        for k, own in enumerate(self.dims(fixed)):
            if n <= index < n + len(own):
                x = cores[k].reshape(cores[k].shape[0], *own, cores[k].shape[2])
                x = np.take(x, [at], 1 + index - n)
                out[k] = x.reshape(cores[k].shape[0], -1, cores[k].shape[2])
            n += len(own)
        return [at if p == index else c for p, c in enumerate(fixed)], out

    def embedded(self, fixed: Sequence[int], cores: Cores, region: Sequence[int]) -> Cores:
        """A patch's cores on a region that holds it; zero outside the patch."""
        out, n = [], 0
        wide, own = self.dims(region), self.dims(fixed)
        for k, (w, o) in enumerate(zip(wide, own, strict=True)):
            l, r = cores[k].shape[0], cores[k].shape[2]  # noqa: E741
            x = np.zeros((l, *w, r), cores[k].dtype)
            at = tuple(slice(None) if a == b else slice(c, c + 1) for a, b, c in zip(w, o, fixed[n : n + len(w)], strict=True))
            x[(slice(None), *at, slice(None))] = cores[k].reshape(l, *o, r)
            out.append(x.reshape(l, -1, r))
            n += len(w)
        return out


@dataclass(frozen=True)
class PatchedTrain:
    """A table of patches."""

    layout: Layout
    df: DataFrame

    @property
    def sites(self) -> tuple[tuple[Index, ...], ...]:
        return self.layout.sites

    @property
    def order(self) -> tuple[Index, ...]:
        return self.layout.order

    @property
    def flat(self) -> list[Index]:
        return self.layout.flat

    @property
    def is_complex(self) -> bool:
        return self.layout.is_complex

    def _map(self, f: Callable[[list[int], Cores], Iterable[dict]], schema: str = SCHEMA) -> DataFrame:
        """f for each patch, in one job; f gives rows."""
        unpack = self.layout.unpack
        kinds = self.df.sparkSession.createDataFrame([], schema).toArrow().schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.select(["fixed", "bonds", "cores"]).to_pylist():
                    out = list(f(r["fixed"], unpack(r["fixed"], r["bonds"], r["cores"])))
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=kinds)

        return self.df.mapInArrow(run, schema)

    def settled(self) -> PatchedTrain:
        return replace(self, df=cut_lineage(self.df))

    # -- what it holds ----------------------------------------------------------------------------

    def norm_squared(self) -> float:
        return self._map(lambda fixed, cores: [{"n": squared_norm(cores)}], "n double").agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0]

    def norm(self) -> float:
        return math.sqrt(self.norm_squared())

    def rank(self) -> int:
        return self.df.agg(F.coalesce(F.max(F.array_max("bonds")), F.lit(1))).first()[0]

    def to_tensor(self) -> Tensor:
        """All entries that are not zero; a patch is spelled out a block of coordinates at a time."""
        flat, rich, layout = self.flat, self.is_complex, self.layout

        def spelled(fixed: list[int], cores: Cores) -> Iterator[pa.RecordBatch]:
            dims = [d for own in layout.dims(fixed) for d in own]
            todo = [(0, np.zeros(1, np.int64), np.ones((1, 1)))]
            while todo:
                k, code, left = todo.pop()
                if k < len(cores):
                    d, r = cores[k].shape[1:]
                    most = max(1, BLOCK_VALUES // (d * r))
                    for start in range(0, len(code), most):
                        part = code[start : start + most]
                        x = np.tensordot(left[start : start + most], cores[k], 1).reshape(-1, r)
                        todo.append((k + 1, (part[:, None] * d + np.arange(d)).ravel(), x))
                    continue
                value = left[:, 0]
                keep = np.flatnonzero(value)
                if len(keep):
                    at = np.unravel_index(code[keep], dims)
                    at = [np.full(len(keep), c) if c != FREE else x for c, x in zip(fixed, at, strict=True)]
                    values = [value[keep].real, value[keep].imag] if rich else [value[keep].real]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in at), *(pa.array(np.ascontiguousarray(x)) for x in values)], names=[*(i.column for i in flat), "re", "im"][: len(flat) + len(values)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield from spelled(row["fixed"], layout.unpack(row["fixed"], row["bonds"], row["cores"]))

        schema = ", ".join([*(f"`{i.column}` bigint" for i in flat), "re double", *(["im double"] if rich else [])])
        return Tensor(self.df.select("fixed", "bonds", "cores").mapInArrow(run, schema), tuple(flat), rich)

    def _prefix(self, column: str = "fixed") -> Column:
        """The coordinates that a region fixes, in order."""
        every = F.array(*(F.get(column, F.lit(p)) for p in self.layout.places))
        return F.filter(every, lambda c: c != FREE)

    def evaluate(self, points: DataFrame, point: str = "point") -> DataFrame:
        """point, re (and im) for each row of points, 0 where no patch is. Points meet their patch by the coordinates it fixes; a
        patch with many points is dealt out in blocks of them."""
        rich, flat = self.is_complex, self.flat
        patches = self.df.select("fixed", "bonds", "cores", self._prefix().alias("prefix"))
        depths = sorted(r.n for r in patches.select(F.size("prefix").alias("n")).distinct().collect())  # at most one for each index
        columns = [i.column for i in self.order]
        at = points.select(point, *(i.column for i in flat), F.explode(F.array(*(F.array(*(F.col(c) for c in columns[:n])).cast("array<bigint>") for n in depths))).alias("prefix")) if depths else points.select(point, *(i.column for i in flat), F.array().cast("array<bigint>").alias("prefix"))
        known = patches.select("prefix")
        at = at.join(known, "prefix", "left_semi")
        blocks = at.groupBy("prefix").agg((F.floor(F.count("*") / POINTS) + 1).alias("blocks"))
        at = at.join(blocks, "prefix").withColumn("block", F.pmod(F.xxhash64(point), F.col("blocks"))).drop("blocks")
        spread = patches.join(blocks, "prefix").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        spread = spread.select("fixed", "bonds", "cores", F.col("prefix").alias("own"), F.col("block").alias("part"))  # names of their own
        unpack, dims_of = self.layout.unpack, self.layout.dims
        kind = points.schema[point].dataType.simpleString()

        def values(a: pa.Table, b: pa.Table) -> pa.Table:
            out = np.zeros(len(a), complex if rich else float)
            for r in b.to_pylist():
                cores, n = unpack(r["fixed"], r["bonds"], r["cores"]), 0
                left, fine = np.ones((len(a), 1)), np.ones(len(a), bool)
                for core, own in zip(cores, dims_of(r["fixed"]), strict=True):
                    code = np.zeros(len(a), np.int64)
                    for index, d in zip(flat[n : n + len(own)], own, strict=True):
                        c = np.asarray(a.column(index.column)).astype(np.int64)
                        fine &= (c >= 0) & (c < index.dim)
                        code = code * d + (np.clip(c, 0, index.dim - 1) if d == index.dim else 0)
                    n += len(own)
                    new = np.zeros((len(a), core.shape[2]), out.dtype)
                    for d in np.unique(code):
                        new[code == d] = left[code == d] @ core[:, d]
                    left = new
                out += np.where(fine, left[:, 0], 0)
            parts = [out.real, out.imag] if rich else [out]
            return pa.table([a.column(point).combine_chunks(), *(pa.array(np.ascontiguousarray(x)) for x in parts)], names=[point, "re", "im"][: 2 + rich])

        got = at.groupBy("prefix", "block").cogroup(spread.groupBy("own", "part")).applyInArrow(values, f"`{point}` {kind}, re double" + (", im double" if rich else ""))
        return points.select(point).join(got, point, "left").select(point, *(F.coalesce(v, F.lit(0.0)).alias(v) for v in (["re", "im"] if rich else ["re"])))

    # -- truncation and patching -------------------------------------------------------------------

    def truncate_adaptive(self, rtol: float, max_bond: int | None = None) -> PatchedTrain:
        """Bonds cut so that the whole loses at most rtol of its norm; patches share the budget by volume.

        With max_bond, a patch that still has larger bonds is split along the next index of order, and its parts are cut in its
        place, until all fit or no index is left; so the budget holds with the cap, too. Patches of zeros are left out.
        """
        if rtol < 0 or (max_bond is not None and max_bond < 1):
            raise ValueError("negative tolerance or no dimension left")
        budget, layout = rtol**2 * self.norm_squared(), self.layout
        places, dims = layout.places, [i.dim for i in layout.flat]

        def cut(fixed: list[int], cores: Cores) -> Iterable[dict]:
            free = [p for p in places if fixed[p] == FREE]
            short, _ = compress(cores, budget * layout.volume(fixed))
            over = max_bond is not None and max((c.shape[2] for c in short[:-1]), default=1) > max_bond and bool(free)
            if not over:
                return [layout.pack(fixed, short) | {"over": False}] if np.any(short[-1]) and squared_norm(short) > 0 else []
            parts = (layout.sliced(fixed, cores, free[0], at) for at in range(dims[free[0]]))
            return [layout.pack(f, c) | {"over": True} for f, c in parts if squared_norm(c) > 0]

        done, now = None, self
        while True:
            judged = cut_lineage(now._map(cut, SCHEMA + ", over boolean"))
            settled = judged.where("not over").drop("over")
            done = settled if done is None else done.unionByName(settled)
            now = replace(self, df=judged.where("over").drop("over"))
            if now.df.isEmpty():
                return replace(self, df=done)

    def split(self, depth: int) -> PatchedTrain:
        """Regions that fix at least depth indices of order, one job for each; parts of zeros, and of what rounding leaves of them, are left out."""
        layout, dims = self.layout, [i.dim for i in self.layout.flat]

        def parted(at: int) -> Callable[[list[int], Cores], Iterable[dict]]:
            def run(fixed: list[int], cores: Cores) -> Iterable[dict]:
                if fixed[at] != FREE:
                    return [layout.pack(fixed, cores)]
                parts, least = (layout.sliced(fixed, cores, at, c) for c in range(dims[at])), TIDY * squared_norm(cores)
                return [layout.pack(f, compress(c, 0.0)[0]) for f, c in parts if squared_norm(c) > least]

            return run

        out = self
        for at in layout.places[:depth]:
            out = replace(self, df=cut_lineage(out._map(parted(at))))
        return out

    def relabelled(self, names: dict[Index, Index]) -> PatchedTrain:
        """Other indices of the same dimensions in their places."""
        new = lambda own: tuple(names.get(i, i) for i in own)
        if any(a.dim != b.dim for a, b in names.items()):
            raise ValueError("dimensions differ")
        return replace(self, layout=replace(self.layout, sites=tuple(map(new, self.sites)), order=new(self.order)))

    def restrict(self, at: dict[Index, int]) -> PatchedTrain:
        """Only what lies at fixed coordinates; the indices stay. Patches elsewhere are not unpacked."""
        layout = self.layout
        wanted = {self.flat.index(i): c for i, c in at.items()}
        meets = F.lit(True)
        for p, c in wanted.items():
            meets = meets & F.get("fixed", F.lit(p)).isin(FREE, c)

        def cut(fixed: list[int], cores: Cores) -> Iterable[dict]:
            masked = fixed
            part = cores
            for p, c in wanted.items():
                if masked[p] == FREE:
                    masked, part = layout.sliced(masked, part, p, c)
            return [layout.pack(fixed, layout.embedded(masked, part, fixed))]

        return replace(self, df=replace(self, df=self.df.where(meets))._map(cut))

    # -- algebra -----------------------------------------------------------------------------------

    def scale(self, a: complex) -> PatchedTrain:
        if isinstance(a, complex) and a.imag and not self.is_complex:
            return self.to_complex().scale(a)
        factor, layout = a if self.is_complex else float(a.real), self.layout
        return replace(self, df=self._map(lambda fixed, cores: [layout.pack(fixed, [cores[0] * factor, *cores[1:]])]))

    def to_complex(self) -> PatchedTrain:
        if self.is_complex:
            return self
        rich = replace(self.layout, is_complex=True)
        return PatchedTrain(rich, self._map(lambda fixed, cores: [rich.pack(fixed, cores)]))

    def add(self, other: PatchedTrain) -> PatchedTrain:
        """Sums where regions meet: nested regions become one patch, on the larger one."""
        if self.sites != other.sites or self.order != other.order:
            raise ValueError("sites or orders differ")
        a, b = (self.to_complex(), other.to_complex()) if self.is_complex != other.is_complex else (self, other)
        return replace(a, df=a.df.unionByName(b.df)).summed()

    def summed(self) -> PatchedTrain:
        """Patches whose regions may meet, added up until none do. In a round, up to about FAN_IN pieces of a region become one."""
        pieces = self.df.select("fixed", "bonds", "cores", self._prefix().alias("prefix"))
        pieces = cut_lineage(pieces.withColumn("piece", F.xxhash64("fixed", "bonds", "cores")))
        known = pieces.select("prefix").distinct()
        above = known.select("prefix", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("prefix")), lambda n: F.slice("prefix", F.lit(1), n))).alias("n", "root"))
        # the largest region of a piece's regions that is itself there
        roots = above.join(known.select(F.col("prefix").alias("root")), "root").groupBy("prefix").agg(F.min_by("root", "n").alias("root"))
        pieces = cut_lineage(pieces.join(roots, "prefix").drop("prefix"))
        layout = self.layout
        places, width = layout.places, len(layout.flat)

        def merge(table: pa.Table) -> pa.Table:
            root = table.column("root")[0].as_py()
            region = [FREE] * width
            for p, c in zip(places, root, strict=False):
                region[p] = c
            sum_ = None
            for r in table.select(["fixed", "bonds", "cores"]).to_pylist():
                x = layout.embedded(r["fixed"], layout.unpack(r["fixed"], r["bonds"], r["cores"]), region)
                sum_ = x if sum_ is None else compress(total(sum_, x), 0.0)[0]
            row = layout.pack(region, sum_) | {"root": root, "piece": table.column("chunk")[0].as_py()}
            return pa.Table.from_pylist([row], schema=pa.schema([("root", pa.list_(pa.int64())), ("fixed", pa.list_(pa.int64())), ("bonds", pa.list_(pa.int64())), ("cores", pa.binary()), ("piece", pa.int64())]))

        while True:
            sizes = cut_lineage(pieces.groupBy("root").agg(F.count("*").alias("n")))
            if sizes.where("n > 1").isEmpty():
                # a lone piece may still have been merged on its root's region already, or lie there itself
                return replace(self, df=pieces.select("fixed", "bonds", "cores"))
            tagged = pieces.join(sizes, "root")
            chunked = tagged.where("n > 1").withColumn("chunk", F.pmod(F.xxhash64("piece", F.lit(7)), F.ceil(F.col("n") / FAN_IN)))
            merged = chunked.groupBy("root", "chunk").applyInArrow(merge, f"root array<bigint>, {SCHEMA}, piece bigint")
            pieces = cut_lineage(tagged.where("n = 1").select(*merged.columns).unionByName(merged))

    def contract(self, other: PatchedTrain, order: Sequence[Index] | None = None) -> PatchedTrain:
        """Sum over the indices that both share, site by site; patches meet where no shared index has two values.

        Regions of the result fix a beginning of order (that of self's and other's remaining indices unless given); a product
        that fixes a later index is split along those before it. Products are added up where they meet.
        """
        return self.pieces(other, order).summed()

    def pieces(self, other: PatchedTrain, order: Sequence[Index] | None = None) -> PatchedTrain:
        """The products of patches that contract adds up, still apart: regions may meet."""
        shared = [i for i in self.flat if i in other.flat]
        sites = tuple(tuple([i for i in a if i not in shared] + [i for i in b if i not in shared]) for a, b in zip(self.sites, other.sites, strict=True))
        order = tuple(order or [i for i in [*self.order, *other.order] if i not in shared])
        if any((i in a) != (i in b) for i in shared for a, b in zip(self.sites, other.sites, strict=True)):
            raise ValueError("a shared index stands at two sites")
        a, b = (self.to_complex(), other.to_complex()) if self.is_complex != other.is_complex else (self, other)
        x, y, out = a.layout, b.layout, Layout(sites, order, a.is_complex)
        pairs = _meeting(a, b, shared)
        kinds = pa.schema([("fixed", pa.list_(pa.int64())), ("bonds", pa.list_(pa.int64())), ("cores", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    rows = [out.pack(f, c) for f, c in _products(x, y, out, shared, r)]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)

        return PatchedTrain(out, pairs.mapInArrow(run, SCHEMA))

    def contract_adaptive(self, other: PatchedTrain, rtol: float, max_bond: int | None = None, order: Sequence[Index] | None = None) -> PatchedTrain:
        """The product, cut so that it loses at most rtol of its own norm, in patches whose bonds are at most max_bond."""
        return self.contract(other, order).truncate_adaptive(rtol, max_bond)

    def inner(self, other: PatchedTrain) -> complex:
        """Sum of conj(self) * other; only patches that meet are joined."""
        a, b = (self.to_complex(), other.to_complex()) if self.is_complex != other.is_complex else (self, other)
        shared, left, right = self.flat, a.layout, b.layout

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    x, y = _common(left, right, shared, r)
                    value = dot(x[1], y[1])
                    yield pa.RecordBatch.from_pydict({"re": [float(value.real)], "im": [float(np.imag(value))]})

        row = _meeting(a, b, shared).mapInArrow(run, "re double, im double").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("re", "im"))).first()
        return complex(row.re, row.im) if a.is_complex else row.re


def stacked(parts: Sequence[PatchedTrain], index: Index) -> PatchedTrain:
    """Trains side by side along an index in front, which all patches fix."""
    if any(p.sites != parts[0].sites or p.order != parts[0].order for p in parts):
        raise ValueError("sites or orders differ")
    rich = any(p.is_complex for p in parts)
    first, df = parts[0].layout, None
    for k, p in enumerate(parts):
        part = (p.to_complex() if rich else p).df.select(F.concat(F.array(F.lit(k).cast("bigint")), "fixed").alias("fixed"), "bonds", "cores")
        df = part if df is None else df.unionByName(part)
    return PatchedTrain(Layout(((index, *first.sites[0]), *first.sites[1:]), (index, *first.order), rich), df)


def inner_each(stack: PatchedTrain, other: PatchedTrain) -> np.ndarray:
    """The inner products of a stack's trains with another one, in one job: a number for each train."""
    a, b = (stack.to_complex(), other.to_complex()) if stack.is_complex != other.is_complex else (stack, other)
    shared, left, right = b.flat, a.layout, b.layout

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            values = np.array([dot(x[1], y[1]) for x, y in (_common(left, right, shared, r) for r in rows)], complex)
            yield pa.RecordBatch.from_arrays([pa.array([r["a_fixed"][0] for r in rows], pa.int64()), pa.array(values.real.copy()), pa.array(values.imag.copy())], names=["k", "re", "im"])

    out = np.zeros(stack.order[0].dim, complex)
    for r in _meeting(a, b, shared).mapInArrow(run, "k bigint, re double, im double").groupBy("k").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).collect():  # a row a train
        out[r.k] = complex(r.re, r.im)
    return out


def weighted(stack: PatchedTrain, weights: Sequence[complex], more: PatchedTrain | None = None) -> PatchedTrain:
    """A stack's trains times weights, and more, still apart: regions may meet."""
    w = np.asarray(weights)
    if np.iscomplexobj(w) and not np.any(w.imag):
        w = w.real
    rich = np.iscomplexobj(w) or stack.is_complex or (more is not None and more.is_complex)
    sites, order = (stack.sites[0][1:], *stack.sites[1:]), stack.order[1:]
    if more is not None and (more.sites != sites or more.order != order):
        raise ValueError("sites or orders differ")
    out = Layout(sites, order, rich)
    df = stack._map(lambda fixed, cores: [out.pack(fixed[1:], [cores[0] * w[fixed[0]], *cores[1:]])] if w[fixed[0]] else [])
    if more is not None:
        df = df.unionByName((more.to_complex() if rich else more).df.select("fixed", "bonds", "cores"))
    return PatchedTrain(out, df)


def _meeting(a: PatchedTrain, b: PatchedTrain, shared: Sequence[Index]) -> DataFrame:
    """Pairs of patches (a_fixed, ..., b_fixed, ...) that agree wherever both fix a shared index: an equi-join.

    Which shared indices a patch fixes is one of a few masks, at most one for each length of beginning; a patch is written
    once for each mask of the other side, with what it fixes of that mask as its key.
    """
    sides = []
    for t, name in ((a, "a"), (b, "b")):
        at = F.array(*(F.get("fixed", F.lit(t.flat.index(i))) for i in shared)).cast("array<bigint>")
        sides.append(t.df.select(*(F.col(c).alias(f"{name}_{c}") for c in ("fixed", "bonds", "cores")), at.alias(f"{name}_at")).withColumn(f"{name}_mask", F.transform(f"{name}_at", lambda c: c != FREE)))
    left, right = sides
    masks = [[r.mask for r in side.select(F.col(f"{n}_mask").alias("mask")).distinct().collect()] for side, n in ((left, "a"), (right, "b"))]

    def keyed(side: DataFrame, mine: str, theirs: str, other: list) -> DataFrame:
        if not other:
            return side.withColumn(f"{theirs}_mask", F.array().cast("array<boolean>")).withColumn("key", F.array().cast("array<bigint>")).where("false")
        masks_ = F.array(*(F.array(*(F.lit(x) for x in m)).cast("array<boolean>") for m in other))
        out = side.withColumn(f"{theirs}_mask", F.explode(masks_))
        both = F.zip_with(F.zip_with(f"{mine}_mask", f"{theirs}_mask", lambda x, y: x & y), f"{mine}_at", lambda m, c: F.when(m, c).otherwise(F.lit(FREE)))
        return out.withColumn("key", both)

    left, right = keyed(left, "a", "b", masks[1]), keyed(right, "b", "a", masks[0])
    joined = left.join(right, ["a_mask", "b_mask", "key"])
    return joined.select(*(f"{n}_{c}" for n in "ab" for c in ("fixed", "bonds", "cores")))


def _common(a: Layout, b: Layout, shared: Sequence[Index], r: dict) -> tuple[tuple[list[int], Cores], tuple[list[int], Cores]]:
    """Both patches of a pair, with a shared index that one fixes fixed in the other as well."""
    x = (r["a_fixed"], a.unpack(r["a_fixed"], r["a_bonds"], r["a_cores"]))
    y = (r["b_fixed"], b.unpack(r["b_fixed"], r["b_bonds"], r["b_cores"]))
    for i in shared:
        p, q = a.flat.index(i), b.flat.index(i)
        if x[0][p] == FREE and y[0][q] != FREE:
            x = a.sliced(*x, p, y[0][q])
        elif y[0][q] == FREE and x[0][p] != FREE:
            y = b.sliced(*y, q, x[0][p])
    return x, y


def _products(a: Layout, b: Layout, out: Layout, shared: Sequence[Index], r: dict) -> Iterator[tuple[list[int], Cores]]:
    """The product of a pair of patches, split so that it fixes a beginning of the result's order."""
    (af, ac), (bf, bc) = _common(a, b, shared, r)
    letters = {i: chr(ord("A") + k) for k, i in enumerate(dict.fromkeys([*a.flat, *b.flat]))}
    carry = np.ones((1, 1, 1))
    cores = []
    for k, (own, si, sj) in enumerate(zip(out.sites, a.sites, b.sites, strict=True)):
        x = ac[k].reshape(ac[k].shape[0], *a.dims(af)[k], ac[k].shape[2])
        y = bc[k].reshape(bc[k].shape[0], *b.dims(bf)[k], bc[k].shape[2])
        name = lambda s: "".join(letters[i] for i in s)
        z = np.einsum(f"xab,a{name(si)}c,b{name(sj)}d->x{name(own)}cd", carry, x, y, optimize=True)
        l, c, d = z.shape[0], z.shape[-2], z.shape[-1]  # noqa: E741
        z = z.reshape(l, -1, c * d)
        if k == len(out.sites) - 1:
            cores.append(z)
        else:  # bonds stay as small as what lies to their left
            q, rest = np.linalg.qr(z.reshape(-1, c * d))
            cores.append(q.reshape(l, z.shape[1], -1))
            carry = rest.reshape(-1, c, d)
    cores, _ = compress(cores, 0.0)
    known = {i: c for t, f in ((a, af), (b, bf)) for i, c in zip(t.flat, f, strict=True)}
    fixed = [known[i] for i in out.flat]
    places = out.places
    deep = max((n for n, p in enumerate(places) if fixed[p] != FREE), default=-1)
    missing = [p for p in places[: deep + 1] if fixed[p] == FREE]
    for at in product(*(range(out.flat[p].dim) for p in missing)):
        part = (fixed, cores)
        for p, c in zip(missing, at, strict=True):
            part = out.sliced(*part, p, c)
        if squared_norm(part[1]) > 0:
            yield part


def patched(t: Tensor, sites: Sequence[Sequence[Index]], order: Sequence[Index], depth: int = 0, rows: int | None = None) -> PatchedTrain:
    """A stored tensor as patches: regions fix at least depth indices of order, and more where one would hold over rows entries.

    Regions are found by counting, one job for each further index; then each region's entries are one group, which becomes a
    train. A region that fixes all of order is left as it is, so order should name enough indices.
    """
    sites, order = tuple(tuple(s) for s in sites), tuple(order)
    out, most = Layout(sites, order, t.is_complex), rows or PATCH_ROWS
    flat = out.flat
    if set(flat) != set(t.indices):
        raise ValueError("sites don't hold the tensor's indices")
    done, now = None, t.df.withColumn("prefix", F.array(*(F.col(i.column) for i in order[:depth])).cast("array<bigint>"))
    for n in range(depth, len(order) + 1):
        sizes = now.groupBy("prefix").count()
        full = cut_lineage(sizes.where(F.col("count") > most).select("prefix"))
        if n == len(order) or full.isEmpty():
            done = now if done is None else done.unionByName(now)
            break
        settled = now.join(full, "prefix", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        deeper = now.join(full, "prefix", "left_semi")
        now = cut_lineage(deeper.withColumn("prefix", F.concat("prefix", F.array(F.col(order[n].column).cast("bigint")))))
    places, rich = out.places, t.is_complex

    def build(table: pa.Table) -> pa.Table:
        fixed = [FREE] * len(flat)
        for p, c in zip(places, table.column("prefix")[0].as_py(), strict=False):
            fixed[p] = c
        digits, n = [], 0
        dims = out.dims(fixed)
        for s, own in zip(sites, dims, strict=True):
            code = np.zeros(len(table), np.int64)
            for i, d in zip(s, own, strict=True):
                code = code * d + (np.asarray(table.column(i.column)) if fixed[n] == FREE else 0)
                n += 1
            digits.append(code)
        values = np.asarray(table.column("re")) + (1j * np.asarray(table.column("im")) if rich else 0)
        cores = train_of_rows(np.stack(digits, 1), values, [math.prod(d) for d in dims])
        return pa.Table.from_pylist([out.pack(fixed, cores)], schema=pa.schema([("fixed", pa.list_(pa.int64())), ("bonds", pa.list_(pa.int64())), ("cores", pa.binary())]))

    return PatchedTrain(out, cut_lineage(done.groupBy("prefix").applyInArrow(build, SCHEMA)))


#: Values that the cores of a train may have together to become one patch.
PATCH_VALUES = 1 << 24


def of_network(net: Network, sites: Sequence[Sequence[Index]], order: Sequence[Index]) -> PatchedTrain:
    """A chain as one patch, whose nodes hold the indices of sites; its cores meet in one task, so that their size is checked first."""
    sites = tuple(tuple(s) for s in sites)
    nodes = [net.find_node(s[0]) for s in sites]
    if len(set(nodes)) < len(nodes) or set(nodes) != set(net.tensors) or any(set(net.site_indices(n)) != set(s) for n, s in zip(nodes, sites, strict=True)):
        raise ValueError("nodes and sites differ")
    links, edges = [], net.edges()
    for a, b in zip(nodes[:-1], nodes[1:], strict=True):
        link = edges.get((a, b)) or edges.get((b, a))
        if link is None:
            raise ValueError("not a chain in the order of sites")
        links.append(link)
    rich = any(t.is_complex for t in net.tensors.values())
    out, bonds = Layout(sites, tuple(order), rich), [1, *(i.dim for i in links), 1]
    shapes = [(bonds[k], math.prod(i.dim for i in s), bonds[k + 1]) for k, s in enumerate(sites)]
    if sum(map(math.prod, shapes)) > PATCH_VALUES:
        raise ValueError("too large for one patch: truncate first")
    df = None
    for k, (node, own) in enumerate(zip(nodes, sites, strict=True)):
        t, code = net.tensors[node], F.lit(0).cast("bigint")
        for i in own:
            code = code * i.dim + F.col(i.column)
        ends = [F.col(links[j].column) if 0 <= j < len(links) else F.lit(0).cast("bigint") for j in (k - 1, k)]
        part = t.df.select(F.lit(k).alias("site"), ends[0].alias("l"), code.alias("c"), ends[1].alias("r"), F.col("re"), F.col("im") if t.is_complex else F.lit(0.0).alias("im"))
        df = part if df is None else df.unionByName(part)

    def build(table: pa.Table) -> pa.Table:
        at = [np.asarray(table.column(c)) for c in ("site", "l", "c", "r")]
        values = np.asarray(table.column("re")) + (1j * np.asarray(table.column("im")) if rich else 0)
        cores = []
        for k, shape in enumerate(shapes):
            mine, core = at[0] == k, np.zeros(shape, values.dtype)
            np.add.at(core, tuple(x[mine] for x in at[1:]), values[mine])
            cores.append(core)
        return pa.Table.from_pylist([out.pack([FREE] * len(out.flat), cores)], schema=pa.schema([("fixed", pa.list_(pa.int64())), ("bonds", pa.list_(pa.int64())), ("cores", pa.binary())]))

    return PatchedTrain(out, cut_lineage(df.withColumn("one", F.col("site") * 0).groupBy("one").applyInArrow(build, SCHEMA)))
