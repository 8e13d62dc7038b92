"""Values of chains at many points with the work of common parts shared."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..index import Index
from ..plans.network import CUT_EVERY, Network
from ..session import cut_lineage
from ..tensor import Tensor, contract_pair


#: Values of a network that is sent to every task, and of what a task holds for a block of points.
NETWORK_VALUES, BLOCK_VALUES = 1 << 22, 1 << 22


def dense(t: Tensor, indices: Sequence[Index]) -> np.ndarray:
    """A small tensor as an array with these axes."""
    got = t.df.select(*(i.column for i in indices), *t.values).toArrow()
    out = np.zeros([i.dim for i in indices], complex if t.is_complex else float)
    value = got["re"].to_numpy() + (1j * got["im"].to_numpy() if t.is_complex else 0)
    np.add.at(out, tuple(got[i.column].to_numpy() for i in indices), value)
    return out


def evaluate_points(net: Network, points: DataFrame, point: str = "point") -> DataFrame:
    """point, re (and im) for each row of points, which has a column for each external index; points are not shuffled.

    A network of at most NETWORK_VALUES values goes to every task, which takes its points a block at a time from the leaves to
    the root; of a block's points, each distinct assignment of a subtree is contracted once. Larger networks are joined.
    Coordinates outside their index give 0.
    """
    if sum(math.prod(i.dim for i in t.indices) for t in net.tensors.values()) > NETWORK_VALUES:
        return net.evaluate(points, point)
    order = net.walk(net.root)
    bonds = {frozenset(e): i for e, i in net.edges().items()}
    plan, rich = [], False
    for node, parent in order:
        children = [n for n, p in order if p == node]
        sites = net.site_indices(node)
        axes = [*sites, *(bonds[frozenset((node, c))] for c in children), *([bonds[frozenset((node, parent))]] if parent is not None else [])]
        a = dense(net.tensors[node], axes)
        rich = rich or np.iscomplexobj(a)
        a = a.reshape([math.prod(i.dim for i in sites), *a.shape[len(sites) :]] + ([1] if parent is None else []))
        plan.append((node, [(i.column, i.dim) for i in sites], children, a))
    shared = net.tensors[net.root].spark.sparkContext.broadcast(plan)
    root = net.root

    def values(block: pa.RecordBatch) -> np.ndarray:
        n = block.num_rows
        fine = np.ones(n, bool)
        known: dict = {}
        for node, sites, children, a in shared.value:
            code, step = np.zeros(n, np.int64), a.shape[0]
            for column, dim in sites:
                at = np.asarray(block.column(column)).astype(np.int64)
                fine &= (at >= 0) & (at < dim)
                step //= dim
                code += np.clip(at, 0, dim - 1) * step
            keys = [code, *(known[c][0] for c in children)]
            where, key = keys[0], keys[0]
            for k in keys[1:]:
                _, key = np.unique(key * (k.max(initial=0) + 1) + k, return_inverse=True)
            _, first, where = np.unique(key, return_index=True, return_inverse=True)
            out = np.zeros((len(first), a.shape[-1]), a.dtype if not rich else complex)
            digits = code[first]
            wide = max(1, BLOCK_VALUES // max(1, math.prod(a.shape[2:])))
            for d in np.unique(digits):
                own = np.flatnonzero(digits == d)
                for start in range(0, len(own), wide):
                    part = own[start : start + wide]
                    v = a[d][None] if not children else None
                    for c in children:
                        x = known[c][1][known[c][0][first[part]]]
                        v = np.tensordot(x, a[d], 1) if v is None else np.einsum("pa,pa...->p...", x, v)
                    out[part] = v
            known[node] = (where, out)
        where, out = known[root]
        return np.where(fine, out[where, 0], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = values(batch)
            parts = [got.real, got.imag] if rich else [got]
            yield pa.RecordBatch.from_arrays([batch.column(point), *(pa.array(np.ascontiguousarray(x)) for x in parts)], names=[point, "re", "im"][: 2 + rich])

    kind = points.schema[point].dataType.simpleString()
    return points.select(point, *(i.column for i in net.external_indices())).mapInArrow(run, f"`{point}` {kind}, re double" + (", im double" if rich else ""))


def _times(rich: bool) -> list[Column]:
    """Products of l's and r's values."""
    re, im = F.col("l.re") * F.col("r.re"), None
    if rich:
        re, im = re - F.col("l.im") * F.col("r.im"), F.col("l.re") * F.col("r.im") + F.col("l.im") * F.col("r.re")
    return [re.alias("re"), *([im.alias("im")] if rich else [])]


def _along(chain: Network) -> list:
    """Nodes of a chain from one end to the other, whatever their names; numbered ones from the lowest end."""
    ends = [n for n in chain.nodes if len(chain.neighbours(n)) < 2]
    first, last = (ends[0], ends[-1])
    try:
        first, last = min(first, last), max(first, last)
    except TypeError:
        pass
    return chain.path(first, last)


def _side(nodes: Sequence, chain: Network, points: DataFrame) -> tuple[DataFrame, list[str]]:
    """For the distinct coordinates that points has on these nodes' sites: a vector over the bond that leaves them."""
    sites = [i.column for n in nodes for i in chain.site_indices(n)]
    rows = points.select(*sites).distinct()
    held = None
    for k, n in enumerate(nodes):
        t = chain.tensors[n]
        rest = [i.column for i in t.indices if i.column not in sites]
        if held is None:
            held = rows.join(t.df, [i.column for i in chain.site_indices(n)]).select(*sites, *rest, *t.values)
        else:
            keys = [c for c in t.columns if c in held.columns]
            joined = held.alias("l").join(t.df.alias("r"), keys)
            keep = [c for c in rest if c not in keys]
            joined = joined.select(*sites, *keep, *_times(t.is_complex))
            held = joined.groupBy(*sites, *keep).agg(*(F.sum(v).alias(v) for v in t.values))
        if k % CUT_EVERY == CUT_EVERY - 1:
            held = cut_lineage(held)
    return held, sites


@dataclass
class CachedEvaluator:
    """Values of a chain: each distinct left part and right part of the points is contracted once, then both are joined.

    Parts that were seen before are kept as tables, so that later calls contract only what is new.
    """

    chain: Network
    cut: int | None = None
    left: DataFrame | None = field(default=None)
    right: DataFrame | None = field(default=None)

    @property
    def is_complex(self) -> bool:
        return any(t.is_complex for t in self.chain.tensors.values())

    @property
    def alike(self) -> Network:
        """The chain with all cores complex if one is."""
        return self.chain.map(Tensor.to_complex) if self.is_complex else self.chain

    @property
    def halves(self) -> tuple[list, list]:
        nodes = _along(self.chain)
        at = self.cut if self.cut is not None else (len(nodes) + 1) // 2
        return nodes[:at], nodes[at:][::-1]

    def evaluate_left(self, points: DataFrame) -> DataFrame:
        return self._seen("left", self.halves[0], points)

    def evaluate_right(self, points: DataFrame) -> DataFrame:
        return self._seen("right", self.halves[1], points)

    def _seen(self, side: str, nodes: Sequence, points: DataFrame) -> DataFrame:
        sites = [i.column for n in nodes for i in self.chain.site_indices(n)]
        known = getattr(self, side)
        new = points.select(*sites).distinct()
        new = new if known is None else new.join(known.select(*sites).distinct(), sites, "left_anti")
        found = _side(nodes, self.alike, new)[0]
        known = cut_lineage(found if known is None else known.unionByName(found))
        setattr(self, side, known)
        return known

    def evaluate(self, points: DataFrame, point: str = "point") -> DataFrame:
        """point, re (and im) for each row of points, which has a column for each site."""
        left, right = self.halves
        if not right:
            return self.chain.evaluate(points, point)
        a, b = self.evaluate_left(points), self.evaluate_right(points)
        on_left, on_right = ([i.column for n in nodes for i in self.chain.site_indices(n)] for nodes in (left, right))
        values = ["re", "im"] if self.is_complex else ["re"]
        bond = next(c for c in a.columns if c not in on_left and c not in values)
        both = points.join(a.withColumn("l", F.struct(*values)).drop(*values), on_left).join(b.withColumn("r", F.struct(*values)).drop(*values), [*on_right, bond])
        sums = both.select(point, *_times(self.is_complex)).groupBy(point).agg(*(F.sum(v).alias(v) for v in values))
        return points.select(point).join(sums, point, "left").select(point, *(F.coalesce(v, F.lit(0.0)).alias(v) for v in values))

    def clear(self) -> None:
        self.left = self.right = None


def evaluate_product(a: Network, b: Network, points: DataFrame, transform: Callable[[Column], Column] | None = None, point: str = "point") -> DataFrame:
    """Values at points of the product of two operators (common sites are summed), transformed if asked, without the product's bonds being fused.

    point, re (and im). Of a complex product, transform takes both parts and gives a real part or a pair of parts.
    """
    b = b.sim_links()
    nodes = {n: contract_pair(a.tensors[n], b.tensors[n]) for n in a.nodes}
    own = [i.column for i in Network(nodes).external_indices()] if len(nodes) == 1 else None
    p = Index(point, 1 << 40)
    held: dict = {}
    links = {*a.edges().values(), *b.edges().values()}
    for node, parent in a.walk(a.root):
        t = nodes[node]
        sites = [i.column for i in t.indices if i not in links] if own is None else own
        rest = [i for i in t.indices if i.column not in sites]
        rows = points.select(point, *sites).join(t.df, sites) if sites else None
        t = Tensor(rows.select(point, *(i.column for i in rest), *t.values), (p, *rest), t.is_complex) if sites else t
        t = contract_pair(held[node], t, retain=[p]) if node in held else t
        if parent is None:
            parts = [F.coalesce(v, F.lit(0.0)) for v in t.values]
            out = transform(*parts) if transform else tuple(parts)
            named = zip(out if isinstance(out, tuple) else (out,), ("re", "im"), strict=False)
            return points.select(point).join(t.df, point, "left").select(point, *(c.alias(n) for c, n in named))
        held[parent] = contract_pair(held[parent], t, retain=[p]) if parent in held else t
    raise ValueError("an empty network")
