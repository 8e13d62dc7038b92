"""Maps of functions on grids of 2^R points as operators on trains of bits.

Each map is a small automaton that reads the output and the input number bit by bit: its states are the operator's bonds, and
its moves are the cores, as tables of a few rows. Sites are ordered from the most significant bit to the least; additions
carry from the last site to the first. Nothing depends on the number of points.
"""

from __future__ import annotations

import cmath
import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from fractions import Fraction
from itertools import product

from pyspark.sql import SparkSession, functions as F

from ..index import Index, new_index, new_link
from ..plans.network import Network, train
from ..plans.prefixes import exact_train
from ..tensor import Tensor, contract_pair, from_dense, positions
from .cross import chebyshev_nodes
from .quantics import ANTIPERIODIC, OPEN, PERIODIC, bits

Move = tuple[int, int, int, int, complex]


def bit_train(t: Tensor, index: Index) -> tuple[Network, list[Index]]:
    """A tensor with one index of dimension 2^R as a train of bits, most significant first."""
    split, group = bits(t, index)
    return exact_train(split, group), group


def automaton(spark: SparkSession, pairs: Sequence[tuple[Index, Index]], moves: Sequence[Iterable[Move]], first: Mapping[int, complex], last: Mapping[int, complex]) -> Network:
    """An operator from (left state, out, in, right state, weight) for each site; first and last weigh the states at the ends."""
    cores, states, n = [], [], len(pairs)
    tables = []
    for k, own in enumerate(moves):
        found: dict[tuple[int, int, int, int], complex] = {}
        for l, o, i, r, w in own:  # noqa: E741
            w = w * (first.get(l, 0) if k == 0 else 1) * (last.get(r, 0) if k == n - 1 else 1)
            key = (0 if k == 0 else l, o, i, 0 if k == n - 1 else r)
            found[key] = found.get(key, 0) + w
        tables.append({k_: w for k_, w in found.items() if w})
    for k in range(n - 1):
        states.append({s: j for j, s in enumerate(sorted({x[3] for x in tables[k]} & {x[0] for x in tables[k + 1]}))})
    links = [new_link(max(1, len(s))) for s in states]
    rich = any(isinstance(w, complex) for t in tables for w in t.values())
    for k, (out, in_) in enumerate(pairs):
        rows = []
        for (l, o, i, r), w in tables[k].items():  # noqa: E741
            left, right = (states[k - 1].get(l) if k else 0), (states[k].get(r) if k < n - 1 else 0)
            if left is not None and right is not None:
                rows.append((left, o, i, right, float(w.real), float(complex(w).imag)))
        around = [*links[max(0, k - 1) : k], out, in_, *links[k : k + 1]]
        names = [links[k - 1].column if k else "weft_l", out.column, in_.column, links[k].column if k < n - 1 else "weft_r"]
        df = spark.createDataFrame(rows, ", ".join([*(f"`{c}` long" for c in names), "re double", "im double"]))
        core = Tensor(df.select(*(i.column for i in around), "re", "im"), tuple(around), True)
        cores.append(core if rich else core.real_part())
    return train(cores)


def _wrap(turns: int, boundary: str) -> float:
    if boundary == OPEN:
        return 1.0 if turns == 0 else 0.0
    if boundary == ANTIPERIODIC:
        return -1.0 if turns % 2 else 1.0
    if boundary != PERIODIC:
        raise ValueError(f"unknown boundary {boundary}")
    return 1.0


def affine_operator(spark: SparkSession, pairs: Sequence[tuple[Index, Index]], matrix: Sequence[Sequence], offset: Sequence, boundary: str = PERIODIC) -> Network:
    """g(y) = sum of f(x) over all x with y = A x + b; the entries are rational.

    With the common denominator d of a row, that is d y = A' x + b' up to multiples of 2^R around a ring (of which odd ones
    change the sign if it is antiperiodic), and exactly with open ends. So around a ring several y may belong to one x. A site's output index holds a bit of each output, the first running fastest, and its input index one of each input.
    The automaton carries what is left of d y - (A x + b), d the common denominator of a row, from bit to bit.
    """
    r = len(pairs)
    rows = []
    for a, b in zip(matrix, offset, strict=True):
        fractions = [Fraction(x) for x in a] + [Fraction(b)]
        d = math.lcm(*(x.denominator for x in fractions))
        rows.append(([int(x * d) for x in fractions[:-1]], int(fractions[-1] * d), d))
    n_in, n_out = len(rows[0][0]), len(rows)
    moves: list[list[tuple]] = []
    now = {(0,) * n_out}
    for j in range(r):  # from the least significant bit
        own, after = [], set()
        for carry in now:
            for x in product((0, 1), repeat=n_in):
                for y in product((0, 1), repeat=n_out):
                    total = [sum(p * q for p, q in zip(a, x, strict=True)) + (b >> j & 1) + c - d * z for (a, b, d), c, z in zip(rows, carry, y, strict=True)]
                    if not any(t % 2 for t in total):
                        to = tuple(t // 2 for t in total)
                        after.add(to)
                        own.append((to, sum(z << k for k, z in enumerate(y)), sum(z << k for k, z in enumerate(x)), carry, 1.0))
        moves.append(own)
        now = after

    def weight(carry: tuple[int, ...]) -> float:
        """What is left of A x + b - d y is a multiple of 2^R; around the ring any multiple will do."""
        return math.prod(_wrap(c + (b >> r), boundary) for c, (_, b, _) in zip(carry, rows, strict=True))

    number = {s: k for k, s in enumerate(sorted({s for own in moves for m in own for s in (m[0], m[3])}))}
    plain = [[(number[a], o, i, number[b], w) for a, o, i, b, w in own] for own in moves[::-1]]
    return automaton(spark, pairs, plain, {number[s]: weight(s) for s in now}, {number[(0,) * n_out]: 1.0})


def affine_pullback_operator(spark: SparkSession, pairs: Sequence[tuple[Index, Index]], matrix: Sequence[Sequence], offset: Sequence, boundary: str = PERIODIC) -> Network:
    """g(x) = f(A x + b): the same automaton read the other way."""
    return affine_operator(spark, [(i, o) for o, i in pairs], matrix, offset, boundary)


def shift_operator(spark: SparkSession, pairs: Sequence[tuple[Index, Index]], offset: int, boundary: str = PERIODIC) -> Network:
    """g(x) = f(x + offset)."""
    return affine_operator(spark, pairs, [[1]], [-offset], boundary)


def flip_operator(spark: SparkSession, pairs: Sequence[tuple[Index, Index]], boundary: str = PERIODIC) -> Network:
    """g(x) = f(2^R - x)."""
    return affine_operator(spark, pairs, [[-1]], [1 << len(pairs)], boundary)


def triangle_operator(spark: SparkSession, pairs: Sequence[tuple[Index, Index]], lower: bool = True) -> Network:
    """g(x) = sum of f(y) for y < x (lower) or y > x: as long as all bits are equal nothing is decided."""
    undecided, decided = 0, 1
    win = (1, 0) if lower else (0, 1)
    own = [(undecided, b, b, undecided, 1.0) for b in (0, 1)] + [(undecided, *win, decided, 1.0)]
    own += [(decided, o, i, decided, 1.0) for o in (0, 1) for i in (0, 1)]
    return automaton(spark, pairs, [own] * len(pairs), {undecided: 1.0}, {decided: 1.0})


def cumsum_operator(spark: SparkSession, pairs: Sequence[tuple[Index, Index]]) -> Network:
    """The strict prefix sum."""
    return triangle_operator(spark, pairs, lower=True)


def phase_operator(spark: SparkSession, pairs: Sequence[tuple[Index, Index]], angle: float) -> Network:
    """g(x) = exp(i angle x) f(x)."""
    r = len(pairs)
    moves = [[(0, 0, 0, 0, 1.0 + 0j), (0, 1, 1, 0, cmath.exp(1j * angle * (1 << (r - 1 - k))))] for k in range(r)]
    return automaton(spark, pairs, moves, {0: 1.0}, {0: 1.0})


def fourier_operator(spark: SparkSession, pairs: Sequence[tuple[Index, Index]], sign: int = -1, order: int = 12, normalize: bool = True) -> Network:
    """g(k) = sum over x of exp(sign 2 pi i k x / 2^R) f(x); the output's bits stand in reversed order, least significant first.

    At a site only the input bits to its right matter, through the fraction t that they make; functions of t are carried by
    their values at order + 1 Chebyshev nodes, which are exact to about 1e-9 at order 12.
    """
    nodes, r = chebyshev_nodes(order), len(pairs)
    scale = 1 / math.sqrt(2) if normalize else 1.0

    def basis(k: int, t: float) -> float:
        return math.prod((t - x) / (nodes[k] - x) for j, x in enumerate(nodes) if j != k)

    moves = []
    for p in range(r):
        rights = [(0, 0.0)] if p == r - 1 else list(enumerate(nodes))
        own = []
        for b, c in rights:
            for o, i in product((0, 1), repeat=2):
                t = (i + c) / 2
                turn = cmath.exp(sign * 2j * math.pi * o * t) * scale
                own += [(a, o, i, b, turn * (basis(a, t) if p else 1.0)) for a in range(len(nodes) if p else 1)]
        moves.append(own)
    return automaton(spark, pairs, moves, {0: 1.0}, {0: 1.0})


def difference_kernel_operator(kernel: Network, sites: Sequence[Index], pairs: Sequence[tuple[Index, Index]], boundary: str = PERIODIC) -> Network:
    """g(x) = sum over y of kernel(x - y) f(y), kernel a train of bits: the rule x = d + y joined with the kernel on d."""
    spark = kernel.tensors[kernel.root].spark
    fused = [new_index(4) for _ in pairs]  # d fastest, then y
    rule = affine_operator(spark, [(o, f) for (o, _), f in zip(pairs, fused, strict=True)], [[1, 1]], [0], boundary)
    own = kernel.sim_links()
    out, joined = {}, {}
    for k, ((o, i), f, s) in enumerate(zip(pairs, fused, sites, strict=True)):
        t = contract_pair(rule.tensors[k].unfuse_index(f, [s, i]), own.tensors[k])
        out[k] = t
    for k in range(len(pairs) - 1):
        a, b = rule.edges()[(k, k + 1)], own.edges()[(k, k + 1)]
        joined[k] = (a, b, new_link(a.dim * b.dim))
    for k in out:
        for a, b, link in (joined[j] for j in (k - 1, k) if j in joined):
            out[k], _ = out[k].fuse_indices([a, b], link)
    return Network(out)


def embed_operator(op: Network, pairs: Sequence[tuple[Index, Index]], own: Sequence[tuple[Index, Index]], variable: int, n_variables: int) -> Network:
    """An operator on one variable's bits as one on sites that hold a bit of each variable (the first fastest); others stay as they are."""
    out = {}
    for k, (o, i) in enumerate(pairs):
        (a, b), t = own[k], op.tensors[k]
        others = [new_index(2) for _ in range(n_variables - 1)]
        ins = [x.sim() for x in others]
        grid = positions(t.spark, others).drop("pos") if others else t.spark.range(1).drop("id")
        same = Tensor(grid.select(*(F.col(x.column).alias(c.column) for x, y in zip(others, ins, strict=True) for c in (x, y)), F.lit(1.0).alias("re")), tuple(c for x, y in zip(others, ins, strict=True) for c in (x, y)))
        t = contract_pair(t, same) if others else t
        t, _ = t.fuse_indices([*others[:variable], a, *others[variable:]], o)
        out[k], _ = t.fuse_indices([*ins[:variable], b, *ins[variable:]], i)
    return Network(out)


def grid_values(state: Network, sites: Sequence[Index], index: Index) -> Tensor:
    """A train of bits, most significant first, as a tensor over the grid."""
    out, _ = state.to_tensor().fuse_indices(list(sites)[::-1], index)
    return out


def interpolation_train(spark: SparkSession, function: Callable[..., float], sites: Sequence[Index], order: int, a: float = 0.0, b: float = 1.0) -> Network:
    """function on the 2^R points of [a, b) as a train of bits from order + 1 values: each core rescales the polynomial to a half.

    The first core holds values at the nodes of either half, the middle ones interpolate from nodes to those of halves, the
    last one to the points.
    """
    nodes = chebyshev_nodes(order)

    def basis(k: int, t: float) -> float:
        return math.prod((t - x) / (nodes[k] - x) for j, x in enumerate(nodes) if j != k)

    links = [new_link(order + 1) for _ in sites[1:]]
    cores = []
    for k, s in enumerate(sites):
        ends = [0.0] if k == len(sites) - 1 else nodes
        around = [*links[max(0, k - 1) : k], s, *links[k : k + 1]]
        lefts = range(1) if k == 0 else range(order + 1)
        at = lambda l, t: float(function(a + (b - a) * t)) if k == 0 else basis(l, t)  # noqa: B023, E731, E741
        values = [at(l, (bit + t) / 2) for t in ends for bit in (0, 1) for l in lefts]  # noqa: E741
        cores.append(from_dense(spark, around, values))
    return train(cores)


def interpolation_train_pieces(spark: SparkSession, function: Callable[..., float], sites: Sequence[Index], order: int, depth: int, a: float = 0.0, b: float = 1.0) -> Network:
    """The same with a polynomial of its own on each of 2^depth pieces, for functions with sharp features: trains of the
    pieces, masked to their leading bits and added."""
    out = None
    for piece in range(1 << depth):
        lo, hi = a + (b - a) * piece / (1 << depth), a + (b - a) * (piece + 1) / (1 << depth)
        tail = interpolation_train(spark, function, sites[depth:], order, lo, hi)
        links = [new_link(1) for _ in range(depth)]
        heads = []
        for k in range(depth):
            around = [*links[max(0, k - 1) : k], sites[k], links[k]]
            heads.append(from_dense(spark, around, [1.0 if bit == piece >> (depth - 1 - k) & 1 else 0.0 for bit in (0, 1)]))
        first = contract_pair(tail.tensors[0], from_dense(spark, [links[-1]], [1.0])) if depth else tail.tensors[0]
        whole = train([*heads, first, *(tail.tensors[k] for k in range(1, len(tail.tensors)))])
        out = whole if out is None else out.add(whole)
    return out


def estimate_interpolation_error(net: Network, function: Callable[..., float], sites: Sequence[Index], n_points: int = 64, a: float = 0.0, b: float = 1.0) -> float:
    """The largest difference from function at evenly spread grid points."""
    spark, r = net.tensors[net.root].spark, len(sites)
    xs = sorted({(k << r) // n_points for k in range(n_points)})
    points = spark.createDataFrame([(k, *((x >> (r - 1 - j)) & 1 for j in range(r))) for k, x in enumerate(xs)], ", ".join(["point long", *(f"`{s.column}` long" for s in sites)]))
    told = {row.point: row.re for row in net.evaluate(points).collect()}
    return max(abs(told[k] - function(a + (b - a) * x / (1 << r))) for k, x in enumerate(xs))
