"""Registered queries of trees, trains of bits, linear operators, crosses and partitions, and the same in SQL.

Trains of bits stand for quantity by span of 16 days on a grid of 2^8 spans.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from . import encode as E, index as I, tensor as T
from .encode import FLAG, MONTH, STATUS, table
from .functions import bitops as B, evaluate as V, quantics as Q
from .index import Index
from .operators import aca, factorize as X, krylov as K
from .plans import forms as S, linear as L, network as N, partition as P, products as R
from .queries import BASE, ORDER, WEIGHT, _weight, number, query, rows
from .session import shared_dir
from .sources import store

SPAN, N_BITS = Index("w", 256), 8
BITS = [Index(f"b{k}", 2) for k in range(N_BITS)]
OUTS = [Index(f"o{k}", 2) for k in range(N_BITS)]
PAIRS = list(zip(OUTS, BITS, strict=True))
SPANS = BASE + ", s AS (SELECT day // 16 AS w, sum(re) AS re FROM g GROUP BY ALL), z AS (SELECT x AS w, coalesce(re, 0) AS re FROM range(256) r(x) LEFT JOIN s ON s.w = x) "


def _spans(spark, d) -> T.Tensor:
    return T.from_table(table(spark, d, "lineitem"), {SPAN: T.whole(E.day_code("l_shipdate"), 16)}, F.col("l_quantity"))


def _bits(spark, d) -> N.Network:
    t = _spans(spark, d).unfuse_index(SPAN, BITS[::-1]).permute(BITS)
    return B.exact_train(t, BITS)


def _grid(net: N.Network, sites=OUTS, digits=None):
    return rows(B.grid_values(net, list(sites), SPAN), digits)


# -- labels, constructors, values -----------------------------------------------------------------


@query("SELECT flag, month, sum(re)::BIGINT AS re FROM t GROUP BY ALL")
def index_algebra(spark, d):
    """What two tensors' index lists have and don't have in common decides what is summed."""
    a, b = E.quantity(spark, d), E.lines(spark, d)
    gone = I.noncommon_inds(a.indices, b.indices)
    if not I.has_common_inds(a.indices, b.indices) or not I.has_inds(a.indices, b.indices) or I.has_ind(b.indices, STATUS):
        raise ValueError("index lists are wrong")
    kept = [i for i in I.union_inds(a.indices, b.indices) if i not in gone and i.is_contractable(i.conj())]
    return rows(a.sum_over(gone).permute(I.sort_indices(kept)).permute([FLAG, MONTH]))


@query("SELECT flag, month AS m, sum(re)::BIGINT AS re FROM t GROUP BY ALL")
def prime_levels(spark, d):
    t = E.quantity(spark, d).sum_over([STATUS]).prime(2)
    back = t.replace_indices(*((i, i.set_plev(0)) for i in t.indices))
    return rows(back.replace_indices((MONTH, Index("m", MONTH.dim))))


@query("SELECT flag, f.flag2, re * 2 AS re FROM (SELECT flag, sum(re)::BIGINT AS re FROM t GROUP BY ALL) JOIN (VALUES (0, 0), (1, 1), (2, 2)) f(flag, flag2) USING (flag)")
def diagonal_from_values(spark, d):
    values = E.quantity(spark, d).sum_over([STATUS, MONTH]).to_list()
    return rows(T.contract_pair(T.from_diag(spark, [FLAG, Index("flag2", 3)], values), T.scalar(spark, 2.0)))


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def dense_round_trip(spark, d):
    """Values in column-major order to the driver and back, on top of zeros, with random values added and taken off."""
    t = E.quantity(spark, d)
    noise = T.random(spark, list(t.indices), 5)
    return rows(T.from_dense(spark, t.indices, t.densified().to_list()).add(T.zeros(spark, list(t.indices))).add(noise).sub(noise))


@query("SELECT flag, status, month, (2 * re)::BIGINT AS re FROM t")
def imaginary_part(spark, d):
    t = E.quantity(spark, d)
    return rows(t.scale(3 + 2j).imag_part())


@query("SELECT flag, month, sum(re)::BIGINT AS re FROM t GROUP BY ALL HAVING sum(re) > 0")
def approximate_equality(spark, d):
    """Rows of a tensor if it equals its copy with a tiny error, and if it has no value that is not finite."""
    a = E.quantity(spark, d).sum_over([STATUS])
    same = a.isapprox(a.scale(1 + 1e-12), rtol=1e-9) and not a.isapprox(a.scale(1.1), rtol=1e-9)
    bad = a.map_values(lambda v: F.when(F.col("month") == 0, float("nan")).otherwise(v))
    return rows(a if same and bad.has_nonfinite() and not a.has_nonfinite() else a.scale(0))


LARGE = Index("x", 1 << 60)


@query("SELECT (((o_orderkey::BIGINT << 40) + (o_custkey << 8) + 1 - 987654321987654321) % 1152921504606846976 + 1152921504606846976) % 1152921504606846976 AS x, 1 AS re FROM orders")
def quantics_bits_large(spark, d):
    """Sixty bits and back, and a shift around the end of the grid: exact where doubles are not.

    Keys of any size are taken around the grid before they are added. An order's key stays beside its point, so that orders
    which meet on a point stay apart.
    """
    part = lambda c, by: F.pmod(F.shiftleft(F.col(c), by), F.lit(LARGE.dim))  # noqa: E731  (the grid divides 2^64)
    at = F.pmod(part("o_orderkey", 40) + part("o_custkey", 8) + 1, F.lit(LARGE.dim))
    points = table(spark, d, "orders").select(at.alias(LARGE.column), F.col("o_orderkey").alias(ORDER.column), F.lit(1.0).alias("re"))
    points = points.repartition(ORDER.column)  # sixty bits a row are work for all cores, however few splits the file has
    t = Q.shift(T.Tensor(points, (LARGE, ORDER)), {LARGE: 987654321987654321})
    split, group = Q.bits(t, LARGE)
    return rows(Q.number(split, group, LARGE)[0]).select(LARGE.id, "re")


# -- maps of grids as operators on trains of bits -------------------------------------------------


@query(SPANS + "SELECT (w - 37 + 256) % 256 AS w, re::BIGINT AS re FROM s")
def shift_operator(spark, d):
    return _grid(B.shift_operator(spark, PAIRS, 37).apply(_bits(spark, d)))


@query(SPANS + "SELECT w - 37 AS w, re::BIGINT AS re FROM s WHERE w >= 37")
def shift_operator_open(spark, d):
    return _grid(B.shift_operator(spark, PAIRS, 37, Q.OPEN).apply(_bits(spark, d)))


@query(SPANS + "SELECT (w - 37 + 256) % 256 AS w, (CASE WHEN w < 37 THEN -re ELSE re END)::BIGINT AS re FROM s")
def shift_operator_antiperiodic(spark, d):
    return _grid(B.shift_operator(spark, PAIRS, 37, Q.ANTIPERIODIC).apply(_bits(spark, d)))


@query(SPANS + "SELECT (256 - w) % 256 AS w, re::BIGINT AS re FROM s")
def flip_operator(spark, d):
    return _grid(B.flip_operator(spark, PAIRS).apply(_bits(spark, d)))


@query(SPANS + "SELECT w, c::BIGINT AS re FROM (SELECT w, sum(re) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM z) WHERE c <> 0")
def cumsum_operator(spark, d):
    return _grid(B.cumsum_operator(spark, PAIRS).apply(_bits(spark, d)))


@query(SPANS + "SELECT w, c::BIGINT AS re FROM (SELECT w, sum(re) OVER (ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM z) WHERE c <> 0")
def triangle_operator(spark, d):
    return _grid(B.triangle_operator(spark, PAIRS, lower=False).apply(_bits(spark, d)))


@query(SPANS + "SELECT (3 * w + 7) % 256 AS w, re::BIGINT AS re FROM s")
def affine_operator(spark, d):
    return _grid(B.affine_operator(spark, PAIRS, [[3]], [7]).apply(_bits(spark, d)))


@query(SPANS + "SELECT w // 2 AS w, re::BIGINT AS re FROM s WHERE w % 2 = 0")
def affine_operator_rational(spark, d):
    return _grid(B.affine_operator(spark, PAIRS, [[Fraction(1, 2)]], [0], Q.OPEN).apply(_bits(spark, d)))


@query(SPANS + "SELECT z.w AS w, s.re::BIGINT AS re FROM z JOIN s ON s.w = (5 * z.w + 11) % 256")
def affine_pullback_operator(spark, d):
    return _grid(B.affine_pullback_operator(spark, PAIRS, [[5]], [11]).apply(_bits(spark, d)))


@query(SPANS + "SELECT w, round(re * cos(0.25 * w), 3) + 0.0 AS re, round(re * sin(0.25 * w), 3) + 0.0 AS im FROM s")
def phase_operator(spark, d):
    return _grid(B.phase_operator(spark, PAIRS, 0.25).apply(_bits(spark, d)), digits=3)


HOURS = "WITH h AS (SELECT hour(ts) AS x, count(*) AS re FROM events GROUP BY ALL) "
HOUR, HOUR_BITS, HOUR_OUTS = Index("k", 32), [Index(f"h{k}", 2) for k in range(5)], [Index(f"q{k}", 2) for k in range(5)]


def _hour_bits(spark, d) -> N.Network:
    t = T.from_table(table(spark, d, "events"), {HOUR: F.hour("ts")}, F.lit(1.0))
    return B.exact_train(t.unfuse_index(HOUR, HOUR_BITS[::-1]).permute(HOUR_BITS), HOUR_BITS)


@query(HOURS + "SELECT k, round(sum(re * cos(2 * pi() * k * x / 32)) / sqrt(32), 3) + 0.0 AS re, round(-sum(re * sin(2 * pi() * k * x / 32)) / sqrt(32), 3) + 0.0 AS im FROM range(32) r(k), h GROUP BY k")
def fourier_operator(spark, d):
    """The output's bits come in reversed order."""
    out = B.fourier_operator(spark, list(zip(HOUR_OUTS, HOUR_BITS, strict=True)), order=16).apply(_hour_bits(spark, d))
    return rows(B.grid_values(out, HOUR_OUTS[::-1], HOUR), 3)


@query(HOURS + ", w(y, v) AS (VALUES (0, 2), (1, 1), (31, 1)) SELECT (x + y) % 32 AS k, sum(re * v)::BIGINT AS re FROM h, w GROUP BY ALL")
def difference_kernel_operator(spark, d):
    lag = Index("lag", 32)
    kernel, sites = B.bit_train(T.from_dense(spark, [lag], [2.0, 1.0, *[0.0] * 29, 1.0]), lag)
    op = B.difference_kernel_operator(kernel, sites, list(zip(HOUR_OUTS, HOUR_BITS, strict=True)))
    return rows(B.grid_values(op.apply(_hour_bits(spark, d)), HOUR_OUTS, HOUR))


@query(BASE + ", p AS (SELECT status, (month * 5) % 4 AS y, sum(re) AS re FROM t GROUP BY ALL) SELECT status AS x, (y + 1) % 4 AS y, re::BIGINT AS re FROM p")
def embedded_operator(spark, d):
    """A shift of one of two variables whose bits are fused site by site."""
    x, y = Index("x", 4), Index("y", 4)
    t = E.quantity(spark, d).sum_over([FLAG]).df.groupBy(F.col("status").alias("x"), ((F.col("month") * 5) % 4).alias("y")).agg(F.sum("re").alias("re"))
    split, gx = Q.bits(T.Tensor(t, (x, y)), x)
    split, gy = Q.bits(split, y)
    fused = []
    for k, (a, b) in enumerate(zip(gx, gy, strict=True)):
        split, f = split.fuse_indices([a, b], Index(f"f{k}", 4))
        fused.append(f)
    state = B.exact_train(split, fused)
    own = [(Index(f"so{k}", 2), Index(f"si{k}", 2)) for k in range(2)]
    outs = [Index(f"g{k}", 4) for k in range(2)]
    op = B.embed_operator(B.shift_operator(spark, own, -1), list(zip(outs, fused, strict=True)), own, 1, 2)
    out = op.apply(state).to_tensor()
    for k, o in enumerate(outs):
        out = out.unfuse_index(o, [Index(f"rx{k}", 2), Index(f"ry{k}", 2)])
    out, _ = out.fuse_indices([Index("rx1", 2), Index("rx0", 2)], x)
    out, _ = out.fuse_indices([Index("ry1", 2), Index("ry0", 2)], y)
    return rows(out.permute([x, y]))


@query("WITH r AS (SELECT x FROM range(256) a(x)) SELECT * FROM (SELECT x AS w, round(100 * " + WEIGHT.format(9) + " * ((x / 256.0) ** 3 - (x / 256.0)), 4) + 0.0 AS re FROM r) WHERE re <> 0")
def interpolation_train(spark, d):
    w = 100 * _weight(spark, d, 9)
    return _grid(B.interpolation_train(spark, lambda x: w * (x**3 - x), BITS, 4), BITS, 4)


@query("WITH r AS (SELECT x FROM range(256) a(x)) SELECT * FROM (SELECT x AS w, round(100 * " + WEIGHT.format(9) + " * abs(x / 256.0 - 0.5), 4) + 0.0 AS re FROM r) WHERE re <> 0")
def interpolation_train_pieces(spark, d):
    w = 100 * _weight(spark, d, 9)
    return _grid(B.interpolation_train_pieces(spark, lambda x: w * abs(x - 0.5), BITS, 1, 1), BITS, 4)


# -- products with cut bonds, linear operators ----------------------------------------------------

PREFIX = "SELECT w, round(c, 2) + 0.0 AS re FROM (SELECT w, sum(re) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM z) WHERE c <> 0"


@query(SPANS + PREFIX)
def contract_zipup(spark, d):
    """Eight sites; bonds are cut at each step."""
    return _grid(R.zip_up(B.cumsum_operator(spark, PAIRS), _bits(spark, d), X.Truncation(rtol=1e-12), gauged=False), digits=2)


@query(SPANS + PREFIX)
def contract_fit(spark, d):
    """From random values, by one sweep with bonds of the plain product's size: those of a sparse state would be too few."""
    state, op = _bits(spark, d), B.cumsum_operator(spark, PAIRS)
    return _grid(R.contract_fit(op, state, S.random_network(spark, op.apply(state), 3), sweeps=1), digits=2)


@query("SELECT flag, status, month, (3 * re)::BIGINT AS re FROM t")
def fit_sum(spark, d):
    sites = [FLAG, STATUS, MONTH]
    t = N.train_of(E.quantity(spark, d), sites)
    return rows(R.fit_sum([t, t.scale(2)], t, sweeps=1).to_tensor().permute(sites))


def _operator(spark) -> L.LinearOperator:
    return L.LinearOperator(B.cumsum_operator(spark, PAIRS), dict(zip(BITS, BITS, strict=True)), dict(zip(BITS, OUTS, strict=True)))


@query(SPANS + "SELECT w, c::BIGINT AS re FROM (SELECT w, sum(re) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM z) WHERE c <> 0")
def linear_operator_apply(spark, d):
    return _grid(_operator(spark).apply(_bits(spark, d)), BITS)


@query(SPANS + "SELECT w, c::BIGINT AS re FROM (SELECT w, sum(re) OVER (ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM z) WHERE c <> 0")
def linear_operator_transpose(spark, d):
    return _grid(_operator(spark).transpose().apply(_bits(spark, d)), BITS)


@query(SPANS + ", once AS (SELECT w, coalesce(sum(re) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS re FROM z) SELECT w, c::BIGINT AS re FROM (SELECT w, sum(re) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM once) WHERE c <> 0")
def linear_operator_compose(spark, d):
    op = _operator(spark)
    return _grid(op.compose(op).apply(_bits(spark, d)), BITS)


@query("SELECT flag, status, month, (2 * re)::BIGINT AS re FROM t")
def linear_operator_aligned(spark, d):
    """An operator made for other sites and node names, bound, renamed and aligned to the state."""
    t = E.quantity(spark, d)
    state = B.exact_train(t, [FLAG, STATUS, MONTH])
    other = [Index(f"z{i.column}", i.dim) for i in state.external_indices()]
    pairs = [(Index(f"zo{k}", i.dim), Index(f"zi{k}", i.dim)) for k, i in enumerate(other)]
    net = N.identity_operator(spark, pairs).scale(2).rename({0: "a", 1: "b", 2: "c"})
    op = L.LinearOperator(net, {s: i for s, (_, i) in zip(other, pairs, strict=True)}, {s: o for s, (o, _) in zip(other, pairs, strict=True)})
    op = op.rename_nodes({"a": 0, "b": 1, "c": 2}).align_to_state(state)
    return rows(op.set_input_space(state).apply(state).to_tensor().permute([FLAG, STATUS, MONTH]))


@query(BASE + ", m(f, g, v) AS (VALUES (0, 0, 1), (0, 1, 2), (1, 1, 1), (2, 0, 3), (2, 2, 1)) SELECT f AS flag, status, (83 - month) AS month, sum(re * v)::BIGINT AS re FROM t JOIN m ON g = flag GROUP BY ALL")
def exclusive_operators(spark, d):
    """Matrices on the first and last site of a chain, as one operator over the whole chain."""
    state = B.exact_train(E.quantity(spark, d), [FLAG, STATUS, MONTH])
    a = np.zeros((3, 3))
    for f, g, v in ((0, 0, 1), (0, 1, 2), (1, 1, 1), (2, 0, 3), (2, 2, 1)):
        a[f, g] = v
    ops = [L.matrix_operator(state, 0, a), L.matrix_operator(state, 2, np.eye(84)[::-1])]
    return rows(L.compose_exclusive(ops, state).apply(state).to_tensor().permute([FLAG, STATUS, MONTH]))


@query(BASE + ", m(f, g, v) AS (VALUES (0, 0, 1), (0, 1, 2), (1, 1, 1), (2, 0, 3), (2, 2, 1)) SELECT f AS flag, status, month, sum(re * v)::BIGINT AS re FROM t JOIN m ON g = flag GROUP BY ALL")
def local_operator(spark, d):
    state = B.exact_train(E.quantity(spark, d), [FLAG, STATUS, MONTH])
    a = np.zeros((3, 3))
    for f, g, v in ((0, 0, 1), (0, 1, 2), (1, 1, 1), (2, 0, 3), (2, 2, 1)):
        a[f, g] = v
    return rows(L.matrix_operator(state, 0, a).apply_local(state, 0).to_tensor().permute([FLAG, STATUS, MONTH]))


@query(BASE + "SELECT status AS flag0, month, round(sum(re * (flag + 1)), 3) + 0.0 AS re FROM t GROUP BY ALL")
def operator_over_a_gap(spark, d):
    """An operator on the first and last node only; its bond is led through the node between."""
    state = B.exact_train(E.quantity(spark, d), [FLAG, STATUS, MONTH])
    o, i = Index("go", 3), Index("gi", 3)
    o2, i2 = Index("go2", 84), Index("gi2", 84)
    link = I.new_link(2)
    first = T.from_dense(spark, [o, i, link], [1.0 if (a == 0 and k == 0) else 0.0 for k in range(2) for b in range(3) for a in range(3)])
    weights = T.from_dense(spark, [o, i, link], [float(b + 1) if (a == 0 and k == 1) else 0.0 for k in range(2) for b in range(3) for a in range(3)])
    last = T.contract_pair(T.delta(spark, [(o2, i2)]), T.onehot(spark, {link: 1}))
    op = L.LinearOperator(N.Network({0: first.add(weights), 2: last}), {FLAG: i, MONTH: i2}, {FLAG: o, MONTH: o2})
    out = op.apply(state).to_tensor().select_indices({FLAG: 0})
    return rows(out.replace_indices((STATUS, Index("flag0", 2))).permute([Index("flag0", 2), MONTH]), 3)


# -- trees, chains, evaluation --------------------------------------------------------------------


@query("SELECT flag * 168 + status * 84 + month AS point, re::BIGINT AS re FROM t")
def cached_evaluation(spark, d):
    """All points, in two calls: the second contracts only parts that the first has not seen."""
    t = E.quantity(spark, d)
    points = t.df.select("flag", "status", "month").withColumn("point", F.col("flag") * 168 + F.col("status") * 84 + F.col("month"))
    ev = V.CachedEvaluator(B.exact_train(t, [FLAG, STATUS, MONTH]))
    ev.evaluate(points.where("flag = 1"))
    return ev.evaluate(points).select("point", F.round("re").cast("long").alias("re"))


@query(SPANS + ", once AS (SELECT w, coalesce(sum(re) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM z) SELECT w AS point, round(ln(1 + c), 4) + 0.0 AS re FROM once")
def product_evaluation(spark, d):
    """Points of operator times state through a transform, without building the product."""
    points = spark.range(256).select(F.col("id").alias("point"), *(F.shiftright("id", N_BITS - 1 - k).bitwiseAND(F.lit(1)).alias(o.column) for k, o in enumerate(OUTS)))
    out = V.evaluate_product(B.cumsum_operator(spark, PAIRS), _bits(spark, d), points, lambda v: F.log1p(F.round(v)))
    return out.select("point", (F.round("re", 4) + 0.0).alias("re"))


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def vidal_round_trip(spark, d):
    chain = N.train_of(E.quantity(spark, d), [FLAG, STATUS, MONTH])
    form = S.Vidal.of(chain)
    return rows(S.InverseForm.of(form).to_chain().to_tensor().permute([FLAG, STATUS, MONTH]))


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def move_site(spark, d):
    """A site index moved two nodes along the chain, and the network cut and joined again."""
    chain = S.move_sites(B.exact_train(E.quantity(spark, d), [FLAG, STATUS, MONTH]), {FLAG: 2})
    part = S.extract_subtree(chain, [1, 2])
    return rows(S.replace_subtree(chain, part).to_tensor().permute([FLAG, STATUS, MONTH]))


@query("SELECT flag, status, month, (2 * re)::BIGINT AS re FROM t")
def add_reindexed(spark, d):
    sites = [FLAG, STATUS, MONTH]
    a = B.exact_train(E.quantity(spark, d), sites)
    b = a.replace_site_indices(*((i, Index(f"y{i.column}", i.dim)) for i in sites))
    return rows(S.add_reindexed(a, b).to_tensor().permute(sites))


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def canonicalize_to_region(spark, d):
    chain = B.exact_train(E.quantity(spark, d), [FLAG, STATUS, MONTH])
    return rows(S.canonicalize_to(chain, [0, 1]).to_tensor().permute([FLAG, STATUS, MONTH]))


@query("SELECT flag, sum(re * (month + 1))::BIGINT AS re FROM t WHERE status = 1 GROUP BY ALL")
def insert_and_remove_sites(spark, d):
    """A one-hot site picks a status, weights remove the month."""
    chain = B.exact_train(E.quantity(spark, d), [FLAG, STATUS, MONTH])
    picked = chain.insert_onehot(0, Index("extra", 4), 3).project({STATUS: 1})
    out = picked.weighted_remove(MONTH, [float(m + 1) for m in range(84)]).weighted_remove(Index("extra", 4), [0.0, 0.0, 0.0, 1.0])
    return rows(out.partial_sum([STATUS]).to_tensor().permute([FLAG]))


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def save_and_load_network(spark, d):
    path = f"{shared_dir(spark)}/networks-{uuid.uuid4().hex}"
    chain = B.exact_train(E.quantity(spark, d), [FLAG, STATUS, MONTH])
    store.save_network(path, "quantity", chain)
    store.append_network(path, "twice", chain.scale(2))
    return rows(store.load_network(spark, path, "twice").axpby(1, store.load_network(spark, path, "quantity"), -1).to_tensor().permute([FLAG, STATUS, MONTH]))


@query(BASE + "SELECT 3 AS n_nodes, 2 AS n_bonds, count(DISTINCT (month, flag)) AS rank FROM t")
def chain_shape(spark, d):
    """A bond numbers the stored beginnings to its left."""
    chain = B.exact_train(E.quantity(spark, d), [MONTH, FLAG, STATUS])
    chain.validate_tree()
    return spark.range(1).select(F.lit(len(chain.nodes)).cast("long").alias("n_nodes"), F.lit(len(chain.link_dims())).alias("n_bonds"), F.lit(chain.rank()).alias("rank"))


@query("SELECT a.month AS month, b.month AS other, sum(a.re * b.re)::BIGINT AS re FROM t a JOIN t b ON a.flag = b.flag AND a.status = b.status GROUP BY ALL")
def left_environment(spark, d):
    """The left environment of the last node, closed with it on either side."""
    ket = B.exact_train(E.quantity(spark, d), [FLAG, STATUS, MONTH])
    bra = ket.sim_links()
    other = Index("other", MONTH.dim)
    left = S.environments(bra, ket, 2)
    links = [i for i in left.indices if i not in bra.tensors[2].indices]  # environments have fresh links of their own on the ket's side
    last = ket.tensors[2].replace_indices((MONTH, other), (next(i for i in ket.tensors[2].indices if i != MONTH), links[0]))
    return rows(T.contract_pair(T.contract_pair(left, bra.tensors[2]), last).permute([MONTH, other]))


# -- factorizations, crosses, partitions ----------------------------------------------------------

DECADES = BASE + ", v AS (SELECT k, s * pow(10, -2 * k) AS s FROM (SELECT month % 7 AS k, sum(re) AS s FROM t GROUP BY 1)) "


def _decades(spark, d) -> T.Tensor:
    k, j = Index("k", 7), Index("j", 7)
    sums = E.quantity(spark, d).df.groupBy((F.col("month") % 7).alias("k")).agg(F.sum("re").alias("s"))
    return T.Tensor(sums.select("k", F.col("k").alias("j"), (F.col("s") * F.pow(F.lit(10.0), -2 * F.col("k"))).alias("re")), (k, j))


@query(DECADES + "SELECT row_number() OVER (ORDER BY s DESC) - 1 AS k, round(log10(s), 5) + 0.0 AS re FROM v")
def singular_values_over_decades(spark, d):
    _, s, _ = X.svd(_decades(spark, d), [Index("k", 7)])
    return spark.createDataFrame([(k, float(np.log10(v))) for k, v in enumerate(s)], "k long, v double").select("k", (F.round("v", 5) + 0.0).alias("re"))


@query(DECADES + "SELECT k, k AS j, round(log10(s), 4) + 0.0 AS re FROM v")
def qr_over_decades(spark, d):
    """Factors multiply back to every value, the smallest too."""
    t = _decades(spark, d)
    back = T.contract_pair(*X.qr(t, [Index("k", 7)]))
    return rows(back.permute(t.indices).map_values(lambda v: F.when(F.col("k") == F.col("j"), F.log10(F.abs(v))).otherwise(0.0)), 4)


@query("WITH r AS (SELECT x FROM range(6) a(x)) SELECT x AS a, x AS b, 1.0::DOUBLE AS re FROM r")
def isometry_of_svd(spark, d):
    """U* U of a matrix of rank 6 whose columns lie 12 decades apart."""
    months = E.quantity(spark, d).sum_over([FLAG, STATUS]).df.select("month")
    wide = months.select("month", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("c"))
    value = (1 + F.pmod(F.xxhash64("month", "c"), F.lit(1000))) * F.pow(F.lit(10.0), -2.4 * F.col("c"))
    u, _, v = X.svd(T.Tensor(wide.withColumn("re", value), (MONTH, Index("c", 6))), [MONTH])
    bond = next(i for i in u.indices if i in v.indices)
    a, b = Index("a", bond.dim), Index("b", bond.dim)
    return rows(T.contract_pair(u.replace_indices((bond, a)), u.replace_indices((bond, b))).permute([a, b]), 8)


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def growing_cross(spark, d):
    """Pivots one by one, by row, by column and the best, until nothing is left."""
    t, c = E.quantity(spark, d).fuse_indices([FLAG, STATUS], Index("c", 6))
    cross = aca.GrowingCross.of(t, [MONTH])
    cross.add_pivot_row(cross.available("rows")[0])
    cross.add_pivot_column(cross.available("columns")[0])
    while cross.rank < 6 and cross.find_new_pivot()[1] > 1e-6:
        cross.add_best_pivot()
    return rows(cross.to_matrix().unfuse_index(c, [FLAG, STATUS]).permute([FLAG, STATUS, MONTH]))


@query("SELECT status, month, sum(re)::BIGINT AS re FROM t GROUP BY ALL")
def partition_contract_uneven(spark, d):
    """Patches of different depth, summed over what tells them apart."""
    t = E.quantity(spark, d)
    parts = P.Partitioned.of([(P.Projector.of({FLAG: 0}), t), (P.Projector.of({FLAG: 1, STATUS: 0}), t), (P.Projector.of({FLAG: 1, STATUS: 1}), t), (P.Projector.of({FLAG: 2}), t)])
    return rows(parts.contract(P.Partitioned.of([(P.Projector(), T.ones(spark, [FLAG]))])).whole().permute([STATUS, MONTH]))


@query("SELECT flag, status, month, (CASE WHEN flag = 0 THEN 2 ELSE 1 END * re)::BIGINT AS re FROM t")
def partition_add_nested(spark, d):
    t = E.quantity(spark, d)
    return rows(P.Partitioned.of([(P.Projector(), t)]).add(P.Partitioned.of([(P.Projector.of({FLAG: 0}), t)])).whole())


@query("SELECT round(sum(re * re), 3) + 0.0 AS re FROM t WHERE flag < 2")
def partition_inner(spark, d):
    t = E.quantity(spark, d)
    some = P.Partitioned.of([(P.Projector.of({FLAG: 0}), t)]).append(P.Partitioned.of([(P.Projector.of({FLAG: 1}), t)]))
    return number(spark, some.inner(P.Partitioned.split(t, STATUS)), 3)


@query("SELECT flag, status, month, round(re / (2 + 3 * (month % 3 + 1)), 4) + 0.0 AS re FROM t")
def gmres_affine(spark, d):
    """x with 2 x + 3 A x = b for a diagonal A."""
    b = E.quantity(spark, d)
    scale = T.from_function(spark, [MONTH], lambda m: (m % 3) + 1)
    x, _ = K.gmres_affine(lambda v: v.hadamard(scale), 2.0, 3.0, b, atol=1e-7, max_steps=12)
    return rows(x.permute([FLAG, STATUS, MONTH]), 4)
