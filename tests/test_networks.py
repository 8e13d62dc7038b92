"""Factorizations over many decades, pivots by tournament, operators with gaps, forms and editing of trees, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftnet import tensor as T
from weftnet.functions import bitops as B, cross, quantics as Q
from weftnet.index import Index, new_index
from weftnet.operators import aca, factorize as X
from weftnet.plans import forms as S, linear as L, network as N, partition as P, products as R

A, C = Index("a", 60), Index("c", 6)


def matrix(t, rows, cols):
    return X.matrix(t.permute([*rows, *cols]), rows)


@pytest.mark.parametrize("block", [1 << 22, 16])
def test_factors_over_decades(spark, monkeypatch, block):
    """One block of rows, and many that are joined by reduction."""
    monkeypatch.setattr(X, "BLOCK_VALUES", block)
    rng = np.random.default_rng(0)
    u, v = (np.linalg.qr(rng.normal(size=(n, 6)))[0] for n in (60, 6))
    s = 10.0 ** -np.arange(0, 15, 2.5)
    values = (u * s) @ v.T
    t = T.from_dense(spark, [A, C], values.ravel(order="F").tolist())
    left, got, right = X.svd(t, [A])
    bond = next(i for i in left.indices if i in right.indices)
    columns = matrix(left, [A], [bond])
    assert len(got) == 6 and np.allclose(got, s, rtol=5e-2) and np.allclose(got[:4], s[:4], rtol=1e-6)
    assert np.abs(columns.T @ columns - np.eye(6)).max() < 1e-12
    assert np.abs((columns * got) @ matrix(right, [bond], [C]) - values).max() < 1e-14
    q, r = X.qr(t, [A])
    bond = next(i for i in q.indices if i in r.indices)
    columns = matrix(q, [A], [bond])
    assert np.abs(columns.T @ columns - np.eye(6)).max() < 1e-12 and np.abs(columns @ matrix(r, [bond], [C]) - values).max() < 1e-14


def test_factors_of_complex_and_wide_matrices(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(4, 7)) + 1j * rng.normal(size=(4, 7))
    a, b = Index("x", 4), Index("y", 7)
    t = T.from_dense(spark, [a, b], values.ravel(order="F").tolist())
    for method, side in (("svd", "left"), ("qr", "left"), ("qr", "right")):
        first, second = X.factorize(t, [a], method=method, canonical=side)
        assert np.abs(matrix(T.contract_pair(first, second), [a], [b]) - values).max() < 1e-12


def test_pivots_by_tournament(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(90, 4)) @ rng.normal(size=(4, 8))
    rows = spark.createDataFrame([(i, j, float(values[i, j])) for i in range(90) for j in range(8)], "i long, j long, re double")
    for block in (1 << 20, 80):
        i, j, errors = cross.chosen_pivots(rows, 90, 8, 1e-10, 6, block)
        assert len(i) == len(j) == 4 and errors[-1] < 1e-10 * errors[0]
        rest = values - values[:, j] @ np.linalg.inv(values[np.ix_(i, j)]) @ values[i]
        assert np.abs(rest).max() < 1e-9


def test_growing_cross(spark):
    rng = np.random.default_rng(3)
    a, b = Index("a", 6), Index("b", 5)
    values = rng.normal(size=(6, 3)) @ rng.normal(size=(3, 5))
    c = aca.GrowingCross.of(T.from_dense(spark, [a, b], values.ravel(order="F").tolist()), [a])
    c.add_pivot_row(c.available("rows")[0])
    assert c.rank == 2 and len(c.available("columns")) == 3
    at, size = c.find_new_pivot([{a: 1}, {a: 2}], [{b: 0}, {b: 4}])
    assert size == pytest.approx(c.local_error([{a: 1}, {a: 2}], [{b: 0}, {b: 4}]).maxabs()) and at[0][a] in (1, 2) and at[1][b] in (0, 4)
    c.add_best_pivot()
    assert np.abs(matrix(c.to_matrix(), [a], [b]) - values).max() < 1e-12 and c.evaluate({a: 2}, {b: 3}) == pytest.approx(values[2, 3])


@pytest.fixture(scope="module")
def state(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=16)
    x = Index("x", 16)
    net, sites = B.bit_train(T.from_dense(spark, [x], values.tolist()), x)
    return net, sites, x, values


def test_operators_on_bits(spark, state):
    net, sites, x, f = state
    outs = [new_index(2) for _ in sites]
    pairs, n = list(zip(outs, sites, strict=True)), np.arange(16)
    run = lambda op: np.array(B.grid_values(op.apply(net), outs, x).to_list())
    wrapped = np.concatenate([f, -f, f])
    assert np.abs(run(B.shift_operator(spark, pairs, 19, Q.ANTIPERIODIC)) - wrapped[19:35]).max() < 1e-12
    assert np.abs(run(B.shift_operator(spark, pairs, -3, Q.OPEN)) - np.concatenate([[0] * 3, f[:-3]])).max() < 1e-12
    folded = np.zeros(16)
    np.add.at(folded, (-5 * n + 3) % 16, f)
    assert np.abs(run(B.affine_operator(spark, pairs, [[-5]], [3])) - folded).max() < 1e-12
    two = [(new_index(4), new_index(4)) for _ in range(2)]  # y1 = x1 + x2, y2 = x1 - x2 + 1 on a grid of 4 x 4
    op = B.affine_operator(spark, two, [[1, 1], [1, -1]], [0, 1]).to_tensor()
    for row in op.df.collect():
        bits = lambda k: [[row[p[k].column] >> v & 1 for p in two] for v in (0, 1)]  # noqa: E731, B023
        (y1, y2), (x1, x2) = ([2 * hi + lo for hi, lo in bits(k)] for k in (0, 1))
        assert (y1, y2) == ((x1 + x2) % 4, (x1 - x2 + 1) % 4)
    assert op.df.count() == 16


def test_operator_with_a_gap_and_exclusive_ones(spark, state):
    net, sites, x, f = state
    g = lambda s: np.array(B.grid_values(s, sites, x).to_list()).reshape(2, 2, 2, 2)
    rng, t = np.random.default_rng(5), f.reshape(2, 2, 2, 2)
    m = rng.normal(size=(2, 2, 2, 2))
    o0, i0, o2, i2 = (new_index(2) for _ in range(4))
    u, v = X.factorize(T.from_dense(spark, [o0, i0, o2, i2], m.ravel(order="F").tolist()), [o0, i0])
    gap = L.LinearOperator(N.Network({0: u, 2: v}), {sites[0]: i0, sites[2]: i2}, {sites[0]: o0, sites[2]: o2})
    assert np.abs(g(gap.apply(net)) - np.einsum("aibj,iqjs->aqbs", m, t)).max() < 1e-12
    assert np.abs(g(gap.adjoint().apply(net)) - np.einsum("iajb,iqjs->aqbs", m, t)).max() < 1e-12
    a, b = np.array([[1.0, 2], [3, 4]]), np.array([[0.0, 2], [3, 4]])
    ops = [L.matrix_operator(net, 1, a), L.matrix_operator(net, 3, b)]
    assert L.are_exclusive(ops, net) and not L.are_exclusive([gap, ops[0]], net)
    assert np.abs(g(L.compose_exclusive(ops, net).apply(net)) - np.einsum("qb,sd,abcd->aqcs", a, b, t)).max() < 1e-12
    assert np.abs(g(L.apply_to_indices(L.matrix_operator(net, 0, a), net, [sites[2]])) - np.einsum("rc,abcd->abrd", a, t)).max() < 1e-12
    with pytest.raises(ValueError):
        L.compose_exclusive([gap, ops[0]], net)


def test_fit_cuts_bonds(spark, state):
    """The nearest network with smaller bonds: the cut of the matrix in the middle, by its singular values."""
    net, sites, x, f = state
    cut = net.truncate(X.Truncation(max_dim=2))
    found = R.fit_sum([net], cut, sweeps=1)
    near = lambda s: np.linalg.norm(np.array(B.grid_values(s, sites, x).to_list()) - f)
    assert near(found) <= near(cut) + 1e-9 and max(found.link_dims()) == 2
    with pytest.raises(ValueError):
        R.multiply(net, net, "other")


def test_editing_of_trees(spark, state):
    net, sites, _, _ = state
    assert S.euler_tour_nodes(net, 1) == [1, 0, 1, 2, 3, 2, 1] and sorted(S.edges_towards(net, [1, 2])) == [(0, 1), (3, 2)]
    assert sorted(S.boundary_edges(net, [1, 2])) == [(1, 0), (2, 3)]
    assert S.is_connected(net, [0, 1]) and not S.is_connected(net, [0, 2])
    more = S.connect(S.add_node(net, "leaf", T.ones(spark, [Index("leaf", 3)])), 3, "leaf")
    more.validate_tree()
    assert set(S.remove_node(more, "leaf").nodes) == set(net.nodes)
    bond = new_index(net.edges()[(0, 1)].dim)
    assert S.replace_bond(net, 0, 1, bond).edges()[(0, 1)] == bond
    assert S.same_appearance(net, S.random_network(spark, net, 1)) and not S.same_appearance(net, more)
    with pytest.raises(ValueError):
        S.extract_subtree(net, [0, 2])


def test_patches_that_overlap(spark):
    rng = np.random.default_rng(6)
    i, j, k = Index("i", 2), Index("j", 2), Index("k", 3)
    m, n = rng.normal(size=(2, 2, 3)), rng.normal(size=2)
    t, w = T.from_dense(spark, [i, j, k], m.ravel(order="F").tolist()), T.from_dense(spark, [i], n.tolist())
    parts = P.Partitioned.of([(P.Projector.of({i: 0}), t), (P.Projector.of({i: 1, j: 0}), t), (P.Projector.of({i: 1, j: 1}), t)])
    got = parts.contract(P.Partitioned.of([(P.Projector(), w)])).whole()
    assert np.abs(got.permute([j, k]).densified().to_list() - np.einsum("ijk,i->jk", m, n).ravel(order="F")).max() < 1e-12
    assert all(p.disjoint(q) for a, (p, _) in enumerate(parts.add(parts).patches) for q, _ in parts.patches[:a])


def test_whole_numbers_are_exact(spark):
    w = Index("w", 1 << 60)
    values = [(1 << 60) - 1, (1 << 59) + 1, 0, (1 << 53) + 1]
    t = T.Tensor(spark.createDataFrame([(v, 1.0) for v in values], "w long, re double"), (w,))
    split, group = Q.bits(t, w)
    assert sorted(r.w for r in Q.number(split, group, w)[0].df.collect()) == sorted(values)
    got = spark.createDataFrame([(-7,), (7,), (-(1 << 60),)], "x long").select(T.whole(F.col("x"), 4).alias("w")).collect()
    assert [r.w for r in got] == [-2, 1, -(1 << 58)]
