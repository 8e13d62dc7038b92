"""Parts of the engine against NumPy on small tensors, and their refusals."""

import functools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftnet import index as I, tensor as T
from weftnet.functions import cross, quantics as Q
from weftnet.index import Index
from weftnet.operators import factorize as X, krylov as K
from weftnet.plans import network as N, partition as P, solvers as S
from weftnet.sources import store
from weftnet.streaming import increments

A, B, C, D = (Index(n, d) for n, d in zip("abcd", (2, 3, 4, 2), strict=True))
RNG = np.random.default_rng(0)


def tensor(spark, indices, rich=False):
    shape = [i.dim for i in indices]
    values = RNG.integers(-4, 5, shape) + (1j * RNG.integers(-4, 5, shape) if rich else 0)
    return T.from_dense(spark, indices, values.ravel(order="F").tolist()), values


def dense(t, indices):
    return np.array(t.permute(indices).to_list()).reshape([i.dim for i in indices], order="F")


def test_index_algebra():
    x, y = I.new_index(3, "Site"), I.new_link(3)
    assert x.prime().prime().plev == 2 and x.prime().noprime() == x and x.sim() != x and x.conj() == x
    assert x.is_contractable(x) and not x.is_contractable(x.prime())
    assert I.replace_in([A, x], [(x, y)]) == [A, y] and I.common_inds([A, x], [x, B]) == [x]
    assert I.noncommon_inds([A, x], [x, B]) == [A, B] and I.union_inds([A, x], [x, B]) == [A, x, B]
    assert I.permutation([A, B, C], [C, A, B]) == [2, 0, 1] and I.common_positions([A, x], [x, A]) == [(0, 1), (1, 0)]
    assert I.product_link([A, B, C]).dim == 24 and I.sort_indices([B, A]) == [A, B] and I.has_inds([A, B], [B])
    for bad in (lambda: Index("z", 0), lambda: I.replace_in([A], [(B, B)]), lambda: I.replace_in([A], [(A, B)]), lambda: I.check_unique([A, A]), lambda: I.permutation([A], [B])):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("rich", [False, True])
def test_contraction_and_algebra(spark, rich):
    x, vx = tensor(spark, [A, B, C], rich)
    y, vy = tensor(spark, [C, B, D])
    z, vz = tensor(spark, [D, A], rich)
    assert np.array_equal(dense(T.contract([x, y, z]), []), np.einsum("abc,cbd,da->", vx, vy, vz))
    assert np.array_equal(dense(T.contract([x, y], retain=[B]), [A, B, D]), np.einsum("abc,cbd->abd", vx, vy))
    assert np.array_equal(dense(T.outer_product(x, z.replace_indices((A, A.prime()))), [A, B, C, D, A.prime()]), np.einsum("abc,de->abcde", vx, vz))
    other, vo = tensor(spark, [B, A, C], rich)
    assert np.array_equal(dense(x.axpby(2, other, -3), [A, B, C]), 2 * vx - 3 * vo.transpose(1, 0, 2))
    assert np.array_equal(dense(x * 1j, [A, B, C]), 1j * vx)
    assert abs(x.inner(other) - np.vdot(vx, vo.transpose(1, 0, 2))) < 1e-9
    assert abs(x.norm() - np.linalg.norm(vx)) < 1e-9 and abs(x.maxabs() - np.abs(vx).max()) < 1e-9
    assert x.isapprox(x) and not x.isapprox(x * 2) and abs(x.distance(x * 2) - 1) < 1e-12
    assert np.array_equal(dense(x.sum_over([B]), [A, C]), vx.sum(axis=1)) and x.sum() == vx.sum()


def test_refusals(spark):
    x, _ = tensor(spark, [A, B])
    y, _ = tensor(spark, [C, D])
    for bad in (
        lambda: T.contract([x, y]), lambda: T.contract([]), lambda: x.add(y), lambda: x.only(), lambda: x.select_indices({A: 5}), lambda: x.select_indices({C: 0}),
        lambda: T.outer_product(x, x), lambda: T.from_dense(spark, [A], [1.0]), lambda: T.from_diag(spark, [A, B], [1.0, 2.0]), lambda: T.onehot(spark, {A: 2}),
        lambda: T.stack([x, x], B), lambda: T.Tensor(x.df, (A, A)), lambda: x.unfuse_index(A, [B, C]), lambda: X.Truncation(rtol=-1),
        lambda: X.factorize(x, [A], method="?"), lambda: X.svd(x, [C]), lambda: Q.n_bits(B), lambda: P.Partitioned.of([(P.Projector(), x), (P.Projector(), x)]),
    ):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        X.rank_revealing_lu(x.map_values(lambda v: v / F.lit(0.0) if False else F.lit(float("nan"))), [A])


def test_constructors(spark):
    assert dense(T.from_diag(spark, [A, D], [2.0, 3.0]), [A, D]).tolist() == [[2, 0], [0, 3]]
    assert dense(T.copy_tensor(spark, [A, D, A.prime()]), [A, D, A.prime()]).sum() == 2
    assert T.zeros(spark, [A, B]).sum() == 0 and T.ones(spark, [A, B]).sum() == 6 and T.scalar(spark, 3 + 4j).only() == 3 + 4j
    r = T.random(spark, [A, B, C], 5)
    assert r.to_list() == T.random(spark, [A, B, C], 5).to_list() and abs(np.array(r.to_list())).max() <= 0.5
    assert T.zeros(spark, [A]).densified().map_values(lambda v: v + 1).sum() == 2


@pytest.mark.parametrize("rich", [False, True])
def test_factorizations(spark, rich):
    t, v = tensor(spark, [A, B, C, D], rich)
    m = v.transpose(1, 0, 2, 3).reshape(3, 16)
    u, s, w = X.svd(t, [B])
    assert np.allclose(s, np.linalg.svd(m)[1])
    for method in ("svd", "qr", "lu"):
        for side in ("left", "right"):
            left, right = X.factorize(t, [B, A], method=method, canonical=side)
            assert np.allclose(dense(T.contract_pair(left, right), [A, B, C, D]), v, atol=1e-6)
    q, r = X.qr(t, [A, C, D])
    bond = I.common_inds(q.indices, r.indices)[0]
    gram = X.gram(q, [bond])
    assert np.allclose(gram, np.eye(bond.dim), atol=1e-7)
    cut = X.rank_revealing_lu(t, [B], max_rank=2)
    assert len(cut.pivots) == 2 and len(cut.errors) == 3 and abs(cut.errors[0] - np.abs(v).max()) < 1e-9


def test_truncation_ranks():
    s = np.array([1.0, 0.1, 1e-3, 0.0])
    assert X.Truncation(rtol=0.05).rank(s) == 2 and X.Truncation(max_dim=1).rank(s) == 1 and X.Truncation().rank(s) == 3
    assert X.Truncation(cutoff=1e-4).rank(s) == 2 and X.Truncation().rank(np.zeros(3)) == 1


def test_krylov(spark):
    n = Index("n", 6)
    a = RNG.normal(size=(6, 6)) + 6 * np.eye(6)
    h = a + a.T
    op = lambda m: lambda x: T.contract_pair(T.from_dense(spark, [n.prime(), n], m.ravel(order="F").tolist()), x).replace_indices((n.prime(), n))
    b = RNG.normal(size=6)
    x, error = K.gmres(op(a), T.from_dense(spark, [n], b.tolist()), restart=6, max_steps=6, rtol=1e-8)
    assert error < 1e-7 and np.allclose(a @ np.array(x.to_list()), b, atol=1e-5)
    x, _ = K.gmres_affine(op(a), 2.0, 3.0, T.from_dense(spark, [n], b.tolist()), restart=6, max_steps=6)
    assert np.allclose((2 * np.eye(6) + 3 * a) @ np.array(x.to_list()), b, atol=1e-6)
    value, _ = K.lowest_eigenpair(op(h), T.from_dense(spark, [n], b.tolist()), steps=6)
    assert abs(value - np.linalg.eigvalsh(h)[0]) < 1e-7
    values, vectors = np.linalg.eigh(h)
    out = K.expm_multiply(op(h), T.from_dense(spark, [n], b.tolist()), -0.3j, steps=6)
    assert np.allclose(out.to_list(), (vectors * np.exp(-0.3j * values)) @ vectors.T @ b, atol=1e-6)


def test_star_network(spark):
    links = [Index(f"l{k}", 3) for k in range(3)]
    sites = [A, B, C]
    centre, vc = tensor(spark, links)
    leaves = [tensor(spark, [s, x]) for s, x in zip(sites, links, strict=True)]
    star = N.Network({"centre": centre, **{s.id: t for s, (t, _) in zip(sites, leaves, strict=True)}})
    star.validate_tree()
    full = np.einsum("xyz,ax,by,cz->abc", vc, *(v for _, v in leaves))
    assert np.array_equal(dense(star.to_tensor(), sites), full) and abs(star.sum() - full.sum()) < 1e-9
    assert abs(star.norm() - np.linalg.norm(full)) < 1e-6 and abs(star.log_norm() - math.log(np.linalg.norm(full))) < 1e-9
    assert np.allclose(dense(star.add(star).truncate(X.Truncation(rtol=1e-7)).to_tensor(), sites), 2 * full, atol=1e-4)
    assert max(star.add(star).truncate(X.Truncation(rtol=1e-7)).link_dims()) <= 3
    assert np.allclose(dense(star.canonicalize("a").to_tensor(), sites), full, atol=1e-6)
    assert np.array_equal(dense(star.hadamard(star).to_tensor(), sites), full**2)
    assert star.path("a", "b") == ["a", "centre", "b"] and star.steiner_nodes(["a", "c"]) == {"a", "centre", "c"} and not star.is_chain()
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(np.ndindex(2, 3, 4))], "point long, a long, b long, c long")
    assert [r.re for r in star.evaluate(points).orderBy("point").collect()] == full.ravel().tolist()
    assert np.array_equal(dense(star.weighted_remove(B, [1.0, 2.0, 3.0]).to_tensor(), [A, C]), np.einsum("abc,b->ac", full, [1, 2, 3]))
    assert np.array_equal(dense(star.project({A: 1}).to_tensor(), sites)[1], full[1])
    joined = N.restructure(star, {"ca": ["centre", "a"], "b": ["b"], "c": ["c"]})
    assert np.array_equal(dense(joined.to_tensor(), sites), full)
    split = N.split_node(joined, "ca", ("a", "centre"), [A])
    assert np.allclose(dense(split.to_tensor(), sites), full, atol=1e-6)


def test_chain_forms(spark):
    t, v = tensor(spark, [A, B, C])
    chain = N.train_of(t, [A, B, C])
    singular, left = N.vidal(chain)
    assert np.allclose(singular[0], np.linalg.svd(v.reshape(2, 12))[1], atol=1e-6) and np.allclose(singular[1], np.linalg.svd(v.reshape(6, 4))[1], atol=1e-6)
    assert np.allclose(dense(left.to_tensor(), [A, B, C]), v, atol=1e-6) and chain.is_chain() and chain.rank() <= 6
    assert np.allclose(dense(N.constant_train(spark, [A, B, C], 2.5).to_tensor(), [A, B, C]), 2.5)
    wide = chain.insert_onehot(0, D, 1)
    assert np.allclose(dense(wide.to_tensor(), [A, B, C, D])[..., 1], v, atol=1e-6)


def test_quantics_all_values(spark):
    x = Index("x", 16)
    for k in range(16):
        one = T.onehot(spark, {x: k})
        assert Q.shift(one, {x: 3}).to_list().index(1.0) == (k - 3) % 16
        assert Q.flip(one, [x], Q.ANTIPERIODIC).to_list()[(16 - k) % 16] == (-1.0 if k == 0 else 1.0)
    f = RNG.integers(-5, 6, 16).astype(float)
    t = T.from_dense(spark, [x], f.tolist())
    assert np.array_equal(Q.cumsum(t, x).to_list(), np.concatenate([[0], f.cumsum()[:-1]]))
    assert np.array_equal((Q.triangle(t, x, lower=False) + Q.cumsum(t, x) + t).to_list(), np.full(16, f.sum()))
    assert np.allclose(Q.fourier(t, x).to_list(), np.fft.fft(f) / 4)
    kernel = RNG.integers(-2, 3, 16).astype(float)
    k = T.from_dense(spark, [Index("d", 16)], kernel.tolist())
    assert np.allclose(Q.difference_kernel(k, t, x).to_list(), [sum(kernel[(i - j) % 16] * f[j] for j in range(16)) for i in range(16)])
    assert np.allclose(Q.difference_kernel(k, t, x, Q.OPEN).to_list(), [sum(kernel[i - j] * f[j] for j in range(i + 1)) for i in range(16)])
    y = Index("y", 16)
    two = T.from_dense(spark, [x, y], RNG.integers(-5, 6, 256).astype(float).tolist())
    moved = Q.affine(two, [x, y], [[1, 1], [0, 1]], [2, 5], [Index("u", 16), Index("w", 16)], Q.PERIODIC)
    v, m = dense(two, [x, y]), dense(moved, list(moved.indices))
    assert all(m[(i + j + 2) % 16, (j + 5) % 16] == v[i, j] for i in range(16) for j in range(16))


def test_cross_interpolation_of_low_rank(spark):
    sites = N.fresh_sites([5, 4, 3, 4])
    net, ci = cross.cross_interpolate(spark, lambda a, b, c, d: F.sin(a + b) + c * d, sites)
    values = [math.sin(a + b) + c * d for d in range(4) for c in range(3) for b in range(4) for a in range(5)]
    assert np.allclose(net.to_tensor().permute(sites).to_list(), values, atol=1e-8) and net.rank() <= 3
    assert ci.f.evaluations <= 240
    ci.add_global_pivots([(4, 3, 2, 3)])
    assert all(len(a) == len(b) for a, b in zip(ci.left[1:-1], ci.right[1:-1], strict=True))


def test_partitions(spark):
    t, v = tensor(spark, [A, B, C])
    p, q = P.Projector.of({A: 0, B: 1}), P.Projector.of({B: 1, C: 2})
    assert p.compatible(q) and p.intersection(q).fixed == {A: 0, B: 1, C: 2} and p.common_restriction(q).fixed == {B: 1} and not p.subset_of(q)
    assert p.disjoint(P.Projector.of({A: 1})) and p.intersection(P.Projector.of({A: 1})) is None and p.filter([B]).fixed == {B: 1}
    parts = P.Partitioned.split(t, A)
    assert np.array_equal(dense(parts.add(parts).whole(), [A, B, C]), 2 * v) and abs(parts.norm() - np.linalg.norm(v)) < 1e-9


def test_storage_and_stream(spark, tmp_path):
    t, v = tensor(spark, [A, B], rich=True)
    store.save_tensor(str(tmp_path / "t"), "one", t)
    store.append_tensor(str(tmp_path / "t"), "two", t * 2)
    assert np.array_equal(dense(store.load_tensor(spark, str(tmp_path / "t"), "two"), [A, B]), 2 * v)
    chain = N.train_of(t, [A, B])
    store.save_network(str(tmp_path / "n"), "chain", chain)
    back = store.load_network(spark, str(tmp_path / "n"), "chain")
    assert back.same_topology(chain) and np.allclose(dense(back.to_tensor(), [A, B]), v, atol=1e-7)
    source = str(tmp_path / "source")
    for k in range(3):
        spark.createDataFrame([(k % 2, 1.0), (1, 2.0)], "a long, re double").write.mode("append").parquet(source)
    stream = spark.readStream.schema("a long, re double").option("maxFilesPerTrigger", 1).parquet(source)
    increments.accumulate(stream, (A,), str(tmp_path / "sums"), str(tmp_path / "state")).awaitTermination()
    assert increments.current(spark, (A,), str(tmp_path / "sums")).to_list() == [2.0, 7.0]


def ising(spark, n):
    """The transverse-field chain as an operator, as a matrix, and a random state."""
    x, z = np.array([[0.0, 1.0], [1.0, 0.0]]), np.diag([1.0, -1.0])
    sites = N.fresh_sites([2] * n)
    on = lambda ops: functools.reduce(np.kron, [ops.get(k, np.eye(2)) for k in range(n)])
    h = -sum(on({k: z, k + 1: z}) for k in range(n - 1)) - 0.5 * sum(on({k: x}) for k in range(n))
    start = N.train([T.random(spark, list(t.indices), 3 + k) for k, t in N.constant_train(spark, sites).tensors.items()])
    return S.sum_of_local_terms(spark, sites, -0.5 * x, [(-z, z)]), h, start, sites


def test_lowest_state(spark):
    operator, h, start, _ = ising(spark, 3)
    energy, state = S.dmrg(operator, start, sweeps=1, steps=3)
    assert abs(energy - np.linalg.eigvalsh(h)[0]) < 1e-3 and abs(state.norm() - 1) < 1e-5


def test_step_solution_and_product(spark):
    operator, h, start, sites = ising(spark, 2)
    v = dense(start.to_tensor(), sites).ravel()
    values, vectors = np.linalg.eigh(h)
    later = S.time_step(operator, start, -0.2j, steps=4)
    assert np.allclose(dense(later.to_tensor(), sites).ravel(), (vectors * np.exp(-0.2j * values)) @ vectors.T @ v, atol=1e-5)
    solution = S.linear_solve(operator, start, start, sweeps=1, a0=5.0, rtol=1e-6)
    assert np.allclose(dense(solution.to_tensor(), sites).ravel(), np.linalg.solve(5 * np.eye(4) + h, v), atol=1e-4)
    image = S.apply_truncated(operator, start, X.Truncation(rtol=1e-8))
    assert np.allclose(dense(image.to_tensor(), sites).ravel(), h @ v, atol=1e-5) and abs(S.relative_residual(operator, start, image)) < 1e-5


def test_elementwise_and_gradient(spark):
    t, v = tensor(spark, [A, B])
    u, w = tensor(spark, [A, B])
    net, ci = cross.elementwise(lambda p, q: p * q + 1, [N.train_of(t, [A, B]), N.train_of(u, [A, B])], [A, B])
    assert np.allclose(dense(net.to_tensor(), [A, B]), v * w + 1, atol=1e-6)
    assert cross.estimate_error(net, ci, [A, B], 20) < 1e-6 and cross.global_pivots(net, ci, [A, B], 1e-4, 20) == []
    assert np.array_equal(dense(S.gradient([t, u], 0), [A, B]), w)
    assert tuple(t.argmax().values()) == np.unravel_index(np.argmax(np.abs(v).ravel(order="F")), v.shape, order="F")
