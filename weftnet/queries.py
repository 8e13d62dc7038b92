"""Registered queries of the tensor engine over the star-schema tables, and the same in SQL.

Values are whole numbers where that is possible, and otherwise rounded on both sides, so that sums in any order compare.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import encode as E, tensor as T
from .encode import DAY, FLAG, MONTH, STATUS, table
from .functions import cross, quantics as Q
from .index import Index
from .operators import factorize as X, krylov as K
from .plans import network as N, partition as P, solvers as S
from .session import shared_dir
from .sources import store

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

#: Common tables of the SQL side.
BASE = """WITH t AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS status,
  (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS month, sum(l_quantity) AS re FROM lineitem GROUP BY ALL),
c AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS month, count(*) AS re
  FROM lineitem GROUP BY ALL),
g AS (SELECT datediff('day', DATE '1995-01-01', l_shipdate::DATE) AS day, sum(l_quantity) AS re FROM lineitem GROUP BY ALL) """


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else BASE + sql
        return f

    return add


def rows(t: T.Tensor, digits: int | None = None) -> DataFrame:
    """Coordinates as integers and values as whole numbers, or rounded; stored zeros are left out."""
    value = (lambda v: F.round(v).cast("long")) if digits is None else (lambda v: F.round(v, digits) + 0.0)
    out = t.df.select(*(F.col(i.column).cast("long").alias(i.id) for i in t.indices), *(value(F.col(v)).alias(v) for v in t.values))
    keep = F.lit(False)
    for v in t.values:
        keep = keep | (F.col(v) != 0)
    return out.where(keep)


def number(spark: SparkSession, value: float, digits: int = 6) -> DataFrame:
    return spark.range(1).select((F.round(F.lit(float(value)), digits) + 0.0).alias("re"))


# -- building, selecting, reshaping ---------------------------------------------------------------


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def tensor_from_table(spark, d):
    return rows(E.quantity(spark, d))


@query("SELECT flag, month, re::BIGINT AS re FROM t WHERE status = 1")
def select_indices(spark, d):
    return rows(E.quantity(spark, d).select_indices({STATUS: 1}))


@query("SELECT flag, status, month, re::BIGINT AS re FROM t WHERE status = 1 AND flag = 2")
def mask_index(spark, d):
    return rows(E.quantity(spark, d).mask_index({STATUS: 1, FLAG: 2}))


@query("SELECT k, status, month, re::BIGINT AS re FROM t JOIN (VALUES (0, 2), (1, 0), (2, 2)) v(k, f) ON f = flag")
def index_select(spark, d):
    t, fresh = E.quantity(spark, d).index_select(FLAG, [2, 0, 2])
    return rows(t.replace_indices((fresh, Index("k", 3))))


@query("SELECT month * 6 + status * 3 + flag AS fused, re::BIGINT AS re FROM t")
def fuse_indices(spark, d):
    t, _ = E.quantity(spark, d).fuse_indices([FLAG, STATUS, MONTH], Index("fused", 6 * MONTH.dim))
    return rows(t)


@query("SELECT (month // 12) AS year, month % 12 AS moy, flag, status, re::BIGINT AS re FROM t")
def unfuse_index(spark, d):
    return rows(E.quantity(spark, d).unfuse_index(MONTH, [Index("moy", 12), Index("year", 7)]))


@query("SELECT month, status, flag, re::BIGINT AS re FROM t")
def permute_indices(spark, d):
    return rows(E.quantity(spark, d).permute([MONTH, STATUS, FLAG]))


@query("SELECT flag, month, 0 AS which, sum(re)::BIGINT AS re FROM t GROUP BY ALL UNION ALL SELECT flag, month, 1, re::BIGINT FROM c")
def stack_along_new_index(spark, d):
    return rows(T.stack([E.quantity(spark, d).sum_over([STATUS]), E.lines(spark, d)], Index("which", 2)))


@query("SELECT flag, month AS m, sum(re)::BIGINT AS re FROM t GROUP BY ALL UNION ALL SELECT flag, month + 84, re::BIGINT FROM c")
def direct_sum(spark, d):
    t, (fresh,) = T.direct_sum(E.quantity(spark, d).sum_over([STATUS]), E.lines(spark, d), [(MONTH, MONTH)])
    return rows(t.replace_indices((fresh, Index("m", fresh.dim))))


@query("SELECT flag, month, re::BIGINT AS re FROM t WHERE flag = status")
def diagonal_slice(spark, d):
    pad = Index("status", 3)
    wide = T.Tensor(E.quantity(spark, d).df, (FLAG, pad, MONTH))
    return rows(wide.diagonal(FLAG, pad))


@query("SELECT month, sum(re)::BIGINT AS re FROM t WHERE flag = 1 GROUP BY ALL")
def onehot_projection(spark, d):
    return rows(T.contract([E.quantity(spark, d), T.onehot(spark, {FLAG: 1}), T.ones(spark, [STATUS])]))


@query("SELECT flag, month, flag AS other, sum(re)::BIGINT AS re FROM t GROUP BY ALL")
def delta_tensor(spark, d):
    """The identity between two flags, on the quantity of each."""
    t = E.quantity(spark, d).sum_over([STATUS])
    return rows(T.contract_pair(t, T.delta(spark, [(FLAG, Index("other", 3))]), retain=[FLAG]))


def _lines_by_month(spark, d) -> T.Tensor:
    return E.lines(spark, d).sum_over([FLAG])


def _weight(spark, d, most: int) -> int:
    """A small whole number that depends on all lines."""
    return table(spark, d, "lineitem").count() % most + 1


#: The same weight in SQL.
WEIGHT = "(SELECT count(*) % {} + 1 FROM lineitem)"


# -- contraction ----------------------------------------------------------------------------------

ORDER_TABLES = """WITH l AS (SELECT l_orderkey AS o, l_suppkey AS s, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) """
BIG = 1 << 40
ORDER, SUPPLIER, CUSTOMER = Index("o", BIG), Index("s", BIG), Index("c", BIG)
CUSTOMER_NATION, SUPPLIER_NATION = Index("cn", 25), Index("sn", 25)


def _order_lines(spark, d):
    return T.from_table(table(spark, d, "lineitem"), {ORDER: F.col("l_orderkey"), SUPPLIER: F.col("l_suppkey")}, F.col("l_quantity"))


def _supplier_nation(spark, d):
    return T.from_table(table(spark, d, "supplier"), {SUPPLIER: F.col("s_suppkey"), SUPPLIER_NATION: F.col("s_nationkey")}, F.lit(1.0))


@query(ORDER_TABLES + "SELECT o, s_nationkey AS sn, sum(q)::BIGINT AS re FROM l JOIN supplier ON s = s_suppkey GROUP BY ALL")
def contract_pair(spark, d):
    return rows(T.contract_pair(_order_lines(spark, d), _supplier_nation(spark, d)))


@query(ORDER_TABLES + "SELECT c_nationkey AS cn, s_nationkey AS sn, sum(q)::BIGINT AS re FROM l JOIN supplier ON s = s_suppkey JOIN orders ON o = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def contract_nary(spark, d):
    by = T.from_table(table(spark, d, "orders"), {ORDER: F.col("o_orderkey"), CUSTOMER: F.col("o_custkey")}, F.lit(1.0))
    where = T.from_table(table(spark, d, "customer"), {CUSTOMER: F.col("c_custkey"), CUSTOMER_NATION: F.col("c_nationkey")}, F.lit(1.0))
    return rows(T.contract([where, by, _order_lines(spark, d), _supplier_nation(spark, d)]).permute([CUSTOMER_NATION, SUPPLIER_NATION]))


@query("SELECT t.flag, t.status, sum(t.re * c.re)::BIGINT AS re FROM t JOIN c ON t.flag = c.flag AND t.month = c.month GROUP BY ALL")
def contract_retain(spark, d):
    return rows(T.contract([E.quantity(spark, d), E.lines(spark, d)], retain=[FLAG]))


@query("SELECT t.flag AS flag, t.status AS status, c.flag AS other, sum(t.re * c.re)::BIGINT AS re FROM t JOIN c ON t.month = c.month GROUP BY ALL")
def tensordot(spark, d):
    m = Index("m2", MONTH.dim)
    return rows(T.tensordot(E.quantity(spark, d), E.lines(spark, d).replace_indices((MONTH, m), (FLAG, Index("other", 3))), [(MONTH, m)]))


@query("SELECT a.flag, b.status, a.re * b.re AS re FROM (SELECT flag, sum(re)::BIGINT AS re FROM t GROUP BY ALL) a, (SELECT status, sum(re)::BIGINT AS re FROM t GROUP BY ALL) b")
def outer_product(spark, d):
    """Sums become 64-bit whole numbers before they are multiplied: products of large tables' sums are not exact as doubles."""
    t = E.quantity(spark, d)
    a, b = (t.sum_over(gone).map_values(lambda v: F.rint(v).cast("long")) for gone in ([STATUS, MONTH], [FLAG, MONTH]))
    return rows(T.outer_product(a, b))


@query("SELECT flag, status, sum(re * (month + 1))::BIGINT AS re FROM t GROUP BY ALL")
def weighted_sum_over_index(spark, d):
    return rows(T.weighted_sum(E.quantity(spark, d), MONTH, T.from_function(spark, [MONTH], lambda m: m + 1)))


@query("SELECT t.flag, t.status, sum(t.re * c.re)::BIGINT AS re FROM t JOIN c ON t.month = c.month AND t.flag = c.flag GROUP BY ALL")
def partial_contract(spark, d):
    m, f = Index("m2", MONTH.dim), Index("f2", 3)
    other = E.lines(spark, d).replace_indices((MONTH, m), (FLAG, f))
    return rows(T.partial_contract(E.quantity(spark, d), other, [(MONTH, m)], [(FLAG, f)]))


# -- algebra and reductions -----------------------------------------------------------------------

PAIR = "(SELECT flag, month, sum(re) AS re FROM t GROUP BY ALL) a FULL JOIN c b USING (flag, month)"


def _pair(spark, d):
    return E.quantity(spark, d).sum_over([STATUS]), E.lines(spark, d)


@query(f"SELECT * FROM (SELECT flag, month, (coalesce(a.re, 0) + coalesce(b.re, 0))::BIGINT AS re FROM {PAIR}) WHERE re <> 0")
def add(spark, d):
    a, b = _pair(spark, d)
    return rows(a + b)


@query(f"SELECT * FROM (SELECT flag, month, (coalesce(a.re, 0) - coalesce(b.re, 0))::BIGINT AS re FROM {PAIR}) WHERE re <> 0")
def sub(spark, d):
    a, b = _pair(spark, d)
    return rows(a - b)


@query(f"SELECT * FROM (SELECT flag, month, (3 * coalesce(a.re, 0) - 7 * coalesce(b.re, 0))::BIGINT AS re FROM {PAIR}) WHERE re <> 0")
def axpby(spark, d):
    a, b = _pair(spark, d)
    return rows(a.axpby(3, b, -7))


@query("SELECT flag, status, month, (-4 * re)::BIGINT AS re FROM t")
def scale_and_negate(spark, d):
    return rows(-(E.quantity(spark, d) * 4))


@query("SELECT flag, month, (a.re * b.re)::BIGINT AS re FROM (SELECT flag, month, sum(re) AS re FROM t GROUP BY ALL) a JOIN c b USING (flag, month)")
def hadamard(spark, d):
    a, b = _pair(spark, d)
    return rows(a.hadamard(b))


@query(f"SELECT flag, month, coalesce(a.re, 0)::BIGINT AS re, (-2 * coalesce(b.re, 0))::BIGINT AS im FROM {PAIR}")
def conj_of_combined(spark, d):
    a, b = _pair(spark, d)
    return rows(a.combined(b * 2).conj())


@query("SELECT round(sum(re), 6) + 0.0 AS re FROM t")
def sum_all(spark, d):
    return number(spark, E.quantity(spark, d).sum())


@query("SELECT flag, sum(re)::BIGINT AS re FROM t GROUP BY ALL")
def sum_over_indices(spark, d):
    return rows(E.quantity(spark, d).sum_over([STATUS, MONTH]))


@query("SELECT round(sqrt(sum(re * re)), 6) + 0.0 AS re FROM t")
def norm(spark, d):
    return number(spark, E.quantity(spark, d).norm())


@query("SELECT round(max(abs(re)), 6) + 0.0 AS re FROM t")
def maxabs(spark, d):
    return number(spark, E.quantity(spark, d).maxabs())


@query(f"SELECT round(sum(coalesce(a.re, 0) * coalesce(b.re, 0)), 6) + 0.0 AS re FROM {PAIR}")
def inner_product(spark, d):
    a, b = _pair(spark, d)
    return number(spark, a.inner(b))


@query(f"SELECT round(sqrt(sum((coalesce(a.re, 0) - coalesce(b.re, 0)) ** 2)) / sqrt(sum(coalesce(a.re, 0) ** 2)), 6) + 0.0 AS re FROM {PAIR}")
def distance(spark, d):
    a, b = _pair(spark, d)
    return number(spark, a.distance(b))


# -- factorizations -------------------------------------------------------------------------------


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def svd_round_trip(spark, d):
    u, v = X.factorize(E.quantity(spark, d), [MONTH])
    return rows(T.contract_pair(u, v))


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def qr_round_trip(spark, d):
    return rows(T.contract_pair(*X.qr(E.quantity(spark, d), [MONTH])))


@query("SELECT round(sum(re * re), 3) + 0.0 AS re FROM t")
def singular_values_squared(spark, d):
    _, s, _ = X.svd(E.quantity(spark, d), [MONTH])
    return number(spark, float((s**2).sum()), 3)


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def rank_revealing_lu(spark, d):
    return rows(X.rank_revealing_lu(E.quantity(spark, d), [MONTH]).full())


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def cross_from_rows_and_columns(spark, d):
    t = E.quantity(spark, d)
    return rows(X.interpolative(t, [MONTH], X.rank_revealing_lu(t, [MONTH])))


@query("SELECT month, round(sum(re) / (month % 3 + 1), 4) + 0.0 AS re FROM t GROUP BY month")
def gmres_diagonal(spark, d):
    b = E.quantity(spark, d).sum_over([FLAG, STATUS])
    scale = T.from_function(spark, [MONTH], lambda m: (m % 3) + 1)
    x, _ = K.gmres(lambda v: v.hadamard(scale), b)
    return rows(x, 4)


@query("SELECT min(n % 3 + 1)::DOUBLE AS re FROM (SELECT month, sum(re) AS n FROM c GROUP BY ALL)")
def lowest_eigenvalue(spark, d):
    """Of a diagonal that lines by month give."""
    scale = _lines_by_month(spark, d).map_values(lambda v: F.pmod(v, F.lit(3.0)) + 1)
    value, _ = K.lowest_eigenpair(lambda v: v.hadamard(scale), scale.map_values(lambda v: F.lit(1.0)), steps=5)
    return number(spark, value)


@query("SELECT month, round(exp(-0.5 * (n % 3 + 1)), 6) + 0.0 AS re FROM (SELECT month, sum(re) AS n FROM c GROUP BY ALL)")
def expm_multiply(spark, d):
    scale = _lines_by_month(spark, d).map_values(lambda v: F.pmod(v, F.lit(3.0)) + 1)
    return rows(K.expm_multiply(lambda v: v.hadamard(scale), scale.map_values(lambda v: F.lit(1.0)), -0.5, steps=5), 6)


# -- networks -------------------------------------------------------------------------------------

SITES = [FLAG, STATUS, MONTH]


def _train(spark, d):
    return N.train_of(E.quantity(spark, d), SITES)


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def train_round_trip(spark, d):
    return rows(_train(spark, d).to_tensor())


@query("SELECT round(sum(re), 3) + 0.0 AS re FROM t")
def train_sum(spark, d):
    return number(spark, _train(spark, d).sum(), 3)


@query("SELECT status, month, sum(re)::BIGINT AS re FROM t GROUP BY ALL")
def train_partial_sum(spark, d):
    return rows(_train(spark, d).partial_sum([FLAG]).to_tensor())


@query("SELECT round(sqrt(sum(re * re)), 3) + 0.0 AS re FROM t")
def train_norm(spark, d):
    return number(spark, _train(spark, d).norm(), 3)


@query("SELECT round(ln(sum(re * re)) / 2, 6) + 0.0 AS re FROM t")
def train_log_norm(spark, d):
    return number(spark, _train(spark, d).log_norm())


@query("SELECT flag, status, month, (5 * re)::BIGINT AS re FROM t")
def train_add_and_scale(spark, d):
    t = _train(spark, d)
    return rows(t.axpby(2, t, 3).to_tensor())


@query("SELECT flag, status, month, (re * re)::BIGINT AS re FROM t")
def train_hadamard(spark, d):
    t = _train(spark, d)
    return rows(t.hadamard(t).to_tensor())


@query("SELECT flag, status, month, (2 * re)::BIGINT AS re FROM t")
def train_truncate(spark, d):
    t = _train(spark, d)
    return rows(t.add(t).truncate(X.Truncation(rtol=1e-7)).to_tensor())


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def train_canonicalize(spark, d):
    return rows(_train(spark, d).canonicalize(1).to_tensor())


@query("SELECT flag * 168 + status * 84 + month AS point, re::BIGINT AS re FROM t")
def train_evaluate(spark, d):
    points = E.quantity(spark, d).df.select("flag", "status", "month", (F.col("flag") * 168 + F.col("status") * 84 + F.col("month")).alias("point"))
    return _train(spark, d).evaluate(points).select("point", F.round("re").cast("long").alias("re"))


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def train_reverse(spark, d):
    return rows(N.reverse(_train(spark, d)).to_tensor())


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def identity_operator(spark, d):
    state = _train(spark, d)
    pairs = [(i.prime(), i) for i in SITES]
    return rows(N.identity_operator(spark, pairs).apply(state).to_tensor())


@query("SELECT flag, status, month, (re * re)::BIGINT AS re FROM t")
def diagonal_operator(spark, d):
    state = _train(spark, d)
    return rows(N.diagonal_operator(state, [(i.prime(), i) for i in SITES]).apply(state).to_tensor())


@query("SELECT status, month, re::BIGINT AS re FROM t WHERE flag = 2")
def train_select(spark, d):
    return rows(_train(spark, d).select({FLAG: 2}).to_tensor())


@query("SELECT round(sum(re * re), 3) + 0.0 AS re FROM t")
def tree_inner(spark, d):
    """A star: three leaves around a centre without sites."""
    t = E.quantity(spark, d)
    core, leaves = t, {}
    for i in SITES:
        rest = [x for x in core.indices if x != i]
        u, v = X.factorize(core, rest, canonical="right")
        core, leaves[i.id] = u, v
    star = N.Network({**leaves, "centre": core})
    star.validate_tree()
    return number(spark, complex(star.inner(star)).real, 3)


@query("SELECT flag, status, round(sqrt(sum(re)), 4) + 0.0 AS re FROM t GROUP BY ALL")
def elementwise_square_root(spark, d):
    sums = N.train_of(E.quantity(spark, d).sum_over([MONTH]), [FLAG, STATUS])
    net, _ = cross.elementwise(lambda v: F.sqrt(F.greatest(v, F.lit(0.0))), [sums], [FLAG, STATUS])
    return rows(net.to_tensor().permute([FLAG, STATUS]), 4)


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def train_swap_neighbours(spark, d):
    return rows(S.swap_neighbours(_train(spark, d), 0).to_tensor())


@query("SELECT flag, status, month, (2 * re)::BIGINT AS re FROM t")
def gradient_of_norm(spark, d):
    """The derivative of sum(A * A) by A: twice that by one factor."""
    t = E.quantity(spark, d)
    return rows(S.gradient([t, t], 0) * 2)


@query("SELECT flag, status, month, re::BIGINT AS re FROM t ORDER BY re DESC, month, status, flag LIMIT 1")
def argmax(spark, d):
    t = E.quantity(spark, d)
    return rows(t.mask_index(t.argmax()))


@query(f"SELECT round(-2.0::DOUBLE * {WEIGHT.format(7)}, 5) + 0.0 AS re")
def dmrg_ising(spark, d):
    """-w sum z z on a chain of three spins, w from the table: the lowest energy is -2 w."""
    z = np.diag([1.0, -1.0]) * float(_weight(spark, d, 7)) ** 0.5
    sites = N.fresh_sites([2] * 3)
    operator = S.sum_of_local_terms(spark, sites, np.zeros((2, 2)), [(-z, z)])
    start = N.train([T.random(spark, list(t.indices), 11 + k) for k, t in N.constant_train(spark, sites).tensors.items()])
    energy, _ = S.dmrg(operator, start, sweeps=1, steps=3)
    return number(spark, energy, 5)


# -- quantics transforms --------------------------------------------------------------------------


@query("SELECT (day - 5 + 4096) % 4096 AS day, re::BIGINT AS re FROM g")
def shift_periodic(spark, d):
    return rows(Q.shift(E.daily(spark, d), {DAY: 5}))


@query("SELECT day - 100 AS day, re::BIGINT AS re FROM g WHERE day >= 100")
def shift_open(spark, d):
    return rows(Q.shift(E.daily(spark, d), {DAY: 100}, Q.OPEN))


@query("SELECT (day - 100 + 4096) % 4096 AS day, (CASE WHEN day < 100 THEN -re ELSE re END)::BIGINT AS re FROM g")
def shift_antiperiodic(spark, d):
    return rows(Q.shift(E.daily(spark, d), {DAY: 100}, Q.ANTIPERIODIC))


@query("SELECT (4096 - day) % 4096 AS day, re::BIGINT AS re FROM g")
def flip(spark, d):
    return rows(Q.flip(E.daily(spark, d), [DAY]))


@query("SELECT day, round(re * cos(0.25 * day), 4) + 0.0 AS re, round(re * sin(0.25 * day), 4) + 0.0 AS im FROM g")
def phase_rotation(spark, d):
    return rows(Q.phase_rotation(E.daily(spark, d), {DAY: 0.25}), 4)


@query("SELECT * FROM (SELECT x AS day, coalesce(sum(re) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS re FROM range(4096) r(x) LEFT JOIN g ON g.day = x) WHERE re <> 0")
def cumsum(spark, d):
    return rows(Q.cumsum(E.daily(spark, d), DAY))


@query("SELECT * FROM (SELECT x AS day, coalesce(sum(re) OVER (ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS re FROM range(4096) r(x) LEFT JOIN g ON g.day = x) WHERE re <> 0")
def triangle_upper(spark, d):
    return rows(Q.triangle(E.daily(spark, d), DAY, lower=False))


HOUR = Index("k", 32)
HOURS = "WITH h AS (SELECT hour(ts) AS x, count(*) AS re FROM events GROUP BY ALL) "


def _hours(spark, d):
    return T.from_table(table(spark, d, "events"), {HOUR: F.hour("ts")}, F.lit(1.0))


@query(HOURS + "SELECT k, round(sum(re * cos(2 * pi() * k * x / 32)) / sqrt(32), 5) + 0.0 AS re, round(-sum(re * sin(2 * pi() * k * x / 32)) / sqrt(32), 5) + 0.0 AS im FROM range(32) r(k), h GROUP BY k")
def fourier(spark, d):
    return rows(Q.fourier(_hours(spark, d), HOUR), 5)


@query(HOURS + "SELECT x AS k, re::BIGINT AS re FROM h")
def fourier_round_trip(spark, d):
    return rows(Q.fourier(Q.fourier(_hours(spark, d), HOUR), HOUR, sign=1).real_part())


@query(HOURS + ", w(y, v) AS (VALUES (0, 2), (1, 1), (31, 1)) SELECT (x + y) % 32 AS k, sum(re * v)::BIGINT AS re FROM h, w GROUP BY ALL")
def difference_kernel(spark, d):
    kernel = T.from_dense(spark, [Index("lag", 32)], [2.0, 1.0, *[0.0] * 29, 1.0])
    return rows(Q.difference_kernel(kernel, _hours(spark, d), HOUR))


@query("SELECT (3 * day + 7) % 4096 AS day2, re::BIGINT AS re FROM g")
def affine_periodic(spark, d):
    return rows(Q.affine(E.daily(spark, d), [DAY], [[3]], [7], [Index("day2", 4096)]))


@query("SELECT day // 2 AS half, re::BIGINT AS re FROM g WHERE day % 2 = 0")
def affine_rational(spark, d):
    from fractions import Fraction

    return rows(Q.affine(E.daily(spark, d), [DAY], [[Fraction(1, 2)]], [0], [Index("half", 4096)], Q.OPEN))


@query("SELECT (day >> 11) & 1 AS top, sum(re)::BIGINT AS re FROM g GROUP BY ALL")
def quantics_bits(spark, d):
    t, group = Q.bits(E.daily(spark, d), DAY)
    return rows(t.sum_over(group[1:]).replace_indices((group[0], Index("top", 2))))


@query("SELECT day, re::BIGINT AS re FROM g")
def quantics_bits_round_trip(spark, d):
    t, group = Q.bits(E.daily(spark, d), DAY)
    return rows(Q.number(t, group, DAY)[0])


@query("SELECT y, re::BIGINT AS re FROM range(64) r(y) JOIN g ON day = y * y % 4096")
def pullback(spark, d):
    return rows(Q.pullback(E.daily(spark, d), DAY, Index("y", 64), lambda y: y * y % 4096))


# -- functions ------------------------------------------------------------------------------------


@query("WITH r AS (SELECT x, y, z FROM range(4) a(x), range(5) b(y), range(6) c(z)), n AS (SELECT l_linenumber % 4 AS x, count(*) AS n FROM lineitem GROUP BY ALL) SELECT x, y, z, n + x + 2 * y * z AS re FROM r JOIN n USING (x)")
def cross_interpolation(spark, d):
    """Lines by their number modulo 4, and a product of two other coordinates."""
    sites = [Index("x", 4), Index("y", 5), Index("z", 6)]
    found = {r[0]: r[1] for r in table(spark, d, "lineitem").groupBy(F.col("l_linenumber") % 4).count().collect()}
    lines = F.array(*(F.lit(float(found.get(k, 0))) for k in range(4)))
    net, _ = cross.cross_interpolate(spark, lambda x, y, z: F.get(lines, x.cast("int")) + x + 2 * y * z, sites)
    return rows(net.to_tensor().permute(sites))


@query("SELECT count(DISTINCT (x0, x1)) AS evaluations, count(*) AS n, count(DISTINCT (x0, x1)) AS cached FROM (SELECT l_linenumber % 10 AS x0, l_quantity % 10 AS x1 FROM lineitem)")
def cached_function(spark, d):
    """A function of two columns at every line: evaluated once for each pair that occurs."""
    f = cross.CachedFunction(spark, lambda x, y: x * y, [10, 10])
    points = table(spark, d, "lineitem").select((F.col("l_linenumber") % 10).cast("long").alias("x0"), (F.col("l_quantity") % 10).cast("long").alias("x1"))
    n = f.eval(points).count()
    f.eval(points.limit(7)).count()
    return spark.range(1).select(F.lit(f.evaluations).alias("evaluations"), F.lit(n).alias("n"), F.lit(f.is_cached(points.distinct()).where("cached").count()).alias("cached"))


@query(f"WITH r AS (SELECT x FROM range(64) a(x)) SELECT x AS point, round(cos(3 * (x / 64.0)) + {WEIGHT.format(5)} * (x / 64.0), 5) + 0.0 AS re FROM r")
def quantics_cross_interpolation(spark, d):
    w = _weight(spark, d, 5)
    q = cross.quantics_cross_interpolate(spark, lambda x: F.cos(3 * x) + w * x, 6)
    return q.evaluate(spark.range(64).select(F.col("id").alias("point"), F.col("id").alias("x"))).select("point", (F.round("re", 5) + 0.0).alias("re"))


@query(f"SELECT round((exp(1) - 1) ** 2 * 0.5 * {WEIGHT.format(5)}, 6) + 0.0 AS re")
def integrate(spark, d):
    w = _weight(spark, d, 5)
    return number(spark, cross.integrate(spark, lambda x, y, z: w * F.exp(x) * F.exp(y) * z, 3, order=6))


@query("WITH r AS (SELECT x FROM range(64) a(x)) SELECT * FROM (SELECT x, round(" + WEIGHT.format(9) + " * ((x / 64.0) ** 3 - (x / 64.0)), 6) + 0.0 AS re FROM r) WHERE re <> 0")
def chebyshev_interpolation(spark, d):
    w = _weight(spark, d, 9)
    return rows(cross.interpolate_grid(spark, lambda x: w * (x**3 - x), Index("x", 64), 4), 6)


# -- partitions, storage, streams -----------------------------------------------------------------


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def partition_union(spark, d):
    return rows(P.Partitioned.split(E.quantity(spark, d), FLAG).whole())


@query("SELECT flag, status, month, re::BIGINT AS re FROM t WHERE flag = 1 AND month = 3")
def partition_pruning(spark, d):
    return rows(P.Partitioned.split(E.quantity(spark, d), FLAG).prune({FLAG: 1, MONTH: 3}).whole())


@query("SELECT t.flag, t.status, sum(t.re * c.re)::BIGINT AS re FROM t JOIN (SELECT month, sum(re) AS re FROM c GROUP BY ALL) c ON t.month = c.month GROUP BY ALL")
def partition_contract(spark, d):
    parts = P.Partitioned.split(E.quantity(spark, d), FLAG)
    return rows(parts.contract(P.Partitioned.of([(P.Projector(), E.lines(spark, d).sum_over([FLAG]))])).whole())


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def partition_adaptive(spark, d):
    return rows(P.adaptive(E.quantity(spark, d), [FLAG, STATUS], 100).whole())


@query("SELECT flag, status, month, re::BIGINT AS re FROM t")
def save_and_load(spark, d):
    path = f"{shared_dir(spark)}/tensors-{uuid.uuid4().hex}"
    store.save_tensor(path, "quantity", E.quantity(spark, d), mode="overwrite")
    return rows(store.load_tensor(spark, path, "quantity"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_adaptive, queries_networks  # noqa: F401  register their own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running total of daily quantity: the strict prefix sum on the grid of days, plus the day itself."""
    t = E.daily(spark, sf_dir)
    return rows(Q.cumsum(t, DAY).add(t))
