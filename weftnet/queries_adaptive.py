"""Registered queries of adaptive trains, partitioned trains and cross interpolation on trees, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import encode as E, tensor as T
from .encode import FLAG, MONTH, STATUS, table
from .functions import adaptive as A, bitops as B, cross, evaluate as V, framecross as K, quantics as Q, search as S, treecross as C
from .index import Index
from .operators import factorize as X
from .plans import network as N, patches as P, tape
from .queries import query, rows

# -- trains that refine where a function needs it --------------------------------------------------

FINE, N_FINE = 1 << 20, 20
FINE_BITS = [Index(f"f{k}", 2) for k in range(N_FINE)]
PLANE = [Index(f"q{k}", 4) for k in range(10)]
#: Order keys and customers spread over a grid of 2^20 points, and a place that depends on all of them.
SPREAD = f"""WITH c AS (SELECT (sum(o_custkey) % {FINE})::DOUBLE / {FINE} AS c, (sum(o_orderkey) % 1024)::DOUBLE / 1024 AS e FROM orders),
p AS (SELECT o_orderkey AS point, (o_orderkey * 7919 + o_custkey) % {FINE} AS x FROM orders) """


def _spread(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("point"), F.pmod(F.col("o_orderkey") * 7919 + F.col("o_custkey"), F.lit(FINE)).alias("x"))


def _places(spark, d) -> tuple[float, float]:
    r = table(spark, d, "orders").agg((F.sum("o_custkey") % FINE).alias("c"), (F.sum("o_orderkey") % 1024).alias("e")).first()
    return r.c / FINE, r.e / 1024


@query(SPREAD + f"""SELECT point, round(sqrt(abs(u - c)) * exp(-u) + CASE WHEN u < c THEN u ELSE 2 * u * u END, 4) + 0.0 AS re
  FROM (SELECT point, x::DOUBLE / {FINE} AS u FROM p), c""")
def adaptive_interpolation(spark, d):
    """A function with a cusp and a jump at a place from the table, on 2^20 points, at all stored ones."""
    c, _ = _places(spark, d)
    f = lambda u: F.sqrt(F.abs(u - c)) * F.exp(-u) + F.when(u < c, u).otherwise(2 * u * u)
    net = A.adaptive_train(spark, f, FINE_BITS, 10, 1e-12)
    at = _spread(spark, d).select("point", *(F.shiftright("x", N_FINE - 1 - k).bitwiseAND(F.lit(1)).alias(s.column) for k, s in enumerate(FINE_BITS)))
    return V.evaluate_points(net, at).select("point", (F.round("re", 4) + 0.0).alias("re"))


@query(SPREAD + """SELECT point, round(sqrt((u - c) * (u - c) + (v - e) * (v - e)) + u * v, 3) + 0.0 AS re
  FROM (SELECT point, (x % 1024)::DOUBLE / 1024 AS u, (x // 1024)::DOUBLE / 1024 AS v FROM p), c""")
def adaptive_interpolation_plane(spark, d):
    """Two dimensions: the distance from a place that the table gives, which has a tip there."""
    c, e = _places(spark, d)
    net = A.adaptive_train(spark, lambda u, v: F.sqrt((u - c) * (u - c) + (v - e) * (v - e)) + u * v, PLANE, 8, 1e-9, (0.0, 0.0), (1.0, 1.0))
    bit = lambda n: F.shiftright("x", n).bitwiseAND(F.lit(1))
    at = _spread(spark, d).select("point", *((bit(9 - k) + 2 * bit(19 - k)).alias(s.column) for k, s in enumerate(PLANE)))
    return V.evaluate_points(net, at).select("point", (F.round("re", 3) + 0.0).alias("re"))


@query(SPREAD + f"""SELECT point, round(cos(3 * u) + c * exp(-u), 3) + 0.0 AS re FROM (SELECT point, x::DOUBLE / {FINE} AS u FROM p), c""")
def sparse_interpolation(spark, d):
    """A smooth function on 2^20 points by one polynomial of local weights: cores are sparse, and values right to 1e-9."""
    c, _ = _places(spark, d)
    net = A.single_scale_train(spark, lambda u: F.cos(3 * u) + c * F.exp(-u), FINE_BITS, 40, window=8)
    at = _spread(spark, d).select("point", *(F.shiftright("x", N_FINE - 1 - k).bitwiseAND(F.lit(1)).alias(s.column) for k, s in enumerate(FINE_BITS)))
    return V.evaluate_points(net, at).select("point", (F.round("re", 3) + 0.0).alias("re"))


@query(f"WITH p AS (SELECT (o_orderkey * 7919 + o_custkey) % {FINE} AS x, count(*) AS re FROM orders GROUP BY ALL) SELECT (x - 12345 + {FINE}) % {FINE} AS w, re::BIGINT AS re FROM p")
def shift_operator_million(spark, d):
    """An operator on a train of 20 bits that holds every order; no core has more rows than there are orders."""
    fine, outs = Index("w", FINE), [Index(f"g{k}", 2) for k in range(N_FINE)]
    t = T.from_table(_spread(spark, d), {fine: F.col("x")}, F.lit(1.0)).unfuse_index(fine, FINE_BITS[::-1]).permute(FINE_BITS)
    moved = B.shift_operator(spark, list(zip(outs, FINE_BITS, strict=True)), 12345).apply(B.exact_train(t, FINE_BITS))
    return rows(B.grid_values(moved, outs, fine))


# -- affine maps with denominators -----------------------------------------------------------------

SMALL = """WITH s AS (SELECT o_custkey % 64 AS x, count(*) AS re FROM orders GROUP BY ALL), y AS (SELECT range AS y FROM range(64)) """
BITS6, OUTS6 = [Index(f"a{k}", 2) for k in range(6)], [Index(f"h{k}", 2) for k in range(6)]
GRID6 = Index("y", 64)


def _small(spark, d) -> T.Tensor:
    return T.from_table(table(spark, d, "orders"), {GRID6: F.pmod("o_custkey", F.lit(64))}, F.lit(1.0))


def _small_bits(spark, d) -> N.Network:
    return B.exact_train(_small(spark, d).unfuse_index(GRID6, BITS6[::-1]).permute(BITS6), BITS6)


@query(SMALL + "SELECT y, sum(re)::BIGINT AS re FROM s JOIN y ON (3 * y - x - 2) % 64 = 0 GROUP BY ALL")
def affine_operator_rational_periodic(spark, d):
    """y = (x + 2) / 3 around the ring: every x has a y."""
    op = B.affine_operator(spark, list(zip(OUTS6, BITS6, strict=True)), [["1/3"]], ["2/3"])
    return rows(B.grid_values(op.apply(_small_bits(spark, d)), OUTS6, GRID6))


@query(SMALL + "SELECT y, sum(CASE WHEN ((2 * y - x) // 64) % 2 <> 0 THEN -re ELSE re END)::BIGINT AS re FROM s JOIN y ON (2 * y - x) % 64 = 0 GROUP BY ALL HAVING sum(CASE WHEN ((2 * y - x) // 64) % 2 <> 0 THEN -re ELSE re END) <> 0")
def affine_operator_rational_antiperiodic(spark, d):
    """y = x / 2: an even x has two halves, and the one a turn away counts with the other sign."""
    op = B.affine_operator(spark, list(zip(OUTS6, BITS6, strict=True)), [["1/2"]], [0], Q.ANTIPERIODIC)
    return rows(B.grid_values(op.apply(_small_bits(spark, d)), OUTS6, GRID6))


@query(SMALL + "SELECT y, sum(re)::BIGINT AS re FROM s JOIN y ON (6 * y - 5 * x - 2) % 64 = 0 GROUP BY ALL")
def affine_rational_periodic(spark, d):
    """y = (5 x + 2) / 6 around the ring, on coordinates."""
    return rows(Q.affine(_small(spark, d), [GRID6], [["5/6"]], ["1/3"], [GRID6]))


# -- partitioned trains ------------------------------------------------------------------------------

O, M, U = ([Index(f"{n}{k}", 4) for k in range(3)] for n in "oms")
DIGITS = "(k // 16) % 4 AS {0}0, (k // 4) % 4 AS {0}1, k % 4 AS {0}2"
PRODUCT = """WITH a AS (SELECT l_orderkey % 64 AS o, l_partkey % 64 AS m, sum(l_quantity) AS v FROM lineitem WHERE l_partkey % 64 <= l_orderkey % 64 + 20 GROUP BY ALL),
b AS (SELECT l_partkey % 64 AS m, l_suppkey % 64 AS s, count(*) AS v FROM lineitem GROUP BY ALL),
c AS (SELECT o, s, sum(a.v * b.v) AS re FROM a JOIN b USING (m) GROUP BY ALL) """


def _digits(t: T.Tensor, *parts: tuple[Index, list[Index]]) -> T.Tensor:
    for whole, digits in parts:
        t = t.unfuse_index(whole, digits[::-1])
    return t


def _order_parts(spark, d) -> T.Tensor:
    """Quantity by order and part, both modulo 64, in digits; empty in one corner."""
    o, m = Index("o", 64), Index("m", 64)
    lines = table(spark, d, "lineitem").where(F.col("l_partkey") % 64 <= F.col("l_orderkey") % 64 + 20)
    return _digits(T.from_table(lines, {o: F.col("l_orderkey") % 64, m: F.col("l_partkey") % 64}, F.col("l_quantity")), (o, O), (m, M))


def _part_suppliers(spark, d) -> T.Tensor:
    m, s = Index("m", 64), Index("s", 64)
    return _digits(T.from_table(table(spark, d, "lineitem"), {m: F.col("l_partkey") % 64, s: F.col("l_suppkey") % 64}, F.lit(1.0)), (m, M), (s, U))


def _pairs(x: list[Index], y: list[Index]) -> list[tuple[Index, Index]]:
    return list(zip(x, y, strict=True))


def _order(x: list[Index], y: list[Index]) -> list[Index]:
    return [i for p in _pairs(x, y) for i in p]


@query(PRODUCT + "SELECT o // 16 AS o0, o // 4 % 4 AS o1, o % 4 AS o2, s // 16 AS s0, s // 4 % 4 AS s1, s % 4 AS s2, re::BIGINT AS re FROM c WHERE re <> 0")
def patched_contract(spark, d):
    """Two operators in patches of different depth, multiplied, cut to a budget and kept in patches with bonds of 8 at most."""
    a = P.patched(_order_parts(spark, d), _pairs(O, M), _order(O, M), 1, 600)
    b = P.patched(_part_suppliers(spark, d), _pairs(M, U), _order(M, U), 0, 900)
    c = a.contract_adaptive(b, 1e-10, 8, _order(O, U))
    if c.rank() > 8:
        raise ValueError("a patch has larger bonds")
    return rows(c.to_tensor().permute([*O, *U]))


@query(PRODUCT + "SELECT o * 64 + m AS point, (2 * v)::BIGINT AS re FROM a")
def patched_add(spark, d):
    """A tensor in shallow patches plus itself in deep ones, at all stored coordinates."""
    t = _order_parts(spark, d)
    a, b = (P.patched(t, _pairs(O, M), _order(O, M), depth, 800) for depth in (0, 2))
    code = lambda x: (F.col(x[0].column) * 4 + F.col(x[1].column)) * 4 + F.col(x[2].column)
    out = a.add(b).evaluate(t.df.withColumn("point", code(O) * 64 + code(M)))
    return out.select("point", F.round("re").cast("long").alias("re"))


@query(PRODUCT + "SELECT round(sum(v * v), 3) + 0.0 AS re, true AS within FROM a")
def patched_truncate(spark, d):
    """The squared norm, and whether the whole lost no more than a tenth of its norm, though no bond is over 4."""
    a = P.patched(_order_parts(spark, d), _pairs(O, M), _order(O, M), 0, 1000)
    cut = a.truncate_adaptive(0.1, 4)
    lost = cut.scale(-1).add(a).norm_squared()
    whole = a.norm_squared()
    return spark.range(1).select((F.round(F.lit(whole), 3) + 0.0).alias("re"), F.lit(lost <= 0.01 * whole and cut.rank() <= 4).alias("within"))


# -- cross interpolation on trees, and by patches ----------------------------------------------------

AXES = [Index(n, k) for n, k in (("flag", 3), ("status", 2), ("priority", 5), ("month", 12), ("segment", 5), ("region", 5), ("size", 10))]
TREE = [(0, 1), (1, 2), (1, 3), (3, 4), (4, 5), (4, 6)]
LABELS = {"flag": ("A", "N", "R"), "status": ("F", "O"), "priority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), "segment": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}
_case = lambda column, labels: "CASE " + column + " " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(labels)) + " END"
LINES = f"""WITH l AS (SELECT {_case("l_returnflag", LABELS["flag"])} AS flag, {_case("l_linestatus", LABELS["status"])} AS status, {_case("o_orderpriority", LABELS["priority"])} AS priority,
  month(o_orderdate) - 1 AS month, {_case("c_mktsegment", LABELS["segment"])} AS segment, n_regionkey AS region, l_linenumber % 10 AS size, l_quantity AS q
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
a AS (SELECT * FROM l WHERE flag IS NOT NULL AND status IS NOT NULL AND priority IS NOT NULL AND segment IS NOT NULL) """
WEIGHTS = ", ".join(f"w{k} AS (SELECT {i.id}, avg(q) / 25 AS w{k} FROM a GROUP BY ALL)" for k, i in enumerate(AXES))
TOTAL = " + ".join(f"(1 + {k} / 10.0::DOUBLE) * w{k} * w{k} * (1 + {i.id})" for k, i in enumerate(AXES))


def _lines(spark, d) -> DataFrame:
    tables = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    columns = {"flag": "l_returnflag", "status": "l_linestatus", "priority": "o_orderpriority", "segment": "c_mktsegment"}
    code: dict[str, Column] = {n: E.label_code(c, LABELS[n]) for n, c in columns.items()} | {"month": F.month("o_orderdate") - 1, "region": F.col("n_regionkey"), "size": F.pmod("l_linenumber", F.lit(10))}
    return tables.select(*(code[i.id].cast("long").alias(i.id) for i in AXES), F.col("l_quantity").alias("q")).dropna(subset=list(columns))


@query(LINES + f", {WEIGHTS}, p AS (SELECT DISTINCT flag, status, priority, month, segment, region, size FROM a) SELECT flag, status, priority, month, segment, region, size, round(1 / (1 + {TOTAL}), 4) + 0.0 AS re FROM p "
       + " ".join(f"JOIN w{k} USING ({i.id})" for k, i in enumerate(AXES)))
def tree_cross_interpolation(spark, d):
    """A function of seven labels, by the mean quantity of each label, on a tree with two branchings, at all stored combinations."""
    lines = _lines(spark, d).cache()
    means = [{r[0]: r[1] / 25 for r in lines.groupBy(i.id).agg(F.avg("q")).collect()} for i in AXES]  # at most twelve each
    weight = lambda k, x: F.get(F.array(*(F.lit(float(means[k].get(c, 0.0))) for c in range(AXES[k].dim))), x.cast("int"))

    def f(*xs: Column) -> Column:
        total = F.lit(0.0)
        for k, x in enumerate(xs):
            total = total + (1 + k / 10) * weight(k, x) * weight(k, x) * (1 + x)
        return 1 / (1 + total)

    net, _ = C.tree_cross_interpolate(spark, f, AXES, TREE, rtol=1e-11, max_rank=30, sweeps=6)
    points = lines.select(*(i.id for i in AXES)).distinct().withColumn("point", F.struct(*(i.id for i in AXES)).cast("struct<" + ",".join(f"{i.id}:bigint" for i in AXES) + ">"))
    code = F.lit(0).cast("long")
    for i in AXES:
        code = code * i.dim + F.col(i.id)
    found = V.evaluate_points(net, points.withColumn("point", code)).select("point", (F.round("re", 4) + 0.0).alias("re"))
    for k, i in enumerate(AXES):
        step = 1
        for j in AXES[k + 1 :]:
            step *= j.dim
        found = found.withColumn(i.id, F.expr(f"(point div {step}) % {i.dim}"))
    return found.select(*(i.id for i in AXES), "re")


PEAKS = [Index(f"d{k}", 4) for k in range(6)]
PEAK_SQL = """WITH c AS (SELECT (100 + sum(o_custkey) % 1800) / 4096.0::DOUBLE AS a, (2200 + sum(o_orderkey) % 1700) / 4096.0::DOUBLE AS b FROM orders),
g AS (SELECT range AS x, range / 4096.0::DOUBLE AS u FROM range(4096))
SELECT x, re FROM (SELECT x, round(1 / (1 + (900 * (u - a)) * (900 * (u - a))) + 1 / (1 + (1100 * (u - b)) * (1100 * (u - b))), 3) + 0.0 AS re FROM g, c) WHERE re <> 0"""


@query(PEAK_SQL)
def adaptive_patches(spark, d):
    """Two narrow peaks at places from the table: patches around them are small, and bonds are 8 at most."""
    r = table(spark, d, "orders").agg((100 + F.sum("o_custkey") % 1800).alias("a"), (2200 + F.sum("o_orderkey") % 1700).alias("b")).first()
    a, b = r.a / 4096, r.b / 4096

    def f(*digits: Column) -> Column:
        x = F.lit(0.0)
        for c in digits:
            x = x * 4 + c
        u = x / 4096
        return 1 / (1 + (900 * (u - a)) * (900 * (u - a))) + 1 / (1 + (1100 * (u - b)) * (1100 * (u - b)))

    out = C.adaptive_patches(spark, f, PEAKS, PEAKS[:3], 1e-10, 8)
    return rows(out.to_tensor().fuse_indices(PEAKS[::-1], Index("x", 4096))[0], 3)


# -- many points on a branching tree -----------------------------------------------------------------


@query("SELECT flag * 168 + status * 84 + month AS point, (re * 2)::BIGINT AS re, (re * -3)::BIGINT AS im FROM t")
def tree_evaluation(spark, d):
    """All stored points of a complex tensor on a star of four nodes, by contractions that points share."""
    t = E.quantity(spark, d).scale(2 - 3j)
    hub, link = {}, {}
    rest = t
    for i in (FLAG, STATUS):
        u, v = X.factorize(rest, [i])
        (link[i],) = [x for x in u.indices if x in v.indices]
        hub[i], rest = u, v
    month, centre = X.factorize(rest, [MONTH])
    net = N.Network({"flag": hub[FLAG], "status": hub[STATUS], "month": month, "centre": centre})
    points = t.df.select("flag", "status", "month", (F.col("flag") * 168 + F.col("status") * 84 + F.col("month")).alias("point"))
    return V.evaluate_points(net, points).select("point", F.round("re").cast("long").alias("re"), F.round("im").cast("long").alias("im"))


# -- few lines of large matrices, walkers, frames, both sides large ------------------------------------

SIDE = 1000
COUNTS = f"""WITH a AS (SELECT o_orderkey % {SIDE} AS k, 1 + sum(o_custkey % 7) AS a FROM orders GROUP BY ALL), b AS (SELECT o_custkey % {SIDE} AS k, 1 + sum(o_orderkey % 5) AS b FROM orders GROUP BY ALL),
x AS (SELECT range AS k, coalesce(a, 1) AS a FROM range({SIDE}) LEFT JOIN a ON k = range), y AS (SELECT range AS k, coalesce(b, 1) AS b FROM range({SIDE}) LEFT JOIN b ON k = range) """


@query(COUNTS + "SELECT o_orderkey AS point, round(0.7310585786::DOUBLE * (x.a * y.b + x.a * x.a / (1.0::DOUBLE + y.b) + y.b * y.b), 2) + 0.0 AS re FROM orders JOIN x ON x.k = o_orderkey % 1000 JOIN y ON y.k = o_custkey % 1000")
def rook_interpolation(spark, d):
    """A matrix of a million entries from weights of orders and customers, seen on few of its lines only, at all stored places."""
    orders = table(spark, d, "orders")
    side = lambda key, value: {r[0]: r[1] for r in orders.groupBy(F.col(key) % SIDE).agg(1 + F.sum(value)).collect()}  # noqa: E731  a thousand numbers
    a, b = side("o_orderkey", F.col("o_custkey") % 7), side("o_custkey", F.col("o_orderkey") % 5)
    weight = lambda w, x: F.get(F.lit([float(w.get(k, 1)) for k in range(SIDE)]), x.cast("int"))
    sites = [Index("x", SIDE), Index("y", SIDE)]
    f = lambda x, y: 0.7310585786 * (weight(a, x) * weight(b, y) + weight(a, x) * weight(a, x) / (1 + weight(b, y)) + weight(b, y) * weight(b, y))
    net, ci = cross.cross_interpolate(spark, f, sites, rtol=1e-13, max_rank=12, sweeps=2, search="rook")
    if ci.f.evaluations > SIDE * SIDE // 5:
        raise ValueError("too many lines were evaluated")
    points = orders.select(F.col("o_orderkey").alias("point"), (F.col("o_orderkey") % SIDE).alias("x"), (F.col("o_custkey") % SIDE).alias("y"))
    return V.evaluate_points(net, points).select("point", (F.round("re", 2) + 0.0).alias("re"))


@query("SELECT (sum(o_custkey) % 4096) // 1024 AS z0, (sum(o_custkey) % 1024) // 256 AS z1, (sum(o_custkey) % 256) // 64 AS z2, (sum(o_custkey) % 64) // 16 AS z3, (sum(o_custkey) % 16) // 4 AS z4, sum(o_custkey) % 4 AS z5 FROM orders")
def walkers_find_a_spike(spark, d):
    """A smooth function has a spike at a place from the table, which its train doesn't know; walkers go there."""
    at = int(table(spark, d, "orders").agg(F.sum("o_custkey") % 4096).first()[0])
    sites = [Index(f"z{k}", 4) for k in range(6)]
    place = [at // 4 ** (5 - k) % 4 for k in range(6)]

    def f(*x: Column) -> Column:
        near = sum((F.when(c == p, 1).otherwise(0) for c, p in zip(x, place, strict=True)), F.lit(0))
        return F.cos(sum((c * 0.2 * (k + 1) for k, c in enumerate(x)), F.lit(0.0))) + F.when(near == 6, 5.0).when(near == 5, 1e-3).otherwise(0.0)

    angle = lambda x: sum((c * 0.2 * (k + 1) for k, c in enumerate(x)), F.lit(0.0))
    smooth, _ = C.tree_cross_interpolate(spark, lambda *x: F.cos(angle(x)), sites, [(k, k + 1) for k in range(5)], rtol=1e-9, sweeps=4)
    found = S.worst_points(smooth, f, sites, most=1, least=1e-2, walkers=256, sweeps=2)
    return spark.createDataFrame([tuple(found[0])], ", ".join(f"{s.id} long" for s in sites))


TWELVE = [Index(f"e{k}", 2) for k in range(12)]


@query("""WITH s AS (SELECT range AS x, coalesce(n, 0) AS n FROM range(4096) LEFT JOIN (SELECT o_custkey % 16 AS k, count(*) AS n FROM orders GROUP BY ALL) ON k = range // 256)
SELECT x, round(sqrt(n + x), 4) + 0.0 AS re FROM s WHERE round(sqrt(n + x), 4) <> 0""")
def elementwise_in_frames(spark, d):
    """The square root of the sum of two trains of twelve bits: a step function of the table's counts, and a straight line."""
    step = T.from_table(table(spark, d, "orders"), {Index("k", 16): F.col("o_custkey") % 16}, F.lit(1.0)).unfuse_index(Index("k", 16), TWELVE[:4][::-1]).permute(TWELVE[:4])
    steps = B.exact_train(T.contract_pair(step, T.ones(spark, TWELVE[4:5])), TWELVE[:5])
    tail = N.constant_train(spark, TWELVE[5:])
    steps = N.train([*(steps.tensors[k] for k in range(4)), *_joined(spark, steps.tensors[4], [tail.tensors[k] for k in range(7)])])
    line = B.interpolation_train(spark, lambda u: 4096 * u, TWELVE, 1)
    net, _ = K.elementwise_in_frames(lambda a, b: F.sqrt(F.abs(a + b)), [steps, line], TWELVE, rtol=1e-10, max_rank=40, sweeps=6)
    points = spark.range(4096).select(F.col("id").alias("point"), *(F.shiftright("id", 11 - k).bitwiseAND(F.lit(1)).cast("long").alias(s.column) for k, s in enumerate(TWELVE)))
    out = V.evaluate_points(net, points).select(F.col("point").alias("x"), (F.round("re", 4) + 0.0).alias("re"))
    return out.where("re <> 0")


def _joined(spark, last: T.Tensor, rest: list[T.Tensor]) -> list[T.Tensor]:
    """Two chains end to end, by a bond of dimension 1."""
    link = Index("weft_joint", 1)
    one = T.onehot(spark, {link: 0})
    return [T.contract_pair(last, one), T.contract_pair(rest[0], one), *rest[1:]]


WIDE_O, WIDE_P = Index("wo", 5000), Index("wp", 5000)


@query("""WITH a AS (SELECT o_orderkey % 5000 AS o, sum(o_custkey % 11 + 1) AS a FROM orders GROUP BY ALL), b AS (SELECT p_partkey % 5000 AS p, sum(p_size) AS b FROM part GROUP BY ALL)
SELECT o * 5000 + p AS point, (a * b)::BIGINT AS re FROM a JOIN b ON o % 100 = p % 100""")
def svd_of_a_large_matrix(spark, d):
    """5,000 orders by 5,000 parts, of rank 100: singular vectors and values multiply back to every stored entry."""
    a = T.from_table(table(spark, d, "orders"), {WIDE_O: F.col("o_orderkey") % 5000}, F.col("o_custkey") % 11 + 1)
    b = T.from_table(table(spark, d, "part"), {WIDE_P: F.col("p_partkey") % 5000}, F.col("p_size"))
    pairs = a.df.withColumnRenamed("re", "a").join(b.df.withColumnRenamed("re", "b"), F.col("wo") % 100 == F.col("wp") % 100)
    t = T.Tensor(pairs.select("wo", "wp", (F.col("a") * F.col("b")).alias("re")), (WIDE_O, WIDE_P))
    u, v = X.factorize(t, [WIDE_O])
    points = t.df.select("wo", "wp", (F.col("wo") * 5000 + F.col("wp")).alias("point"))
    return V.evaluate_points(N.Network({"u": u, "v": v}), points).select("point", F.round("re").cast("long").alias("re"))


# -- gradients ----------------------------------------------------------------------------------------


@query("SELECT flag, status, month, (2 * re)::BIGINT AS re FROM t WHERE re <> 0")
def gradient_through_factors(spark, d):
    """The squared norm of a product of singular vectors and values, by the tensor that they were made of."""
    a = tape.leaf(E.quantity(spark, d))
    u, s, v = tape.svd(a, [MONTH])
    (gradient,) = tape.gradients(u.contract(s, list(s.value.indices)).contract(v).norm_squared(), [a])
    return rows(gradient.permute([FLAG, STATUS, MONTH]))
