"""Operators on tensors over the tables' own keys (a coordinate for every order and supplier), and those without a tensor result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorweft.functions import scalars
from tensorweft.functions.functors import Registry
from tensorweft.operators import elementwise as E
from tensorweft.operators import linalg, reduce, views
from tensorweft.operators.algebra import Spread, add, contract, custom, tasks
from tensorweft.operators.tensor import Tensor
from tensorweft.plans import spaces
from tensorweft.plans.queries import _folder, query
from tensorweft.plans.runtime import Runtime
from tensorweft.sources.storage import Catalog, load, read_table, save


def Q(spark, d, extents=None, sums=True) -> Tensor:
    """Q(o,s): quantities by order and supplier."""
    return Tensor.from_table(read_table(spark, d, "lineitem"), {"o": "l_orderkey", "s": "l_suppkey"}, "l_quantity", extents, name="Q", sums=sums)


def N(spark, d, sums=True) -> Tensor:
    """N(o,s): line numbers by order and supplier."""
    return Tensor.from_table(read_table(spark, d, "lineitem"), {"o": "l_orderkey", "s": "l_suppkey"}, "l_linenumber", name="N", sums=sums)


def L3(spark, d) -> Tensor:
    """T(o,p,s): quantities by order, part and supplier."""
    return Tensor.from_table(read_table(spark, d, "lineitem"), {"o": "l_orderkey", "p": "l_partkey", "s": "l_suppkey"}, "l_quantity", name="T")


def dealt(spark, d, *by: str) -> tuple[Tensor, Tensor, Spread]:
    """Q and N, to be summed in the tasks that their rows are dealt over by some labels."""
    return Q(spark, d, sums=False), N(spark, d, sums=False), Spread(by, tasks(read_table(spark, d, "lineitem")))


def product(spark, d, p: str, by: tuple[str, ...], restrict=None) -> DataFrame:
    """Of Q and N by the pattern."""
    q, n, spread = dealt(spark, d, *by)
    return contract(p, q, n, restrict=restrict, spread=spread).df


def sides(spark, d) -> tuple[int, int]:
    """One more than the largest order and supplier."""
    table = read_table(spark, d, "lineitem")
    a, b = table.agg(F.max("l_orderkey") + 1, F.max("l_suppkey") + 1).first()
    return int(a or 0), int(b or 0)


def groups(spark, d) -> tuple[Tensor, int]:
    """T(o,g): quantities by order and one of eight groups of suppliers; and the tasks that the table's lines need."""
    table, (rows, _) = read_table(spark, d, "lineitem"), sides(spark, d)
    return Tensor.from_table(table, {"o": "l_orderkey", "g": F.expr("l_suppkey % 8")}, "l_quantity", (rows, 8), sums=False), tasks(table)


WITH = """WITH Q AS (SELECT l_orderkey AS o, l_suppkey AS s, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
N AS (SELECT l_orderkey AS o, l_suppkey AS s, CAST(sum(l_linenumber) AS DOUBLE) AS v FROM lineitem GROUP BY ALL),
T AS (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
X AS (SELECT max(l_orderkey) + 1 AS no, max(l_suppkey) + 1 AS ns FROM lineitem)
"""


@query(WITH + "SELECT o, s, sum(v) AS v FROM (SELECT o, s, v FROM Q UNION ALL SELECT o, s, v * -3 FROM N) GROUP BY ALL")
def keys_addition(spark, d):
    q, n, spread = dealt(spark, d, "o", "s")
    return add(n, q, -3.0, spread).df


@query(WITH + "SELECT x.s AS a, y.s AS b, sum(x.v * y.v) AS v FROM Q x JOIN N y USING (o) GROUP BY ALL")
def keys_contraction(spark, d):
    return product(spark, d, "D(a,b)+=L(o,a)*R(o,b)", ("o",))


@query(WITH + "SELECT o, s, Q.v * N.v AS v FROM Q JOIN N USING (o, s)")
def keys_hadamard(spark, d):
    return product(spark, d, "H(o,s)+=L(o,s)*R(o,s)", ("o", "s"))


@query(WITH + "SELECT o, x.s AS a, y.s AS b, sum(x.v * y.v) AS v FROM Q x JOIN N y USING (o) WHERE x.s < y.s GROUP BY ALL")
def keys_hyper_contraction(spark, d):
    """A batch label, no sum, restricted to a < b."""
    return product(spark, d, "D(o,a,b)+=L(o,a)*R(o,b)", ("o",), F.col("a") < F.col("b"))


@query(WITH + "SELECT o, sum(v) AS v FROM T WHERE p = s GROUP BY o")
def keys_trace(spark, d):
    return E.trace("D(o)+=T(o,x,x)", L3(spark, d)).df


@query(WITH + "SELECT o - 100 AS o, s - 2 AS s, v FROM Q WHERE o >= 100 AND o < 1100 AND s >= 2 AND s < 9")
def keys_slice(spark, d):
    return views.SliceView(Q(spark, d, sides(spark, d)), (100, 2), (1000, 7)).tensor().df


@query(WITH + "SELECT o, s, CASE WHEN o >= 100 AND o < 1100 AND s >= 2 AND s < 9 THEN 2 * v ELSE v END AS v FROM Q")
def keys_slice_write(spark, d):
    """The window, doubled, written back over itself."""
    view = views.SliceView(Q(spark, d, sides(spark, d)), (100, 2), (1000, 7))
    return view.write(E.scale(view.tensor(), 2.0)).df.filter("v <> 0")


@query(WITH + "SELECT o + no * s AS m, v FROM Q, X")
def keys_folding(spark, d):
    return E.fold(Q(spark, d, sides(spark, d)), ("o", "s"), "m").df


@query(WITH + "SELECT coalesce(Q.o, N.o) AS o, coalesce(Q.s, N.s) AS s, least(coalesce(Q.v, 0), 7 * coalesce(N.v, 0)) AS v FROM Q FULL JOIN N ON Q.o = N.o AND Q.s = N.s")
def keys_custom(spark, d):
    q, n, spread = dealt(spark, d, "o", "s")
    return custom(lambda x, y: F.least(x, y * 7), q, n, spread=spread).df


@query(WITH + "SELECT sum(abs(v)) AS norm1, sum(v * v) AS norm2, max(abs(v)) AS max_abs, min(abs(v)) AS least FROM Q")
def keys_norms(spark, d):
    q = Q(spark, d)
    return reduce.norm1(q).crossJoin(reduce.norm2(q)).crossJoin(reduce.max_abs(q)).crossJoin(q.df.agg(F.min(F.abs("v")).alias("least")))  # one row each


_BOTH = "SELECT coalesce(Q.v, 0) AS x, coalesce(N.v, 0) AS y FROM Q FULL JOIN N ON Q.o = N.o AND Q.s = N.s"


@query(WITH + f"SELECT sum(CASE WHEN abs(x - y) > 1e-13 THEN 1 ELSE 0 END) AS diff_absolute, sum(CASE WHEN abs(x - y) > 0.5 * greatest(x, y) THEN 1 ELSE 0 END) AS diff_relative FROM ({_BOTH})")
def keys_comparison(spark, d):
    q, n, spread = dealt(spark, d, "o", "s")
    named = lambda df, name: df.select(F.col("diff_count").alias(name))
    return named(reduce.compare(q, n, spread=spread), "diff_absolute").crossJoin(named(reduce.compare(q, n, relative=True, threshold=0.5, spread=spread), "diff_relative"))


@query("SELECT bool_or(l_linenumber = 7) AS has_nan FROM lineitem")
def keys_nan_search(spark, d):
    """Quantities, not a number in every seventh line of an order."""
    lines = read_table(spark, d, "lineitem")
    value = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return reduce.has_nan(Tensor.from_table(lines, {"o": "l_orderkey", "n": "l_linenumber"}, value))


@query(WITH + "SELECT o, s, v, CAST(x AS INTEGER) AS source FROM (SELECT *, 0 AS x FROM Q WHERE s < 5 UNION ALL SELECT *, 1 FROM N WHERE s < 5)")
def keys_merge(spark, d):
    """Two tensors' rows in the order of their coordinates, each with where it comes from."""
    return views.merged(E.restrict(Q(spark, d), "s < 5"), E.restrict(N(spark, d), "s < 5"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey < l_suppkey THEN -1 WHEN l_partkey > l_suppkey THEN 1 WHEN l_linenumber < 3 THEN -1 WHEN l_linenumber = 3 THEN 0 ELSE 1 END AS sign FROM lineitem")
def index_comparison(spark, d):
    lines = read_table(spark, d, "lineitem")
    pair = lines.select("l_orderkey", "l_linenumber", F.array("l_partkey", F.col("l_linenumber").cast("bigint")).alias("a"), F.array("l_suppkey", F.lit(3).cast("bigint")).alias("b"))
    return pair.select("l_orderkey", "l_linenumber", views.compare_indices("a", "b").alias("sign"))


@query(WITH + "SELECT o, s, v, row_number() OVER (ORDER BY s, o) AS place FROM Q ORDER BY s, o LIMIT 50")
def keys_order(spark, d):
    """The first rows by supplier, then order."""
    rows = views.ordered(Q(spark, d), "s", "o").limit(50).collect()  # a report of 50 rows
    return spark.createDataFrame([(r.o, r.s, r.v, i + 1) for i, r in enumerate(rows)], "o long, s long, v double, place long")


@query(WITH + "SELECT CAST(2 AS INTEGER) AS rank, CAST(no AS BIGINT) AS orders, CAST(ns AS BIGINT) AS suppliers, CAST(no * ns AS BIGINT) AS volume, CAST(no * ns * 8 AS BIGINT) AS bytes, 'R8' AS kind, false AS empty FROM X")
def tensor_description(spark, d):
    q = Q(spark, d, sides(spark, d))
    return spark.createDataFrame([(q.rank, *q.shape, q.volume, q.bytes, q.kind, q.empty)], "rank int, orders long, suppliers long, volume long, bytes long, kind string, empty boolean")


@query("SELECT sum(l_quantity) AS v FROM lineitem")
def scalar_read(spark, d):
    """A scalar tensor's value, read to the driver."""
    return spark.createDataFrame([(float(Tensor.from_table(read_table(spark, d, "lineitem"), {}, "l_quantity").get_scalar()),)], "v double")


@query("SELECT CAST(c_nationkey AS BIGINT) AS n, sum(round(c_acctbal)) AS v FROM customer GROUP BY ALL HAVING v <> 0")
def local_read(spark, d):
    """A slice of 25 elements as a local array, and back."""
    t = Tensor.from_table(read_table(spark, d, "customer"), {"n": "c_nationkey"}, F.round("c_acctbal"), (25,))
    return Tensor.from_numpy(spark, t.to_numpy(), ("n",)).df.filter("v <> 0")


@query(WITH + "SELECT CAST(count(*) AS BIGINT) AS rows, sum(v) AS total FROM Q")
def traversal(spark, d):
    """Every row seen once by a function that acts outside: here it adds up."""
    context, q = spark.sparkContext, Q(spark, d)
    rows, total = context.accumulator(0), context.accumulator(0.0)

    def see(part):
        for r in part:
            rows.add(1)
            total.add(r.v)

    Registry().traverse(q, see)
    return spark.createDataFrame([(rows.value, total.value)], "rows long, total double")


@query("SELECT * FROM (VALUES ('A', 'created'), ('B', 'defined'), ('C', 'updated'), ('D', 'absent')) t(name, status)")
def catalog_status(spark, d):
    """Tensors after create, put, put again and destroy."""
    held, q = Catalog(), Q(spark, d)
    held.create(q, "A")
    held.put("B", q)
    held.put("C", q)
    held.put("C", E.scale(q, 2.0))
    held.put("D", q)
    held.destroy("D")
    return spark.createDataFrame([(x, held.status(x)) for x in "ABCD"], "name string, status string")


@query(WITH + "SELECT o, s, 2 * v AS v FROM Q")
def deferred_operations(spark, d):
    """A write and, once it is done, a read; then the rows are kept near the executors and let go again."""
    r, path = Runtime(spark), _folder(spark, "deferred")
    first = r.submit(lambda: save(E.scale(Q(spark, d), 2.0), path), "write")
    second = r.submit(lambda: load(spark, path), "read", after=[first])
    t = Runtime.place(second.wait())
    r.wait_all()
    assert r.status()["completed"] == 2
    return Runtime.discard(t).df


@query(WITH + "SELECT o, s, CAST(sum(v) AS DOUBLE) AS v FROM (SELECT o, s, 2 * v AS v FROM Q UNION ALL SELECT o, s, v FROM N) GROUP BY ALL")
def deferred_arguments(spark, d):
    """An addition put together first and run later."""
    late = Runtime(spark).defer("sum").argument(0, N(spark, d)).argument(1, Q(spark, d)).specify("D(o,s)+=L(o,s)", 2.0)
    late.execute()
    return late.output().df


@query(WITH + "SELECT o, s, v FROM Q ORDER BY abs(v) DESC, o, s LIMIT 1")
def largest_by_name(spark, d):
    value, (o, s) = Registry().read(Q(spark, d), "_TensorMax_")
    return spark.createDataFrame([(o, s, value)], "o long, s long, v double")


@query(WITH + "SELECT CAST(o // 4096 AS BIGINT) AS b_o, CAST(s // 32 AS BIGINT) AS b_s, count(*) AS n FROM Q GROUP BY ALL")
def block_decomposition(spark, d):
    """Rows in each block of 4096 orders and 32 suppliers."""
    return views.block_keys(Q(spark, d), (4096, 32)).groupBy("b_o", "b_s").agg(F.count("*").alias("n"))


@query(WITH + """SELECT CAST(a AS BIGINT) AS o_from, CAST(c AS BIGINT) AS s_from, count(v) AS n FROM (SELECT * FROM (VALUES (0, 6), (6, 12)) x(a, b), (VALUES (0, 4), (4, 8)) y(c, e)) LEFT JOIN
(SELECT l_orderkey % 12 AS o, l_suppkey % 8 AS s, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) ON o >= a AND o < b AND s >= c AND s < e GROUP BY ALL""")
def subtensor_split(spark, d):
    """Rows in each part of a 12 x 8 tensor cut into parts of 24 elements at most."""
    t = Tensor.from_table(read_table(spark, d, "lineitem"), {"o": F.expr("l_orderkey % 12"), "s": F.expr("l_suppkey % 8")}, "l_quantity", (12, 8))
    parts = views.subtensors(t, 24)
    inside = [E.inside(t, v.offsets, v.extents) for v in parts]
    number = F.coalesce(*(F.when(x, F.lit(i)) for i, x in enumerate(inside)))
    counts = {r.k: r.n for r in t.df.groupBy(number.alias("k")).agg(F.count("*").alias("n")).collect()}  # a row a part
    return spark.createDataFrame([(*v.offsets, counts.get(i, 0)) for i, v in enumerate(parts)], "o_from long, s_from long, n long")


@query("SELECT p_partkey, least(p_partkey, 20) AS lo, greatest(p_partkey + p_size, 60) AS hi FROM part")
def range_unions(spark, d):
    part = read_table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("a"), (F.col("p_partkey") + F.col("p_size")).alias("b"), F.lit(20).cast("bigint").alias("x"), F.lit(60).cast("bigint").alias("y"))
    return part.select("p_partkey", spaces.range_union("a", "b", "x", "y").alias("u")).select("p_partkey", "u.lo", "u.hi")


@query("SELECT k, CAST(round(k * n / 7.0) AS BIGINT) AS lo, CAST(round((k + 1) * n / 7.0) AS BIGINT) AS hi, CAST(ceil(n / 100.0) AS BIGINT) AS segments FROM (SELECT count(*) AS n FROM supplier), range(7) t(k)")
def range_split(spark, d):
    """The suppliers' range in seven nearly equal parts, and its number of segments of 100."""
    n = read_table(spark, d, "supplier").count()
    parts = spaces.split_range(0, n, 7)
    return spark.createDataFrame([(k, a, b, spaces.segment_count(n, 100)) for k, (a, b) in enumerate(parts)], "k long, lo long, hi long, segments long")


@query("SELECT s_suppkey, [CAST(s_suppkey AS DOUBLE) * 3 + 1, 14.0] AS v FROM supplier".replace("[CAST(s_suppkey AS DOUBLE) * 3 + 1, 14.0] AS v", "CAST(s_suppkey AS DOUBLE) * 3 + 1 AS x, CAST(37 AS DOUBLE) AS y"))
def vector_operations(spark, d):
    """3 (key, 12) + (1, 1)."""
    s = read_table(spark, d, "supplier").select("s_suppkey", F.array(F.col("s_suppkey").cast("double"), F.lit(12.0)).alias("v"))
    made = s.select("s_suppkey", spaces.vector_add(spaces.vector_scale("v", 3.0), F.array(F.lit(1.0), F.lit(1.0))).alias("w"))
    return made.select("s_suppkey", F.col("w")[0].alias("x"), F.col("w")[1].alias("y"))


@query("SELECT * FROM (VALUES ('low', 'subspace', 8, 0), ('mid', 'subspace', 16, 2), ('k', 'label', NULL, NULL), ('gone', 'absent', NULL, NULL), ('s', 'space', NULL, NULL)) t(name, status, around, start)")
def space_registry(spark, d):
    """What names stand for, and where subspaces lie in the smallest tree node that holds them."""
    r = spaces.SpaceRegistry()
    r.register_space("s", 16)
    for name, lo, hi in (("low", 0, 5), ("mid", 2, 11), ("gone", 1, 2)):
        r.register_subspace(name, "s", lo, hi)
    r.register_label("k", "low")
    r.unregister_subspace("gone")
    rows = [(n, r.status(n), *(r.embedding(n) if r.status(n) == "subspace" else (None, None))) for n in ("low", "mid", "k", "gone", "s")]
    return spark.createDataFrame(rows, "name string, status string, around int, start int")


@query("SELECT CAST(0 AS BIGINT) AS lo, CAST(4 AS BIGINT) AS hi")
def subspace_common(spark, d):
    """The smallest node over the first vector and the fourth."""
    space = spaces.Space("s", 8)
    leaf = {lo: me for me, _, _, lo, hi in space.nodes if hi - lo == 1}
    return spaces.common_subspace(space.table(spark), leaf[0], leaf[3]).select("lo", "hi")


@query("SELECT n, CAST(length(regexp_replace(w, '[^,]', '', 'g')) + 1 AS INTEGER) AS cycles FROM (VALUES (0, 'a,b,c'), (1, 'a'), (2, 'a,b')) t(n, w)".replace("SELECT n, ", "SELECT CAST(n AS BIGINT) AS n, "))
def permutation_cycle_counts(spark, d):
    """Of three numbers left as they are, rotated, and with two swapped."""
    return spark.createDataFrame([(n, len(scalars.permutation_cycles(p))) for n, p in enumerate(([0, 1, 2], [1, 2, 0], [1, 0, 2]))], "n long, cycles int")


@query("WITH p AS (SELECT l_orderkey % 4 AS k, l_orderkey, l_linenumber FROM lineitem) SELECT l_orderkey, l_linenumber, CAST((4 - k) % 4 AS INTEGER) AS first FROM p")
def permutation_inverses(spark, d):
    """Where 0 goes in the inverse of a rotation of four by the order's key."""
    lines = read_table(spark, d, "lineitem")
    p = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda x: F.pmod(x + F.col("l_orderkey"), F.lit(4)).cast("int"))
    return lines.select("l_orderkey", "l_linenumber", scalars.inverse_permutation(p)[0].alias("first"))


@query("SELECT count(DISTINCT (l_orderkey, l_suppkey)) AS hashes FROM lineitem")
def array_hashes(spark, d):
    """Different pairs of keys, told apart by the hash of their array."""
    return read_table(spark, d, "lineitem").select(scalars.array_hash(F.array("l_orderkey", "l_suppkey")).alias("h")).agg(F.countDistinct("h").alias("hashes"))


@query(WITH + "SELECT s AS x, t AS y, CAST(CASE WHEN s = t THEN 1 ELSE 0 END AS DOUBLE) AS v FROM (SELECT DISTINCT CAST(unnest(generate_series(0, 7)) AS BIGINT) AS s), (SELECT CAST(unnest(generate_series(0, 7)) AS BIGINT) AS t)")
def keys_orthogonal(spark, d):
    """Eight groups of suppliers by all orders: products of the columns made orthonormal, to nine digits."""
    t, many = groups(spark, d)
    u = linalg.gram_schmidt("D(o,g)=L(o,m)*R(m,g)", t, tasks=many)
    return contract("G(x,y)+=L(o,x)*R(o,y)", u, u, spread=Spread(("o",), many)).df.select("x", "y", (F.round("v", 9) + F.lit(0.0)).alias("v"))


@query(WITH + "SELECT round(sum(v * v), 4) AS squares FROM (SELECT l_orderkey AS o, l_suppkey % 8 AS g, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)")
def keys_singular_values(spark, d) -> DataFrame:
    """The sum of the squares of the singular values is that of the elements."""
    t, many = groups(spark, d)
    return linalg.singular_values("D(o,g)=L(o,m)*R(m,g)", t, tasks=many).df.agg(F.round(F.sum(F.col("v") * F.col("v")), 4).alias("squares"))
