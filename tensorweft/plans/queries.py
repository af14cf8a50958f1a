"""The tensor operators as queries over the driver's tables, each with the SQL that says the same.

Tables become tensors through coordinates: keys as they are, or folded into small dimensions by a remainder, where a
query needs dimensions of known extent; every row of a table takes part. Values are whole numbers, so that sums don't
depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorweft.functions import scalars
from tensorweft.functions.functors import Registry
from tensorweft.operators import elementwise as E
from tensorweft.operators import linalg, reduce, views
from tensorweft.operators.algebra import add, add_pattern, contract, custom, inner, matmul
from tensorweft.operators.blocked import contract_blocked
from tensorweft.operators.factorise import factorise
from tensorweft.operators.tensor import Tensor, from_function, full, random
from tensorweft.plans import network, spaces
from tensorweft.plans import pattern as P
from tensorweft.plans.program import Program
from tensorweft.plans.runtime import Runtime
from tensorweft.sources.storage import load, read_table, save

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# ------------------------------------------------------------------ tensors of tables


def A(spark, d) -> Tensor:
    """A(i,j), 12 x 8: quantities by order and supplier."""
    return Tensor.from_table(read_table(spark, d, "lineitem"), {"i": F.expr("l_orderkey % 12"), "j": F.expr("l_suppkey % 8")}, "l_quantity", (12, 8), name="A")


def B(spark, d) -> Tensor:
    """B(j,k), 8 x 6: lines by supplier and part."""
    return Tensor.from_table(read_table(spark, d, "lineitem"), {"j": F.expr("l_suppkey % 8"), "k": F.expr("l_partkey % 6")}, 1.0, (8, 6), name="B")


def C(spark, d) -> Tensor:
    """C(i,j), 12 x 8: line numbers by order and part."""
    return Tensor.from_table(read_table(spark, d, "lineitem"), {"i": F.expr("l_orderkey % 12"), "j": F.expr("l_partkey % 8")}, "l_linenumber", (12, 8), name="C")


def T3(spark, d) -> Tensor:
    """T(k,a,i), 4 x 5 x 6: quantities by order, supplier and part."""
    return Tensor.from_table(read_table(spark, d, "lineitem"), {"k": F.expr("l_orderkey % 4"), "a": F.expr("l_suppkey % 5"), "i": F.expr("l_partkey % 6")}, "l_quantity", (4, 5, 6), name="T")


def CUBE(spark, d) -> Tensor:
    """X(a,b,c), 5 x 4 x 5: quantities."""
    return Tensor.from_table(read_table(spark, d, "lineitem"), {"a": F.expr("l_orderkey % 5"), "b": F.expr("l_suppkey % 4"), "c": F.expr("l_partkey % 5")}, "l_quantity", (5, 4, 5), name="X")


def Z(spark, d) -> Tensor:
    """Z(i,j), 12 x 8, complex: quantities and line numbers."""
    return Tensor.from_table(read_table(spark, d, "lineitem"), {"i": F.expr("l_orderkey % 12"), "j": F.expr("l_suppkey % 8")}, ("l_quantity", "l_linenumber"), (12, 8), "C8", name="Z")


def numbers(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the column's values numbered from 0 in their order, by range partitions and their sizes."""
    spark = df.sparkSession
    each = df.select(column).filter(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column)
    placed = each.select(column, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    first = placed.groupBy("part").agg(F.count("*").alias("many"), F.min("at").alias("start")).collect()  # a row a partition
    before, rows = 0, []
    for r in sorted(first):
        rows.append((r.part, r.start - before))
        before += r.many
    starts = F.broadcast(spark.createDataFrame(rows, "part int, shift long"))
    return placed.join(starts, "part").select(column, (F.col("at") - F.col("shift")).alias(name))


SQL_A = "SELECT l_orderkey % 12 AS i, l_suppkey % 8 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"
SQL_B = "SELECT l_suppkey % 8 AS j, l_partkey % 6 AS k, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY ALL"
SQL_C = "SELECT l_orderkey % 12 AS i, l_partkey % 8 AS j, CAST(sum(l_linenumber) AS DOUBLE) AS v FROM lineitem GROUP BY ALL"
SQL_T3 = "SELECT l_orderkey % 4 AS k, l_suppkey % 5 AS a, l_partkey % 6 AS i, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"
SQL_CUBE = "SELECT l_orderkey % 5 AS a, l_suppkey % 4 AS b, l_partkey % 5 AS c, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"
SQL_Z = "SELECT l_orderkey % 12 AS i, l_suppkey % 8 AS j, sum(l_quantity) AS re, CAST(sum(l_linenumber) AS DOUBLE) AS im FROM lineitem GROUP BY ALL"
WITH = f"WITH A AS ({SQL_A}), B AS ({SQL_B}), C AS ({SQL_C}), T AS ({SQL_T3}), X AS ({SQL_CUBE}), Z AS ({SQL_Z})\n"

# ------------------------------------------------------------------ contractions


@query("SELECT o_custkey AS c, l_suppkey AS s, sum(l_quantity) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def contraction(spark, d):
    left = Tensor.from_table(read_table(spark, d, "orders"), {"o": "o_orderkey", "c": "o_custkey"}, 1.0, sums=False)
    right = Tensor.from_table(read_table(spark, d, "lineitem"), {"o": "l_orderkey", "s": "l_suppkey"}, "l_quantity", sums=False)
    return contract("D(c,s)+=L(o,c)*R(o,s)", left, right).df


@query("""WITH b AS (SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS b FROM part)
SELECT CAST(c_nationkey AS BIGINT) AS n, b, sum(l_quantity) AS v FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN b ON l_partkey = p_partkey GROUP BY ALL""")
def contraction_network(spark, d):
    """N(n,b): quantities by nation and brand, over customers, orders, lines and parts in the cheapest order."""
    part = read_table(spark, d, "part")
    numbered = part.join(numbers(part, "p_brand", "b"), "p_brand").select("p_partkey", "b")
    n = {t: read_table(spark, d, t) for t in ("customer", "orders", "lineitem")}
    a = Tensor.from_table(n["customer"], {"c": "c_custkey", "n": "c_nationkey"}, 1.0, (None, 25), sums=False)
    o = Tensor.from_table(n["orders"], {"o": "o_orderkey", "c": "o_custkey"}, 1.0, sums=False)
    r = Tensor.from_table(n["lineitem"], {"o": "l_orderkey", "p": "l_partkey"}, "l_quantity", sums=False)
    b = Tensor.from_table(numbered, {"p": "p_partkey", "b": "b"}, 1.0, (None, 25), sums=False)
    return network.contract_network("N(n,b)+=A(c,n)*O(o,c)*R(o,p)*B(p,b)", a, o, r, b).df


@query(WITH + "SELECT sum(A.v * C.v) AS v FROM A JOIN C USING (i, j)")
def inner_product(spark, d):
    return inner(A(spark, d), C(spark, d)).df


@query("SELECT CAST(c_nationkey AS BIGINT) AS m, CAST(s_nationkey AS BIGINT) AS n, CAST(x * y AS DOUBLE) AS v FROM (SELECT c_nationkey, count(*) AS x FROM customer GROUP BY 1), (SELECT s_nationkey, count(*) AS y FROM supplier GROUP BY 1)")
def direct_product(spark, d):
    left = Tensor.from_table(read_table(spark, d, "customer"), {"m": "c_nationkey"}, 1.0)
    right = Tensor.from_table(read_table(spark, d, "supplier"), {"n": "s_nationkey"}, 1.0)
    return contract("D(m,n)+=L(m)*R(n)", left, right).df


@query(WITH + "SELECT A.i, A.j, A.v * C.v AS v FROM A JOIN C USING (i, j)")
def hadamard_product(spark, d):
    return contract("H(i,j)+=L(i,j)*R(i,j)", A(spark, d), C(spark, d)).df


@query(WITH + "SELECT i, j, k, A.v * B.v AS v FROM A JOIN B USING (j)")
def khatri_rao_product(spark, d):
    return contract("H(i,j,k)+=L(i,j)*R(j,k)", A(spark, d), B(spark, d)).df


@query(WITH + "SELECT k, x.i AS i, y.i AS j, sum(x.v * y.v) AS v FROM T x JOIN T y USING (k, a) GROUP BY ALL")
def hyper_contraction(spark, d):
    t = T3(spark, d)
    return contract("D(k,i,j)+=L(k,a,i)*R(k,a,j)", t, t).df


@query(WITH + "SELECT i, k, v * 2 + w AS v FROM (SELECT i, k, sum(A.v * B.v) AS v FROM A JOIN B USING (j) GROUP BY ALL) JOIN (SELECT l_orderkey % 12 AS i, l_partkey % 6 AS k, sum(l_quantity) AS w FROM lineitem GROUP BY ALL) USING (i, k)")
def contraction_accumulated(spark, d):
    into = Tensor.from_table(read_table(spark, d, "lineitem"), {"i": F.expr("l_orderkey % 12"), "k": F.expr("l_partkey % 6")}, "l_quantity", (12, 6))
    return contract("D(i,k)+=L(i,j)*R(j,k)", A(spark, d), B(spark, d), into, 2.0).df


@query(WITH + "SELECT i, k, sum(A.v * B.v) AS v FROM A JOIN B USING (j) GROUP BY ALL")
def contraction_overwritten(spark, d):
    into = full(spark, ("i", "k"), (12, 6), 7.0)
    return contract("D(i,k)+=L(i,j)*R(j,k)", A(spark, d), B(spark, d), into, accumulate=False).df


@query(WITH + "SELECT i, k, sum(A.v * B.v) AS v FROM A JOIN B USING (j) GROUP BY ALL")
def contraction_blocked(spark, d):
    return contract_blocked("D(i,k)+=L(i,j)*R(j,k)", A(spark, d), B(spark, d), 4).df


@query("""WITH e AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS d, unnest(list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64))) AS v FROM embeddings)
SELECT x.d AS x, y.d AS y, sum(x.v * y.v) AS v FROM e x JOIN e y USING (vec_id) GROUP BY ALL HAVING sum(x.v * y.v) <> 0""")
def gram_matrix(spark, d):
    """G(x,y) over all embeddings (in 64ths), by blocks."""
    table = read_table(spark, d, "embeddings")
    e = Tensor.from_array_column(table, {"r": "vec_id"}, F.transform("embedding", lambda x: F.floor(x.cast("double") * 64)), "x")
    n, size = table.agg(F.max("vec_id") + 1, F.max(F.size("embedding"))).first()
    e = Tensor(e.df, e.dims, (n or 0, size or 0), "R8", "E")
    return contract_blocked("G(x,y)+=L(r,x)*R(r,y)", e, e).df.filter("v <> 0")


@query(WITH + "SELECT i, k, 0.5 * sum(A.v * B.v) AS v FROM A JOIN B USING (j) GROUP BY ALL")
def matrix_product(spark, d):
    return matmul(A(spark, d), B(spark, d), 2, 0.5).relabel(("i", "k")).df


@query(WITH + "SELECT x.i AS i, y.i AS k, sum(x.re * y.re + x.im * y.im) AS re, sum(x.re * y.im - x.im * y.re) AS im FROM Z x JOIN Z y USING (j) GROUP BY ALL")
def contraction_conjugated(spark, d):
    z = Z(spark, d)
    return contract("D(i,k)+=L+(i,j)*R(k,j)", z, z).df


@query(WITH + "SELECT x.i AS i, y.i AS k, sum(x.re * y.re + x.im * y.im) AS re, sum(x.im * y.re - x.re * y.im) AS im FROM Z x JOIN Z y USING (j) GROUP BY ALL")
def contraction_conjugated_destination(spark, d):
    z = Z(spark, d)
    return contract("D+(i,k)+=L+(i,j)*R(k,j)", z, z).df


@query(WITH + "SELECT x.i AS i, y.i AS k, sum(x.v * y.v) AS v FROM A x JOIN A y USING (j) WHERE x.i < y.i GROUP BY ALL")
def contraction_restricted(spark, d):
    a = A(spark, d)
    return contract("D(i,k)+=L(i,j)*R(k,j)", a, a, restrict=F.col("i") < F.col("k")).df


@query(WITH + "SELECT i, j, v * (SELECT CAST(count(*) AS DOUBLE) FROM orders) AS v FROM A")
def scalar_times_tensor(spark, d):
    n = Tensor.from_table(read_table(spark, d, "orders"), {}, 1.0)
    return contract("D(i,j)+=K()*L(i,j)", n, A(spark, d)).df


@query("SELECT CAST(3 * count(*) + 1 AS DOUBLE) AS v FROM orders")
def scalar_times_scalar(spark, d):
    n = Tensor.from_table(read_table(spark, d, "orders"), {}, 1.0)
    return contract("D()+=K()*L()", n, Tensor.scalar(spark, 3.0), Tensor.scalar(spark, 1.0)).df


# ------------------------------------------------------------------ addition, scaling, shapes


@query(WITH + "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM A UNION ALL SELECT i, j, v * -2 FROM C) GROUP BY ALL")
def addition(spark, d):
    return add(C(spark, d), A(spark, d), -2.0).df


@query(WITH + "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM X0 UNION ALL SELECT j, i, v FROM X0) GROUP BY ALL".replace("X0", "(SELECT a AS i, c AS j, sum(v) AS v FROM X GROUP BY ALL)"))
def addition_permuted(spark, d):
    s = Tensor.from_table(read_table(spark, d, "lineitem"), {"i": F.expr("l_orderkey % 5"), "j": F.expr("l_partkey % 5")}, "l_quantity", (5, 5))
    return add_pattern("D(i,j)+=L(j,i)", s, s).df


@query(WITH + "SELECT i, j, 2 * re - 3 * im AS re, 3 * re + 2 * im AS im FROM Z")
def scaling(spark, d):
    return E.scale(Z(spark, d), 2 + 3j).df


@query(WITH + "SELECT i, a, k, v FROM T")
def permuted_copy(spark, d):
    return E.copy("D(i,a,k)=L(k,a,i)", T3(spark, d)).df


@query(WITH + "SELECT i, j, re, -im AS im FROM Z")
def conjugation(spark, d):
    return E.conjugate(Z(spark, d)).df


@query(WITH + "SELECT i - 2 AS i, j - 1 AS j, v FROM A WHERE i BETWEEN 2 AND 6 AND j BETWEEN 1 AND 4")
def slice_extract(spark, d):
    return E.slice_of(A(spark, d), (2, 1), (5, 4)).df


@query(WITH + "SELECT i, j, sum(v) AS v FROM (SELECT i - 2 AS i, j - 1 AS j, v FROM A WHERE i BETWEEN 2 AND 6 AND j BETWEEN 1 AND 4 UNION ALL SELECT x, y, 3.0 FROM range(5) t(x), range(4) u(y)) GROUP BY ALL")
def slice_accumulate(spark, d):
    return E.slice_of(A(spark, d), (2, 1), (5, 4), full(spark, ("i", "j"), (5, 4), 3.0)).df


@query(WITH + "SELECT i, j, CASE WHEN i BETWEEN 2 AND 6 AND j BETWEEN 1 AND 4 THEN -13.0 ELSE coalesce(v, 0) END AS v FROM (SELECT x AS i, y AS j FROM range(12) t(x), range(8) u(y)) LEFT JOIN A USING (i, j) WHERE v IS NOT NULL OR (i BETWEEN 2 AND 6 AND j BETWEEN 1 AND 4)")
def slice_insert(spark, d):
    return E.insert(A(spark, d), full(spark, ("x", "y"), (5, 4), -13.0), (2, 1)).df


@query(WITH + "SELECT i, j, sum(v) AS v FROM (SELECT * FROM A UNION ALL SELECT x + 2, y + 1, 5.0 FROM range(5) t(x), range(4) u(y)) GROUP BY ALL")
def slice_insert_accumulate(spark, d):
    return E.insert(A(spark, d), full(spark, ("x", "y"), (5, 4), 5.0), (2, 1), accumulate=True).df


@query(WITH + "SELECT k + 4 * i AS m, a, v FROM T")
def folding(spark, d):
    return E.fold(T3(spark, d), ("k", "i"), "m").df


@query(WITH + "SELECT i % 3 AS x, i // 3 AS y, j, v FROM A")
def unfolding(spark, d):
    return E.unfold(A(spark, d), "i", ("x", "y"), (3, 4)).df


@query(WITH + "SELECT (i + 12 * j) % 6 AS x, (i + 12 * j) // 6 AS y, v FROM A")
def reshaping(spark, d):
    return E.reshape(A(spark, d), ("x", "y"), (6, 16)).df


@query(WITH + "SELECT i, j, CASE WHEN re <> 0 THEN sqrt(re * re + im * im) * sign(re) ELSE im END AS v FROM (SELECT i, j, 3 * re AS re, 4 * re AS im FROM Z)")
def complex_to_real(spark, d):
    z = Z(spark, d)
    scaled = z.with_df(z.df.select("i", "j", (F.col("re") * 3).alias("re"), (F.col("re") * 4).alias("im")))
    return E.to_real(scaled).df


@query(WITH + "SELECT i, j, CAST(CAST(v AS FLOAT) AS DOUBLE) AS re, CAST(0 AS DOUBLE) AS im FROM A")
def kind_cast(spark, d):
    return E.cast(E.cast(A(spark, d), "R4"), "C8").df


@query(WITH + "SELECT i, j, im AS v FROM Z")
def imaginary_part(spark, d):
    return E.imaginary(Z(spark, d)).df


@query(WITH + "SELECT i, j, re AS v FROM Z")
def real_part(spark, d):
    return E.real(Z(spark, d)).df


@query("SELECT x AS i, y AS j, CAST(27.38 AS DOUBLE) AS v FROM range(12) t(x), range(8) u(y)")
def initialise_value(spark, d):
    return E.initialise(Tensor.zeros(spark, ("i", "j"), (12, 8)), 27.38).df


@query("SELECT x AS i, y AS j, CAST(x * 8 + y AS DOUBLE) AS v FROM range(12) t(x), range(8) u(y)")
def initialise_method(spark, d):
    registry = Registry()
    registry.register_method("linear", lambda v, i, j: i * 8 + j)
    return registry.initialise(Tensor.zeros(spark, ("i", "j"), (12, 8)), "linear").df


@query()
def initialise_random(spark, d):
    return random(spark, ("i", "j"), (12, 8), 5).df


@query(WITH + "SELECT x AS i, y AS j, coalesce(v, 0) * 2 + x AS v FROM range(12) t(x), range(8) u(y) LEFT JOIN A ON A.i = x AND A.j = y")
def transform_method(spark, d):
    registry = Registry()
    registry.register_method("shifted", lambda v, i, j: v * 2 + i)
    return registry.apply(A(spark, d), "shifted").df


@query(WITH + "SELECT i, j, v * v AS v FROM A")
def transform_blocks(spark, d):
    return Registry.apply_blocks(A(spark, d), lambda part: part.assign(v=part.v * part.v)).df


@query(WITH + "SELECT coalesce(A.i, C.i) AS i, coalesce(A.j, C.j) AS j, greatest(coalesce(A.v, 0), coalesce(C.v, 0) * 10) AS v FROM A FULL JOIN C ON A.i = C.i AND A.j = C.j")
def custom_binary(spark, d):
    return custom(lambda x, y: F.greatest(x, y * 10), A(spark, d), C(spark, d)).df


@query(WITH + "SELECT x AS i, y AS j, coalesce(A.v, 0) + 2 * coalesce(C.v, 0) - 3 * x + 1 AS v FROM range(12) t(x), range(8) u(y) LEFT JOIN A ON A.i = x AND A.j = y LEFT JOIN C ON C.i = x AND C.j = y")
def custom_ternary(spark, d):
    third = from_function(spark, ("i", "j"), (12, 8), lambda i, j: i)
    return custom(lambda x, y, z: x + 2 * y - 3 * z + 1, A(spark, d), C(spark, d), third, fills=True).df


@query(WITH + "SELECT a, b, c, v FROM X WHERE a < c AND a >= b")
def index_restriction(spark, d):
    return E.ordered(CUBE(spark, d), (("a", "c"), "<"), (("a", "b"), ">=")).df


@query(WITH + "SELECT i, j, v FROM A UNION ALL SELECT i + 12, j, v FROM C")
def direct_sum(spark, d):
    """A and C side by side."""
    a = A(spark, d)
    return views.direct_sum(Tensor(a.df, a.dims, (24, 8)), ((12, 0), C(spark, d))).df


@query(WITH + "SELECT i, k, sum(A.v * B.v) AS v FROM A JOIN B USING (j) GROUP BY ALL")
def contraction_in_parts(spark, d):
    return views.contract_in_parts("D(i,k)+=L(i,j)*R(j,k)", A(spark, d), B(spark, d), 24).df


@query(WITH + "SELECT i // 4 AS b_i, A.j // 4 AS b_j, k // 4 AS b_k, n AS n_left, m AS n_right FROM (SELECT i // 4 * 4 AS i, j // 4 * 4 AS j, count(*) AS n FROM A GROUP BY ALL) A JOIN (SELECT j // 4 * 4 AS j, k // 4 * 4 AS k, count(*) AS m FROM B GROUP BY ALL) B USING (j)")
def contraction_blocks(spark, d):
    """Pairs of blocks that a contraction multiplies."""
    return views.matching_blocks("D(i,k)+=L(i,j)*R(j,k)", A(spark, d), B(spark, d), 4)


@query(WITH + "SELECT i, j, v FROM A ORDER BY abs(v) DESC, i, j LIMIT 5")
def top_moduli(spark, d):
    return views.top(A(spark, d), 5)


@query(WITH + "SELECT 2.0 * 12 * 8 * 6 AS flops, 1 AS operations".replace("2.0 * 12 * 8 * 6", "CAST(1152 AS DOUBLE)").replace("1 AS operations", "CAST(1 AS BIGINT) AS operations"))
def runtime_statistics(spark, d):
    r = Runtime(spark)
    r.sync(r.contract("D(i,k)+=L(i,j)*R(j,k)", A(spark, d), B(spark, d)))
    r.wait_all()
    found = r.statistics()
    return spark.createDataFrame([(found["flops"], found["operations"])], "flops double, operations long")


# ------------------------------------------------------------------ traces and reductions


@query(WITH + "SELECT sum(v) AS v FROM X WHERE a = c AND a = b")
def trace_full(spark, d):
    return E.trace("T()+=X(a,a,a)", _square(spark, d)).df


def _square(spark, d) -> Tensor:
    x = CUBE(spark, d)
    return Tensor(x.df, x.dims, (5, 5, 5), x.kind, x.name)


@query(WITH + "SELECT b, sum(v) AS v FROM X WHERE a = c GROUP BY b")
def trace_partial(spark, d):
    return E.trace("T(b)+=X(a,b,a)", CUBE(spark, d)).df


@query(WITH + "SELECT a, v FROM X WHERE a = b AND b = c")
def trace_generalised(spark, d):
    return E.trace("T(a)+=X(a,a,a)", _square(spark, d)).df


@query(WITH + "SELECT sum(abs(v)) AS norm1 FROM A")
def norm_one(spark, d):
    return reduce.norm1(A(spark, d))


@query(WITH + "SELECT sum(re * re + im * im) AS norm2 FROM Z")
def norm_two_squared(spark, d):
    return reduce.norm2(Z(spark, d))


@query(WITH + "SELECT max(abs(v)) AS max_abs FROM (SELECT i, j, -v AS v FROM A)")
def max_modulus(spark, d):
    return reduce.max_abs(E.scale(A(spark, d), -1.0))


@query(WITH + "SELECT CASE WHEN count(*) < 96 THEN 0.0 ELSE min(abs(v)) END AS min_abs FROM A")
def min_modulus(spark, d):
    return reduce.min_abs(A(spark, d))


@query(WITH + "SELECT i, j, v FROM A ORDER BY abs(v) DESC, i, j LIMIT 1")
def max_modulus_location(spark, d):
    return reduce.argmax(A(spark, d))


@query(WITH + "SELECT bool_or(isnan(v)) AS has_nan FROM A")
def nan_search(spark, d):
    return reduce.has_nan(A(spark, d))


@query(WITH + "SELECT sum(CASE WHEN abs(x - y) > 1e-13 THEN 1 ELSE 0 END) AS diff_absolute, sum(CASE WHEN abs(x - y) > 0.01 * greatest(x, y) THEN 1 ELSE 0 END) AS diff_relative FROM (SELECT coalesce(A.v, 0) AS x, coalesce(C.v, 0) AS y FROM A FULL JOIN C ON A.i = C.i AND A.j = C.j)")
def comparison(spark, d):
    a, b = A(spark, d), C(spark, d)
    named = lambda df, name: df.select(F.col("diff_count").alias(name))
    return named(reduce.compare(a, b), "diff_absolute").crossJoin(named(reduce.compare(a, b, relative=True), "diff_relative"))  # one row each


@query(WITH + "SELECT i, j, v FROM A WHERE abs(v) > 1000")
def print_threshold(spark, d):
    return A(spark, d).show(1000.0)


# ------------------------------------------------------------------ factorisations


@query(WITH + "SELECT k, a, i, round(v, 8) AS v FROM T")
def svd_reconstruction(spark, d):
    left, s, right = linalg.svd("D(k,a,i)=L(i,m)*R(m,a,k)", T3(spark, d).relabel(("k", "a", "i")))
    scaled = contract("L(i,m)+=L(i,m)*S(m)", left, s)
    made = contract("D(k,a,i)+=L(i,m)*R(m,a,k)", scaled, right)
    return made.df.select("k", "a", "i", F.round("v", 8).alias("v"))


@query(WITH + "SELECT i, j, round(v, 8) AS v FROM A")
def svd_absorbed(spark, d):
    left, _, right = linalg.svd("D(i,j)=L(i,m)*R(m,j)", A(spark, d), absorb="both")
    return contract("D(i,j)+=L(i,m)*R(m,j)", left, right).df.select("i", "j", F.round("v", 8).alias("v"))


_CHAIN = "D(k,a,i)=F(k,x)*G(x,a,y)*H(y,i)"


@query(WITH + "SELECT k, a, i, round(v, 8) AS v FROM T")
def network_decomposition(spark, d):
    """A chain of three factors with bonds as long as their ranks can be, multiplied again."""
    t = T3(spark, d).relabel(("k", "a", "i"))
    k, _, i = t.known()
    made = network.contract_network(_CHAIN, *factorise(_CHAIN, t, {"x": k, "y": i}))
    return made.df.select("k", "a", "i", F.round("v", 8).alias("v"))


@query("SELECT x, y, CAST(CASE WHEN x = y THEN 1 ELSE 0 END AS DOUBLE) AS v FROM range(8) t(x), range(8) u(y)")
def orthogonalisation(spark, d):
    """Products of the columns of the orthogonal tensor next to A: the unit matrix."""
    u = linalg.orthogonalise("D(i,j)=L(i,m)*R(m,j)", A(spark, d))
    return contract("G(x,y)+=L(i,x)*R(i,y)", u, u).df.select("x", "y", (F.round("v", 9) + F.lit(0.0)).alias("v"))


@query("SELECT x, y, CAST(CASE WHEN x = y THEN 1 ELSE 0 END AS DOUBLE) AS v FROM range(8) t(x), range(8) u(y)")
def gram_schmidt(spark, d):
    """Products of the columns of A made orthonormal one after the other."""
    u = linalg.gram_schmidt("D(i,j)=L(i,m)*R(m,j)", A(spark, d))
    return contract("G(x,y)+=L(i,x)*R(i,y)", u, u).df.select("x", "y", (F.round("v", 9) + F.lit(0.0)).alias("v"))


# ------------------------------------------------------------------ sources


@query("SELECT n % 3 AS x, n // 3 % 4 AS y, n // 12 AS z, CAST(n AS DOUBLE) AS v FROM range(60) t(n)")
def import_flat(spark, d):
    return Tensor.from_flat(spark.range(60).select("id", F.col("id").cast("double").alias("v")), "id", "v", ("x", "y", "z"), (3, 4, 5)).df


@query("SELECT vec_id AS r, unnest(generate_series(0, len(embedding) - 1)) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings")
def array_column(spark, d):
    return Tensor.from_array_column(read_table(spark, d, "embeddings"), {"r": "vec_id"}, "embedding", "x").df


@query("SELECT user_id AS u, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS k, CAST(n AS DOUBLE) AS v FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def events_tensor(spark, d):
    """V(u,k): events by user and type, types numbered in their order."""
    events = read_table(spark, d, "events")
    numbered = events.join(numbers(events, "event_type", "k"), "event_type")
    return Tensor.from_table(numbered, {"u": "user_id", "k": "k"}, 1.0).df


@query(WITH + "SELECT i, j, v FROM A")
def save_and_load(spark, d):
    path = _folder(spark, "tensor")
    save(A(spark, d), path, overwrite=True)
    return load(spark, path).df


def _folder(spark, name: str) -> str:
    """A fresh folder under the cluster's shared one; of this machine only in local mode."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    shared = shared or f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/tensorweft-{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ spaces and scalars


@query("SELECT subspace_id, parent_id, CAST(level AS INTEGER) AS level, lo, hi FROM (VALUES (0, -1, 0, 0, 8), (1, 0, 1, 0, 4), (2, 0, 1, 4, 8), (3, 1, 2, 0, 2), (4, 1, 2, 2, 4), (5, 2, 2, 4, 6), (6, 2, 2, 6, 8), (7, 3, 3, 0, 1), (8, 3, 3, 1, 2), (9, 4, 3, 2, 3), (10, 4, 3, 3, 4), (11, 5, 3, 4, 5), (12, 5, 3, 5, 6), (13, 6, 3, 6, 7), (14, 6, 3, 7, 8)) t(subspace_id, parent_id, level, lo, hi)".replace("SELECT subspace_id, parent_id,", "SELECT CAST(subspace_id AS BIGINT) AS subspace_id, CAST(parent_id AS BIGINT) AS parent_id,").replace("lo, hi FROM", "CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM", 1))
def space_tree(spark, d):
    tree = spaces.Space("s", 8).table(spark).drop("space")
    return tree.withColumn("parent_id", F.coalesce("parent_id", F.lit(-1)))  # the whole space has none


_TREE = "WITH RECURSIVE t AS (SELECT CAST(0 AS BIGINT) AS lo, CAST(8 AS BIGINT) AS hi UNION ALL SELECT unnest([lo, (lo + hi) // 2]), unnest([(lo + hi) // 2, hi]) FROM t WHERE hi - lo > 1)\n"


@query(_TREE + """SELECT r AS relation, count(*) AS n FROM (SELECT CASE WHEN a.lo = b.lo AND a.hi = b.hi THEN 'SAME' WHEN a.lo <= b.lo AND b.hi <= a.hi AND a.hi - a.lo = 2 * (b.hi - b.lo) THEN 'PARENT' WHEN b.lo <= a.lo AND a.hi <= b.hi AND b.hi - b.lo = 2 * (a.hi - a.lo) THEN 'CHILD'
WHEN a.hi - a.lo = b.hi - b.lo AND a.lo // (2 * (a.hi - a.lo)) = b.lo // (2 * (b.hi - b.lo)) THEN 'SIBLING' WHEN a.hi <= b.lo THEN 'LESS' WHEN a.lo >= b.hi THEN 'GREATER' ELSE 'UNRELATED' END AS r FROM t a, t b) GROUP BY r""")
def subspace_relations(spark, d):
    tree = spaces.Space("s", 8).table(spark).select(F.struct("subspace_id", "parent_id", "lo", "hi").alias("x"))
    return tree.select(F.col("x").alias("a")).crossJoin(F.broadcast(tree.select(F.col("x").alias("b")))).select(spaces.relation("a", "b").alias("relation")).groupBy("relation").agg(F.count("*").alias("n"))


@query(_TREE + "SELECT b.hi - b.lo AS width, count(*) AS n FROM t a JOIN t b ON b.lo <= a.lo AND a.hi <= b.hi AND b.hi - b.lo > a.hi - a.lo GROUP BY ALL")
def subspace_ancestors(spark, d):
    tree = spaces.Space("s", 8).table(spark)
    above = spaces.ancestors(tree).join(tree.select(F.col("subspace_id").alias("ancestor_id"), (F.col("hi") - F.col("lo")).alias("width")), "ancestor_id")
    return above.groupBy("width").agg(F.count("*").alias("n"))


@query(WITH + "SELECT i - 4 AS i, j, v FROM A WHERE i BETWEEN 4 AND 11 AND j < 3".replace("j, v", "j, v"))
def subspace_slice(spark, d):
    r = spaces.SpaceRegistry()
    r.register_space("s", 12)
    r.register_space("t", 8)
    r.register_subspace("high", "s", 4, 12)
    r.register_subspace("low", "t", 0, 3)
    ranges = [r.range_of("high"), r.range_of("low")]
    return E.slice_of(A(spark, d), [lo for _, lo, _ in ranges], [hi - lo for _, lo, hi in ranges]).df


@query("SELECT p_partkey, s_suppkey, CAST(least(p_partkey + p_size, s_suppkey + 10) - greatest(p_partkey, s_suppkey) AS BIGINT) AS shared FROM part JOIN supplier ON p_partkey < s_suppkey + 10 AND s_suppkey < p_partkey + p_size")
def range_overlap(spark, d):
    part = read_table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size")).alias("hi"))
    supplier = read_table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 10).alias("b"))
    both = spaces.range_join(part, supplier, "lo", "hi", "a", "b", 32)
    return both.select("p_partkey", "s_suppkey", spaces.overlap("lo", "hi", "a", "b").cast("bigint").alias("shared"))


@query("SELECT p_partkey, CAST(greatest(0, least(p_size, 30) - 10) * 5 AS DOUBLE) AS overlap, CAST(greatest(p_size, 30) * 12 AS DOUBLE) AS around FROM part")
def orthotopes(spark, d):
    box = lambda *sides: F.array(*[F.struct(F.lit(a).cast("double").alias("lo") if not hasattr(a, "cast") else a.cast("double").alias("lo"), b.cast("double").alias("hi") if hasattr(b, "cast") else F.lit(b).cast("double").alias("hi")) for a, b in sides])
    x = read_table(spark, d, "part").select("p_partkey", box((0, F.col("p_size")), (0, 12)).alias("x"), box((10, 30), (7, 12)).alias("y"))
    clipped = F.transform(spaces.box_overlap("x", "y"), lambda r: F.struct(r["lo"].alias("lo"), F.greatest(r["lo"], r["hi"]).alias("hi")))
    return x.select("p_partkey", spaces.box_volume(clipped).alias("overlap"), spaces.box_volume(spaces.box_union("x", "y")).alias("around"))


@query("SELECT s_suppkey, sqrt(CAST(s_suppkey * s_suppkey + 144 AS DOUBLE)) AS norm, CAST(s_suppkey + 12 AS DOUBLE) / 2 AS mean FROM supplier")
def real_vectors(spark, d):
    s = read_table(spark, d, "supplier").select("s_suppkey", F.array(F.col("s_suppkey").cast("double"), F.lit(12.0)).alias("v"))
    return s.select("s_suppkey", spaces.vector_norm2("v").alias("norm"), spaces.vector_average("v", F.reverse("v"))[0].alias("mean"))


@query("SELECT n, CASE WHEN n < 0 THEN -1 ELSE CAST(factorial(CAST(n AS INTEGER)) AS BIGINT) END AS f, (SELECT CAST(coalesce(round(exp(sum(ln(CAST(n - 3 + i AS DOUBLE) / i)))), 1) AS BIGINT) FROM range(1, 4) r(i)) AS b FROM range(3, 19) t(n)")
def combinatorics(spark, d):
    return spark.range(3, 19).select(F.col("id").alias("n"), scalars.factorial("id").alias("f"), scalars.binomial(F.col("id"), F.lit(3).cast("bigint")).alias("b"))


@query(WITH + "SELECT i, j, re * re - im * im AS re, 2 * re * im AS im, sqrt(re * re + im * im) AS size FROM Z")
def complex_arithmetic(spark, d):
    x = (F.col("re"), F.col("im"))
    re, im = scalars.complex_multiply(x, x)
    return Z(spark, d).df.select("i", "j", re.alias("re"), im.alias("im"), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("size"))


@query("SELECT k, CAST(k AS INTEGER) % 2 * -2 + 1 AS sign FROM (SELECT CAST(k AS BIGINT) AS k FROM range(6) t(k))")
def permutation_signs(spark, d):
    """Rotations of four by k places: odd ones for odd k."""
    return spark.range(6).select(F.col("id").alias("k"), scalars.permutation_sign(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda x: F.pmod(x + F.col("id"), F.lit(4)))).alias("sign"))


@query("""WITH RECURSIVE p AS (SELECT round(s_acctbal) AS x, count(*) AS times, row_number() OVER (ORDER BY x) AS k FROM supplier GROUP BY 1),
m AS (SELECT 2 * (max(x) - min(x)) / sum(times) AS most FROM p),
c AS (SELECT k, x, CAST(0 AS BIGINT) AS cluster, CAST(x * times AS DOUBLE) AS total, CAST(times AS BIGINT) AS held FROM p WHERE k = 1
  UNION ALL SELECT p.k, p.x, CASE WHEN p.x - total / held < most THEN cluster ELSE cluster + 1 END, CASE WHEN p.x - total / held < most THEN total + p.x * times ELSE p.x * times END,
  CASE WHEN p.x - total / held < most THEN held + times ELSE times END FROM c JOIN p ON p.k = c.k + 1, m)
SELECT s_suppkey, cluster FROM supplier JOIN c ON round(s_acctbal) = x""")
def point_clusters(spark, d):
    s = read_table(spark, d, "supplier").select("s_suppkey", F.round("s_acctbal").alias("x"))
    return scalars.clusters(s, "x", 2.0).select("s_suppkey", "cluster")


# ------------------------------------------------------------------ plans and programs


@query("SELECT name, CAST(f AS DOUBLE) AS flops, CAST(b AS DOUBLE) AS bytes FROM (VALUES ('contraction', 1152, 1728), ('hyper', 1440, 3072)) t(name, f, b)")
def cost_model(spark, d):
    sizes = {"i": 12, "j": 8, "k": 6}
    other = {"k": 4, "a": 5, "i": 6, "j": 6}
    rows = []
    for name, text, s in (("contraction", "D(i,k)+=L(i,j)*R(j,k)", sizes), ("hyper", "D(k,i,j)+=L(k,a,i)*R(k,a,j)", other)):
        p = P.parse(text)
        labels = [p.dest.labels, *(o.labels for o in p.inputs)]
        rows.append((name, network.flops(labels, s), network.moved_bytes(labels, s)))
    return spark.createDataFrame(rows, "name string, flops double, bytes double")


_PROGRAM = """
entry: main
scope main group(demo)
 space(real): s=[0:11], t=[0:7]
 subspace(s): low=[0:3], high=[4:11]
 index(low): a,b
 index(high): p
 index(t): j,k
 V(p,j) = method("values")        # 4..11 by 0..7
 W(a,j) = 2.0
 D(a,p) += W(a,j) * V(p,j) * 0.5
 D(a,p) *= 3.0
 E(a,b) = 1.0 : [a<=b]
 F(b,p) += E(a,b) * D(a,p)
 export F(b,p): tag("F") to(demo:r)
 invoke last
 import N(): tag("norm")
end scope main
scope last group(demo)
 import F(x,y): tag("F")
 N() = F(x,y) * F(x,y)
 export N(): tag("norm")
end scope last
"""


@query("SELECT sum(v * v) AS v FROM (SELECT b + 1 AS n, CAST((b + 1) * 3 * (64 * p + 28) AS DOUBLE) AS v FROM range(4) t(b), range(4, 12) u(p))")
def tensor_program(spark, d):
    registry = Registry()
    # coordinates count from the start of the range
    registry.register_method("values", lambda v, p, j: (p + 4) * 8 + j)
    return Program(spark, _PROGRAM, registry).run()["N"].df.select("v")


@query("SELECT o_custkey AS c, l_suppkey AS s, sum(l_quantity) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def streaming_accumulation(spark, d):
    """The contraction again, with the lines as a stream."""
    from tensorweft.streaming.accumulate import Accumulator

    orders = Tensor.from_table(read_table(spark, d, "orders"), {"o": "o_orderkey", "c": "o_custkey"}, 1.0, sums=False)
    lines = read_table(spark, d, "lineitem")
    folder = _folder(spark, "stream")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/lineitem.parquet*")
    adapt = lambda batch: Tensor.from_table(batch, {"o": "l_orderkey", "s": "l_suppkey"}, "l_quantity", sums=False)
    sums = Accumulator(spark, f"{folder}/result", "D(c,s)+=L(o,s)*R(o,c)", orders, adapt)
    sums.start(stream, f"{folder}/checkpoint").awaitTermination()
    return sums.result().df


from tensorweft.plans import queries_keys  # noqa: E402, F401  its queries register themselves
