"""Programs, spaces, functors, storage, streams and scalar helpers."""

import random
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorweft.functions import scalars
from tensorweft.functions.functors import Registry
from tensorweft.operators.tensor import Tensor, TensorError, full
from tensorweft.operators import views
from tensorweft.plans import spaces
from tensorweft.plans.program import Program, ProgramError, recognise
from tensorweft.plans.runtime import Runtime
from tensorweft.sources.storage import Catalog, load, save
from tensorweft.streaming.accumulate import Accumulator


def run(spark, body, registry=None, storage=None, extra=""):
    text = f"entry: main\nscope main group(g)\n space(real): s=[0:5], t=[1:4]\n subspace(s): lo=[0:2], hi=[3:5]\n index(lo): i,j,k\n index(hi): a,b\n index(s): p,q\n index(t): u,v\n{body}\nend scope main\n{extra}"
    return Program(spark, text, registry, storage).run()


def test_slices(spark):
    out = run(spark, """
 T(p,q) = 1.0          # 6 x 6
 T(i,a) = 5.0
 S(i,b) = T(i,b)
 T(a,b) += T(a,b) * 2.0
 T(i,j) *= 2.0
 T(i,j) /= 4.0
 T(i,a) -= S(i,a) * 0.5
 T(i,a) += S(i,a) * 0.5
""")
    t = np.ones((6, 6))
    t[:3, 3:] = 5
    t[3:, 3:] = 3
    t[:3, :3] = 0.5
    assert np.array_equal(out["T"].to_numpy(), t) and np.array_equal(out["S"].to_numpy(), np.full((3, 3), 5.0))


def test_operations(spark):
    registry = Registry()
    registry.register_method("count", lambda v, x, y: x * 10 + y)
    registry.register_predicate("even", lambda x, y: (x + y) % 2 == 0)
    registry.register_data("half", 0.5)
    out = run(spark, """
 V(u,v) => method("count")
 W(u,v) = V(v,u)
 X() += V(u,u)
 Y(u,v) = 2.0 : [u<v]
 E(u,v) = 1.0 : [even:u,v]
 Z(u,v) += V(u,v) * W(u,v) * half
 N(u,v) => V(u,x) * W(x,y) * Y(y,v)
 M(u,v) = N(u,v)
 index: w=u
 subspace(): f=[0:15]
 F(f) = V(u,v)
 U(u,v) = F(f)
 D(2:3,7) = {1.0,2.0}
 R(u,v) = ?
 R(u,v) = V(u,v)
 ~D
 destroy Y(3:4,3:4)
""".replace(" destroy Y(3:4,3:4)\n", ""), registry)
    v = np.add.outer(np.arange(4) * 10.0, np.arange(4))
    y = 2 * np.triu(np.ones((4, 4)), 1)
    assert np.array_equal(out["W"].to_numpy(), v.T) and out["X"].get_scalar() == np.trace(v) and np.array_equal(out["Y"].to_numpy(), y)
    assert np.array_equal(out["E"].to_numpy(), np.add.outer(np.arange(4), np.arange(4)) % 2 == 0)
    assert np.array_equal(out["Z"].to_numpy(), v * v.T / 2) and np.array_equal(out["M"].to_numpy(), v @ v.T @ y)
    assert np.array_equal(out["F"].to_numpy(), v.reshape(-1, order="F")) and np.array_equal(out["U"].to_numpy(), v)
    assert "D" not in out and "N" not in out


def test_storage_and_exchange(spark, tmp_path):
    out = run(spark, """
 A(u,v) = 2.0
 save A(u,v): tag("an old tensor")
 destroy A
 load B(x,y): tag("an old tensor")
 export B: tag("B") to(g:w)
 invoke other
 import C(): tag("C")
""", storage=f"file://{tmp_path}", extra="scope other group(g)\n import Q(m,n): tag(\"B\")\n Q(m,n) *= 3.0\n C() = Q(m,n) * Q(m,n)\n export C(): tag(\"C\")\nend scope other\n")
    assert out["C"].get_scalar() == 16 * 36.0


@pytest.mark.parametrize("body, extra", [
    (" T(x,y) = 1.0", ""), (" A(i) = B(i)", ""), (" invoke nothing", ""), (" T(i,j) = 1.0\n T(a,j) = 2.0", ""), (" T(i) = ?\n S(i) = T(i)", ""), (" nonsense", ""), (" subspace(s): z=[4:9]", ""), (" S(i) = method(\"none\")", ""), (" T(i,j) = 1.0\n S(i) = T(i,j)", ""),
    (" A(i) = 1.0\n export A(i): tag(\"A\") to(h:r)\n invoke o", "scope o group(g)\n import A(i): tag(\"A\")\nend scope o\n"), (" A(i) = 1.0\n export A(i): tag(\"A\") to(g:r)\n invoke o", "scope o group(g)\n import A(i): tag(\"A\")\n A(i) = 2.0\nend scope o\n"),
])
def test_refused(spark, body, extra):
    with pytest.raises(ProgramError):
        run(spark, body, extra=extra)


@pytest.mark.parametrize("text", ["", "entry: a\n", "scope a group()\nend scope a\n", "entry: a\nscope a group()\nend scope b\n", "entry: a\nx\n"])
def test_structure(spark, text):
    with pytest.raises(ProgramError):
        Program(spark, text)


def test_spaces(spark):
    s = spaces.Space("s", 6, colors=[0, 0, 1, 1, 1, 2])
    assert s.level(1) == [(0, 2), (2, 6)] and s.level(9) == [(0, 2), (2, 5), (5, 6)]
    assert spaces.segment_count(10, 3) == 4 and spaces.segment_count(0, 3) == 0
    assert spaces.split_range(0, 10, 3) == [(0, 3), (3, 7), (7, 10)] and spaces.split_range(2, 3, 4) == [(2, 3)]
    r = spaces.SpaceRegistry()
    r.register_space("o", 8)
    r.register_subspace("x", "o", 5, 7)
    r.register_label("i", "x")
    assert r.extent("i") == 2 and r.range_of("o") == ("o", 0, 8) and r.smallest_covering("x") == (4, 8) and r.embedding("i") == (4, 1) and r.exists("i")
    assert r.resolve((0, 3), lambda k: 7 + k) == (7, 3)
    with pytest.raises(spaces.SpaceError):
        r.register_subspace("y", "o", 5, 9)
    r.unregister_space("o")
    assert not r.exists("i")
    tree = spaces.Space("t", 8).table(spark)
    assert tuple(spaces.common_subspace(tree, 9, 10).first()) == (4, 2, 4) and tuple(spaces.common_subspace(tree, 7, 14).first()) == (0, 0, 8)
    assert spaces.ancestors(tree).count() == 2 * 1 + 4 * 2 + 8 * 3


def test_range_join(spark):
    rng = np.random.default_rng(0)
    x = [(i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-50, 50, 40), rng.integers(0, 30, 40)))]
    y = [(i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-50, 50, 40), rng.integers(0, 30, 40)))]
    got = spaces.range_join(spark.createDataFrame(x, "i int, lo int, hi int"), spark.createDataFrame(y, "j int, a int, b int"), "lo", "hi", "a", "b", 7)
    want = sorted((i, j) for i, lo, hi in x for j, a, b in y if lo < hi and a < b and lo < b and a < hi)
    assert sorted((r.i, r.j) for r in got.collect()) == want


def test_functors(spark):
    r = Registry()
    r.register_method("double", lambda v, i: v * 2)
    r.register_block_method("plus", lambda part: part.assign(v=part.v + part.i))
    t = Tensor.from_numpy(spark, np.array([1.0, 0, 3]), ["i"])
    assert np.array_equal(r.apply(t, "double", keeps_zero=True).to_numpy(), [2, 0, 6]) and np.array_equal(r.apply(t, "plus").to_numpy(), [1, 1, 5])
    with pytest.raises(TensorError):
        r.register_method("double", lambda v, i: v)
    r.unregister_method("double")
    with pytest.raises(TensorError):
        r.unregister_method("double")
    r.traverse(t, lambda rows: [None for _ in rows])


def test_catalog_and_files(spark, tmp_path):
    t = full(spark, ["i", "j"], [2, 3], 1.5 + 2j, "C8", "T")
    save(t, f"file://{tmp_path}/t")
    back = load(spark, f"file://{tmp_path}/t")
    assert (back.dims, back.extents, back.kind, back.name) == (t.dims, t.extents, t.kind, t.name) and np.array_equal(back.to_numpy(), t.to_numpy())
    k = Catalog()
    k.create(t)
    with pytest.raises(TensorError):
        k.get("T")
    k.put("T", t)
    assert k.status("T") == "updated" and k.get("T").name == "T"
    k.destroy("T")
    assert k.status("T") == "absent"
    with pytest.raises(TensorError):
        k.destroy("T")


def test_stream(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 5).alias("o"), (F.col("id") % 3).alias("s"))
    rows.repartition(6).write.parquet(f"{tmp_path}/in")
    static = Tensor.from_numpy(spark, np.arange(10.0).reshape(5, 2), ["o", "c"])
    adapt = lambda batch: Tensor.from_table(batch, {"o": "o", "s": "s"}, 1.0)
    acc = Accumulator(spark, f"file://{tmp_path}/out", "D(c,s)+=L(o,s)*R(o,c)", static, adapt)
    stream = spark.readStream.schema("o long, s long").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    acc.start(stream, f"file://{tmp_path}/ck").awaitTermination()
    counts = np.zeros((5, 3))
    for i in range(60):
        counts[i % 5, i % 3] += 1
    want = np.arange(10.0).reshape(5, 2).T @ counts
    got = acc.result()
    assert np.array_equal(Tensor(got.df, got.dims, (2, 3)).to_numpy(), want)
    acc.update(spark.range(0).select(F.col("id").alias("o"), F.col("id").alias("s")), 0)  # a batch run again replaces itself
    assert acc.result().df.agg(F.sum("v")).first()[0] < want.sum()


def test_scalars(spark):
    df = spark.createDataFrame([(3.0, -4.0, 1.0, 2.0)], "a double, b double, x double, y double")
    z, w = (F.col("a"), F.col("b")), (F.col("x"), F.col("y"))
    one = lambda pair: complex(*df.select(*pair).first())
    assert one(scalars.complex_multiply(z, w)) == (3 - 4j) * (1 + 2j) and one(scalars.complex_divide(z, w)) == (3 - 4j) / (1 + 2j)
    assert one(scalars.complex_sqrt(z)) == 2 - 1j and one(scalars.complex_add(z, w)) == 4 - 2j and one(scalars.complex_subtract(z, w)) == 2 - 6j
    n = spark.createDataFrame([(-1, 0), (5, 2), (20, 10), (6, 7)], "n long, k long")
    assert [tuple(r) for r in n.select(scalars.factorial("n"), scalars.binomial("n", "k")).collect()] == [(-1, 0), (120, 10), (2432902008176640000, 184756), (720, 0)]
    p = spark.createDataFrame([([2, 0, 1],), ([1, 0, 2],)], "p array<int>")
    assert [tuple(r) for r in p.select(scalars.permutation_sign("p"), scalars.inverse_permutation("p")).collect()] == [(1, [1, 2, 0]), (-1, [1, 0, 2])]
    assert scalars.permutation_cycles([1, 0, 2]) == [(0, 1), (2,)] and sorted(scalars.random_permutation(5, 1)) == list(range(5))
    assert sum(scalars.random_composition(9, 4, 2)) == 9 and scalars.cluster_points([5, 1, 2, 9], 0.6) == [[5], [1, 2], [9]]


def test_clusters(spark):
    """Over many partitions, with repeated values, as in one scan."""
    r = random.Random(8)
    for tolerance in (0.5, 3.0):
        values = [round(r.gauss(r.choice([0, 5, 30]), 1), 2) for _ in range(300)] + [1.0] * 40
        df = spark.createDataFrame([(x,) for x in [*values, None, float("nan")]], "x double").repartition(5)
        got = scalars.clusters(df, "x", tolerance).collect()
        want = scalars.cluster_points(sorted(values), tolerance)
        assert sorted((x.x, x.cluster) for x in got if x.cluster is not None) == sorted((x, k) for k, c in enumerate(want) for x in c)
        assert all(abs(x.cluster_mean - sum(want[x.cluster]) / len(want[x.cluster])) < 1e-9 for x in got if x.cluster is not None)
        assert sum(x.cluster is None for x in got) == 2 and 5 < len(want) < 250
    assert scalars.clusters(spark.createDataFrame([], "x double"), "x", 1.0).count() == 0


@pytest.mark.parametrize("text, kind", [("T(a) = 1.0", "assignment"), ("T(a) *= 2", "scaling"), ("T(a)/=2", "scaling"), ("T(a)+=S(a)*2.0", "addition"), ("T(a)-=S(a)", "addition"), ("T(a,b)+=L(a,c)*R(c,b)", "contraction"), ("T(a)=?", "create"), ("CREATE_ARRAY T(a,b)", "create"), ("~T", "delete"), ("DELETE_ARRAY T", "delete"), ("index: a=b", None), ("T(a) = S(a)", "assignment")])
def test_recognition(text, kind):
    assert recognise(text) == kind


def test_runtime(spark):
    r = Runtime(spark)
    a = full(spark, ["i", "k"], [3, 4], 2.0)
    b = full(spark, ["k", "j"], [4, 2], 0.5)
    for name in ("coordinates", "blocks", "auto"):
        r.set_algorithm(name)
        assert np.array_equal(r.contract("D(i,j)+=L(i,k)*R(k,j)", a, b).to_numpy(), np.full((3, 2), 4.0))
    assert r.flops == 3 * 2 * 3 * 4 * 2 and r.statistics()["operations"] == 3
    first = r.submit(lambda: 1, "first")
    second = r.submit(lambda: first.wait() + 1, "second", after=[first])
    bad = r.submit(lambda: 1 / 0, "bad")
    assert second.wait(60) == 2 and isinstance(bad.future.exception(60), ZeroDivisionError)
    assert r.status() == {"scheduled": 0, "running": 0, "completed": 2, "failed": 1}
    assert r.sync(a, b, timeout=120)
    r.discard(r.place(a))
    with pytest.raises(TensorError):
        r.set_algorithm("none")
    assert r.create(["i"], [3]).to_numpy().sum() == 0
    r.tasks.remove(bad)
    r.stop(session=False)


def test_views(spark):
    a = np.arange(60.0).reshape(3, 4, 5)
    t = Tensor.from_numpy(spark, a, ["x", "y", "z"])
    parts = views.subtensors(t, 12)
    assert sum(p.volume for p in parts) == 60 and all(p.volume <= 12 for p in parts)
    empty = Tensor.zeros(spark, ["x", "y", "z"], (3, 4, 5))
    assert np.array_equal(views.direct_sum(empty, *[(p.offsets, p.tensor()) for p in parts]).to_numpy(), a)
    b = a.copy()
    b[1:, :2, 3:] = 1
    assert np.array_equal(views.SliceView(t, (1, 0, 3), (2, 2, 2)).write(full(spark, "pqr", (2, 2, 2), 1.0)).to_numpy(), b)
    assert [tuple(r) for r in views.top(t, 2).collect()] == [(2, 3, 4, 59.0), (2, 3, 3, 58.0)]
    assert views.ordered(t, "z").first()["z"] == 0 and views.strong_dimensions((3, 40, 5), threshold=4) == [1, 2]


@pytest.mark.parametrize("text", ["D(a,b)+=L(a,c)*R(c,b)", "D(k,a,b)+=L(k,a,c)*R(k,c,b)", "E()+=L(a,b)*R(a,b)", "D(a,b)+=L(a)*R(b)"])
def test_parts(spark, text):
    from tensorweft.plans import pattern as P

    from .test_tensors import arrays_for, einsum, tensor

    p = P.parse(text)
    left, right = arrays_for(p, 4)
    got = views.contract_in_parts(p, tensor(spark, left), tensor(spark, right, "y"), 3)
    assert np.allclose(got.to_numpy(), einsum(p, left, right))


def test_matching_blocks(spark):
    a, b = np.zeros((6, 6)), np.zeros((6, 6))
    a[0, 5], a[5, 1], b[4, 0], b[5, 5] = 1, 1, 1, 1
    got = views.matching_blocks("D(i,j)+=L(i,k)*R(k,j)", Tensor.from_numpy(spark, a, ["i", "k"]), Tensor.from_numpy(spark, b, ["k", "j"]), 3)
    assert sorted((r.b_i, r.b_k, r.b_j) for r in got.collect()) == [(0, 1, 0), (0, 1, 1)]
