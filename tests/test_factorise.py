"""Networks that tensors are factorised into, by pattern and by program; deferred operations and named readers."""

import numpy as np
import pytest

from tensorweft.functions.functors import Registry
from tensorweft.operators.factorise import factorise
from tensorweft.operators.tensor import Tensor, TensorError
from tensorweft.plans import pattern as P
from tensorweft.plans.network import contract_network
from tensorweft.plans.program import Program, ProgramError
from tensorweft.plans.runtime import Runtime


def some(spark, shape, whole=False, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=shape) + (1j * rng.normal(size=shape) if whole else 0)
    return a, Tensor.from_numpy(spark, a, [f"x{i}" for i in range(a.ndim)])


NETWORKS = [
    ("D(i,j,k,l)=A(i,a)*B(a,j,b)*C(b,k,c)*E(c,l)", (2, 3, 2, 3), {"a": 2, "b": 6, "c": 3}),
    ("D(i,j,k)=A(i,j,d)*S(d)*B(d,k)", (2, 3, 4), {"d": 4}),
    ("D(i,j,k)=A(k,a)*B(i,b)*R(a,b,j)", (2, 3, 4), {"a": 4, "b": 2}),
    ("D(i,j,k)=A(i,a,c)*B(a,j,b)*C(b,k,c)", (2, 3, 2), {"a": 2, "b": 4, "c": 2}),
    ("D(i,j)=A(i,a,b)*S(a,b)*B(a,b,j)", (4, 6), {"a": 2, "b": 2}),
    ("D(i,j)=A(i,a)*B(a,j)", (3, 2), {"a": 5}),
    ("D(i,j)=A(i,a)*M(a,b)*B(b,j)", (3, 2), {"a": 3, "b": 2}),
    ("D(i,j)=A(i,j)", (3, 2), {}),
]


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("text, shape, extents", NETWORKS)
def test_products(spark, text, shape, extents, whole):
    a, t = some(spark, shape, whole)
    p = P.parse(text)
    made = factorise(p, t, extents)
    size = extents | dict(zip(p.dest.labels, shape))
    assert [m.known() for m in made] == [tuple(size[x] for x in o.labels) for o in p.inputs]
    letters = {x: chr(97 + i) for i, x in enumerate(size)}
    spec = ",".join("".join(letters[x] for x in o.labels) for o in p.inputs) + "->" + "".join(letters[x] for x in p.dest.labels)
    assert np.allclose(np.einsum(spec, *[m.to_numpy() for m in made]), a)


def test_marks_and_factor(spark):
    a, t = some(spark, (2, 3), True)
    left, right = (x.to_numpy() for x in factorise("D(i,j)=A+(i,a)*B(a,j)*0.5", t, {"a": 2}))
    assert np.allclose(left.conj() @ right * 0.5, a)


def test_short_bonds(spark):
    a, t = some(spark, (4, 5))
    u, s, v = np.linalg.svd(a)
    left, mid, right = (x.to_numpy() for x in factorise("D(i,j)=A(i,d)*S(d)*B(d,j)", t, {"d": 2}))
    assert np.allclose(mid, s[:2]) and np.allclose(left * mid @ right, (u[:, :2] * s[:2]) @ v[:2])
    made = factorise("D(i,j)=A(i,d)*S(d)*B(d,j)", Tensor.zeros(spark, "ij", (4, 5)), {"d": 2})
    assert all(not x.to_numpy().any() for x in made)


@pytest.mark.parametrize("text", ["D(i,j)=A(i,a)*A(a,j)", "D(i,j)=A(i)*B(j)", "D(i,j)=A(i,a,a)*B(j)", "D(i,j)=A(i,a)*B(a,j)*C(a,b)*E(b)", "D(i,j)=A(i,a)*B(a)", "D(i,j)=A(i,a,j)*B(a,j)"])
def test_refused(spark, text):
    with pytest.raises(P.PatternError):
        factorise(text, some(spark, (2, 3))[1], {"a": 2, "b": 2})


def test_lengths_are_needed(spark):
    with pytest.raises(TensorError):
        factorise("D(i,j)=A(i,a)*B(a,j)", some(spark, (2, 3))[1], {})


BODY = """entry: main
scope main group(g)
 space(real): s=[0:5], t=[1:4], r=[0:3]
 subspace(s): lo=[0:2], hi=[3:5]
 index(lo): i,j
 index(t): l
 index(r): c,d
 T(i,j,l) = method("mixed")
 N(i,j,l) => A(i,j,d) * S(d) * B(d,l)
 N(i,j,l) = T(i,j,l) * 2.0
{more}
 M(i,j,l) = N(i,j,l)
end scope main
"""


def factors(spark, more=" A+(i,j,c) * A(i,j,d) = DELTA(c,d)\n B+(c,l) * B(d,l) = DELTA(c,d)", **how):
    registry = Registry()
    registry.register_method("mixed", lambda v, i, j, l: 1.0 + (i * 7 + j * j * 3 + l * l * (i + 1)) % 11)  # noqa: E741
    return Program(spark, BODY.format(more=more, **how), registry).run()


def test_program(spark):
    out = factors(spark)
    t = out["T"].to_numpy() * 2
    assert np.allclose(out["M"].to_numpy(), t) and out["A"].known() == (3, 3, 4) and out["S"].known() == (4,)
    assert np.allclose(out["S"].to_numpy(), np.linalg.svd(t.reshape(9, 4), compute_uv=False))


def test_constraint_fails(spark):
    with pytest.raises(ProgramError, match="orthonormal"):
        factors(spark, " A(i,j,d) *= 2.0\n A+(i,j,c) * A(i,j,d) = DELTA(c,d)")


def test_deferred(spark):
    run = Runtime(spark)
    (a, x), (b, y), (e, z) = some(spark, (3, 4), seed=1), some(spark, (4, 2), seed=2), some(spark, (3, 2), seed=5)
    one = run.defer("product")
    assert one.status == "empty"
    with pytest.raises(TensorError):
        one.output()
    one.argument(2, y).argument(0, z)
    assert one.status == "partial"
    with pytest.raises(TensorError):
        one.execute()
    one.argument(1, x).specify("D(i,j)+=L(i,k)*R(k,j)", 2.0)
    assert one.status == "specified"
    two = run.defer("turned").argument(1, z).specify("D(j,i)+=L(i,j)")
    with pytest.raises(TensorError):
        two.execute([one])
    one.execute()
    two.execute([one])
    assert np.allclose(one.output().to_numpy(), 2 * a @ b + e) and np.allclose(two.output().to_numpy(), e.T) and one.status == "completed"
    with pytest.raises(TensorError):
        one.argument(1, z)
    assert one.clear().status == "empty"
    net = run.defer().argument(1, x).argument(2, y).argument(3, z).specify("D(i,m)+=A(i,k)*B(k,j)*C(m,j)")
    net.execute()
    assert np.allclose(net.output().to_numpy(), a @ b @ e.T)


def test_readers(spark):
    registry = Registry()
    a, t = some(spark, (3, 4), True)
    value, at = registry.read(t, "_TensorMax_")
    assert at == np.unravel_index(np.abs(a).argmax(), a.shape) and np.isclose(value, a[at])
    assert registry.read(Tensor.zeros(spark, "ij", (2, 2)), "_TensorMax_") is None
    assert np.array_equal(registry.read(t, "_RetrieveTensor_"), a)
    assert registry.read(Tensor.scalar(spark, 2.5), "_RetrieveScalar_") == 2.5
    assert registry.read(t, "_PrintTensor_").count() == a.size
    registry.register_reader("rank", lambda t: t.rank)
    assert registry.read(t, "rank") == 2
    with pytest.raises(TensorError):
        registry.register_method("rank", lambda v: v)
    with pytest.raises(TensorError):
        registry.read(t, "none")


def test_algorithm_by_estimated_rows(spark):
    """The rows of a tensor that executors keep are known to the optimiser, so it is seen to be dense."""
    run = Runtime(spark)
    t = Tensor(spark.range(6).selectExpr("id DIV 3 AS i", "id % 3 AS j", "1.0D AS v").cache(), ("i", "j"), (2, 3))
    assert t.df.count() == 6
    assert run._dense(t) and not run._dense(Tensor.zeros(spark, "ij", (2, 3)))
    assert np.allclose(run.contract("D(i,k)+=L(i,j)*R(k,j)", t, t).to_numpy(), np.full((2, 2), 3.0))
