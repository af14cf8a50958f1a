"""Tensor operations against numpy on small tensors."""

import itertools

import numpy as np
import pytest

from tensorweft.operators import elementwise as E
from tensorweft.operators import linalg, reduce
from tensorweft.operators.algebra import add, add_pattern, contract, custom, inner, joined, matmul
from tensorweft.operators.blocked import contract_blocked
from tensorweft.operators.tensor import Tensor, TensorError, from_function, full, random
from tensorweft.plans import network
from tensorweft.plans import pattern as P



def patterns(seed, n):
    """Pairwise patterns: free labels of either side, contracted ones, and for some a batch label, in any order."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        letters = list(r.permutation(list("klmnpqrs")))
        free_l, free_r, summed, batch = (letters[: r.integers(0, 3)], letters[2 : 2 + r.integers(0, 3)], letters[4 : 4 + r.integers(0, 3)], letters[6 : 6 + r.integers(0, 2)])
        order = lambda x: ",".join(r.permutation(x)) if x else ""
        out.append(f"D({order([*free_l, *free_r, *batch])})+=L({order([*free_l, *summed, *batch])})*R({order([*free_r, *summed, *batch])})")
    return out


PATTERNS = patterns(20, 18) + ["D()+=L()*R()", "S(x)+=L()*R(x)"]


def einsum(p, *arrays):
    letters = {x: chr(97 + i) for i, x in enumerate(dict.fromkeys(x for o in p.inputs for x in o.labels))}
    text = ",".join("".join(letters[x] for x in o.labels) for o in p.inputs) + "->" + "".join(letters[x] for x in p.dest.labels)
    return np.einsum(text, *arrays)


def arrays_for(p, seed, whole=False, sparse=True):
    rng = np.random.default_rng(seed)
    size = {x: 2 + i % 3 for i, x in enumerate(dict.fromkeys(x for o in p.inputs for x in o.labels))}
    out = []
    for o in p.inputs:
        shape = tuple(size[x] for x in o.labels)
        a = rng.integers(-3, 4, shape).astype(float)
        a = a + 1j * rng.integers(-3, 4, shape) if whole else a
        out.append(np.asarray(a * (rng.random(shape) < 0.8 if sparse else 1)))
    return out


def tensor(spark, a, prefix="x"):
    return Tensor.from_numpy(spark, a, [f"{prefix}{i}" for i in range(a.ndim)])


@pytest.mark.parametrize("text", PATTERNS)
def test_contractions(spark, text):
    p = P.parse(text)
    left, right = arrays_for(p, len(text))
    got = contract(p, tensor(spark, left), tensor(spark, right, "y"))
    assert np.allclose(got.to_numpy(), einsum(p, left, right))


@pytest.mark.parametrize("text", ["D(a,b)+=L+(c,a)*R(c,b)", "D+(a,b)+=L(c,a)*R(c,b)", "D+(a,b)+=L+(c,a)*R(c,b)", "D(i,j,k)+=L(k,a,i)*R+(k,a,j)"])
def test_conjugation(spark, text):
    p = P.parse(text)
    left, right = arrays_for(p, 3, whole=True)
    toggled = [a.conj() if o.conj != p.dest.conj else a for o, a in zip(p.inputs, (left, right))]
    got = contract(p, tensor(spark, left), tensor(spark, right, "y"), factor=0.5 - 1j)
    assert np.allclose(got.to_numpy(), (0.5 - 1j) * einsum(p, *toggled))


def test_mixed_kinds_and_accumulation(spark):
    p = P.parse("D(a,b)+=L(a,c)*R(c,b)")
    (left,), (right,) = [arrays_for(P.parse("D(a,b)+=L(a,b)"), 1)], [arrays_for(P.parse("D(a,b)+=L(a,b)"), 2, whole=True)]
    left, right = left[0], np.resize(right[0], (left[0].shape[1], 4))
    into = np.arange(left.shape[0] * 4.0).reshape(-1, 4)
    args = tensor(spark, left), tensor(spark, right, "y"), tensor(spark, into, "z")
    assert np.allclose(contract(p, *args).to_numpy(), into + left @ right)
    assert np.allclose(contract(p, *args, accumulate=False).to_numpy(), left @ right)
    assert contract(p, *args).kind == "C8"


def test_extents_must_fit(spark):
    with pytest.raises(TensorError):
        contract("D(a,b)+=L(a,c)*R(c,b)", tensor(spark, np.ones((2, 3))), tensor(spark, np.ones((4, 2)), "y"))


@pytest.mark.parametrize("text", [x for x in PATTERNS if not P.parse(x).batch()])
def test_blocks(spark, text):
    p = P.parse(text)
    left, right = arrays_for(p, 5)
    assert np.allclose(contract_blocked(p, tensor(spark, left), tensor(spark, right, "y"), 3).to_numpy(), einsum(p, left, right))


def test_products_of_two_large_sides(spark, monkeypatch):
    import tensorweft.operators.algebra as algebra

    monkeypatch.setattr(algebra, "BROADCAST_BYTES", 3 * 64)
    a, b = spark.range(20).toDF("a"), spark.range(15).toDF("b")
    assert sorted(tuple(r) for r in joined(a, b, []).select("a", "b").collect()) == list(itertools.product(range(20), range(15)))


NETWORKS = ["N(i,l)+=A(i,a)*B(a,b)*C(b,l)", "N()+=A(a,b)*B(b,c)*C(c,a)", "N(i,j,k,l)+=A(i,a)*B(a,j,b)*C(b,k,c)*D(c,l)", "N(a)+=A(a,b)*B(a,b)*C(a,b)", "N(b,a)+=A(a,b)"]


@pytest.mark.parametrize("text", NETWORKS)
def test_networks(spark, text):
    p = P.parse(text)
    arrays = arrays_for(p, 9)
    got = network.contract_network(p, *[tensor(spark, a, f"t{k}_") for k, a in enumerate(arrays)], factor=2.0)
    assert np.allclose(got.to_numpy(), 2 * einsum(p, *arrays))


def test_sizes_of_unknown_extents(spark):
    """A label of a long table counts for more than one of a short one, and known extents stay."""
    table = lambda n, a, b: Tensor.from_table(spark.range(n), {a: "id", b: "id"})
    long, short = table(10**6, "i", "a"), table(100, "a", "b")
    sizes = network.label_sizes(P.parse("D(i,b)+=L(i,a)*R(a,b)"), (long, short))
    assert sizes["i"] == sizes["a"] > 10 * sizes["b"] > 0
    known = Tensor.zeros(spark, ("a", "b"), (7, 0))
    assert network.label_sizes(P.parse("D(i,b)+=L(i,a)*R(a,b)"), (long, known))["a"] == 7


def test_orders():
    p = P.parse("N(i,l)+=A(i,a)*B(a,b)*C(b,l)")
    cheap = network.plan(p, {"i": 100, "a": 100, "b": 100, "l": 1})
    assert cheap[0] == (frozenset([1]), frozenset([2]))
    assert network.total_flops(p, {"i": 100, "a": 100, "b": 100, "l": 1}) == 2 * (10**4 + 10**4)
    many = P.parse("N(x0,x12)+=" + "*".join(f"T(x{i},x{i + 1})" for i in range(12)))
    assert len(network.plan(many, {f"x{i}": 2 for i in range(13)})) == 11


def test_unary(spark):
    a = np.arange(24.0).reshape(2, 3, 4)
    t = tensor(spark, a)
    dense = lambda x: x.to_numpy()
    assert np.array_equal(dense(E.permute(t, ["x2", "x0", "x1"])), a.transpose(2, 0, 1))
    assert np.array_equal(dense(E.copy("D(a,b,c)=L(c,a,b)", t)), np.einsum("cab->abc", a))
    assert np.array_equal(dense(E.reshape(t, ["p", "q"], [6, 4])), a.reshape((6, 4), order="F"))
    assert np.array_equal(dense(E.fold(t, ["x0", "x1"], "f")), a.reshape((6, 4), order="F"))
    assert np.array_equal(dense(E.unfold(E.fold(t, ["x0", "x1"], "f"), "f", ["x0", "x1"], [2, 3])), a)
    assert np.array_equal(dense(E.fold(t, ["x2", "x0"], "f")), a.transpose(2, 0, 1).reshape((8, 3), order="F"))
    assert np.array_equal(dense(E.slice_of(t, (1, 0, 2), (1, 2, 2))), a[1:, :2, 2:])
    b = a.copy()
    b[1:, :2, 2:] = -13
    assert np.array_equal(dense(E.insert(t, full(spark, "pqr", (1, 2, 2), -13.0), (1, 0, 2))), b)
    b = a.copy()
    b[1:, :2, 2:] += 5
    assert np.array_equal(dense(E.insert(t, full(spark, "pqr", (1, 2, 2), 5.0), (1, 0, 2), accumulate=True)), b)
    assert np.array_equal(dense(E.transform(t, lambda v, *x: v + 1, keeps_zero=False)), a + 1)
    assert np.array_equal(dense(E.initialise(t, 0)), a * 0) and np.array_equal(dense(E.initialise(t, 2.5)), a * 0 + 2.5)
    assert np.array_equal(dense(add_pattern("D(a,b,c)+=L(a,b,c)", t, t, -0.5)), 0.5 * a)
    assert np.array_equal(dense(custom(lambda x, y: x - 2 * y, t, t)), -a)
    assert np.array_equal(dense(E.restrict(t, "x0 < x1")), a * (np.arange(2)[:, None, None] < np.arange(3)[None, :, None]))
    with pytest.raises(TensorError):
        E.slice_of(t, (0, 0, 3), (1, 1, 2))
    with pytest.raises(TensorError):
        E.reshape(t, ["p"], [23])


def test_traces(spark):
    a = np.arange(64.0).reshape(4, 4, 4)
    t = tensor(spark, a)
    assert E.trace("T()+=X(a,a,a)", t).get_scalar() == np.einsum("iii", a)
    assert np.array_equal(E.trace("T(b)+=X(a,b,a)", t).to_numpy(), np.einsum("aba->b", a))
    assert np.array_equal(E.trace("T(a,b)+=X(a,b,a)", t).to_numpy(), np.einsum("aba->ab", a))
    one = Tensor.from_numpy(spark, np.array([1.0, 1, 1, 1]), ["b"])
    assert np.array_equal(E.trace("T(b)+=X(a,b,a)", t, one).to_numpy(), np.einsum("aba->b", a) + 1)


def test_complex_parts(spark):
    a = np.array([[3 + 4j, -3 + 4j], [2j, 0]])
    t = tensor(spark, a)
    assert np.allclose(E.to_real(t).to_numpy(), [[5, -5], [2, 0]])
    assert np.allclose(E.real(t).to_numpy(), a.real) and np.allclose(E.imaginary(t).to_numpy(), a.imag)
    assert np.allclose(E.conjugate(t).to_numpy(), a.conj()) and np.allclose(E.scale(t, 1 - 2j).to_numpy(), a * (1 - 2j))
    assert E.cast(t, "C4").df.dtypes[-1] == ("im", "float") and np.allclose(E.cast(t, "R8").to_numpy(), [[5, -5], [2, 0]])
    assert np.allclose(custom(lambda x, y: (x[0] + y[1], x[1] - y[0]), t, tensor(spark, a.real)).to_numpy(), a - 1j * a.real)
    assert np.allclose(E.transform(t, lambda z, i, j: (z[0] + i, z[1] + j), keeps_zero=False).to_numpy(), a + np.add.outer(np.arange(2), 1j * np.arange(2)))
    assert inner(t, t, conj=True).get_scalar() == pytest.approx(np.sum(np.abs(a) ** 2))


def test_reductions(spark):
    a = np.array([[1.0, -7, 0], [7, 2, 3]])
    t = tensor(spark, a)
    one = lambda df: df.first()[0]
    assert (one(reduce.norm1(t)), one(reduce.norm2(t)), one(reduce.max_abs(t)), one(reduce.min_abs(t))) == (20, 112, 7, 0)
    assert one(reduce.norm2(t, root=True)) == pytest.approx(112**0.5)
    assert tuple(reduce.argmax(t).first()) == (0, 1, -7.0)
    assert not one(reduce.has_nan(t)) and one(reduce.has_nan(E.transform(t, lambda v, *x: v * float("nan"))))
    b = a.copy()
    b[0, 0], b[1, 2], b[0, 2] = 1.005, 3.5, 1e-14
    assert one(reduce.compare(t, tensor(spark, b, "y"))) == 2 and one(reduce.compare(t, tensor(spark, b, "y"), relative=True)) == 2
    x, y = (Tensor.from_numpy(spark, np.array(v), ["i"]) for v in ([100.0, 1e-20, 3.0], [100.5, 0.0, 3.0]))
    assert one(reduce.compare(x, y)) == 1 and one(reduce.compare(x, y, relative=True)) == 1 and one(reduce.compare(x, y, threshold=1.0)) == 0
    assert one(reduce.compare(x, y, relative=True, threshold=1e-3)) == 2
    table = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, 3.0), (3, None)], "i long, v double")
    kept = Tensor.from_table(table, {"i": "i"}, "v", (4,))
    assert kept.df.count() == 3 and one(reduce.has_nan(kept))
    z = Tensor.zeros(spark, ["i"], [3])
    assert (one(reduce.norm1(z)), one(reduce.max_abs(z)), one(reduce.min_abs(z)), reduce.argmax(z).count()) == (0, 0, 0, 0)
    assert one(reduce.min_abs(full(spark, ["i"], [3], -2.0))) == 2


def test_scalars_and_sources(spark):
    assert Tensor.scalar(spark, 3.5).get_scalar() == 3.5 and Tensor.zeros(spark, [], []).get_scalar() == 0.0
    assert Tensor.from_table(spark.range(0), {}, 1.0).get_scalar() == 0.0
    with pytest.raises(TensorError):
        full(spark, ["i"], [2], 1.0).get_scalar()
    rows = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (1, 0, None), (None, 0, 9.0)], "i long, j long, v double")
    assert np.array_equal(Tensor.from_table(rows, {"i": "i", "j": "j"}, "v", (2, 2)).to_numpy(), [[0, 5], [0, 0]])
    twice = Tensor.from_table(rows, {"i": "i", "j": "j"}, "v", (2, 2), sums=False)
    assert twice.df.count() == 2 and inner(twice, full(spark, "xy", (2, 2), 1.0)).get_scalar() == 5
    assert np.array_equal(contract("H(a,b)+=L(a,b)*R(a,b)", twice, twice).to_numpy(), [[0, 25], [0, 0]]) and reduce.max_abs(twice).first()[0] == 5
    assert np.array_equal(E.transform(E.permute(twice, ["j", "i"]), lambda x, *at: x * x).to_numpy(), [[0, 0], [25, 0]]) and twice.show().count() == 1
    assert np.array_equal(contract_blocked("D(a,c)+=L(a,b)*R(c,b)", twice, twice, 2).to_numpy(), [[25, 0], [0, 0]])
    a = random(spark, ["i", "j"], (30, 30), 1).to_numpy()
    assert np.array_equal(a, random(spark, ["i", "j"], (30, 30), 1).to_numpy()) and 0.45 < a.mean() < 0.55 and 0 <= a.min() and a.max() < 1
    f = from_function(spark, ["i", "j"], (2, 3), lambda i, j: i * 10 + j)
    assert np.array_equal(f.to_numpy(), [[0, 1, 2], [10, 11, 12]])
    assert (f.rank, f.volume, f.bytes, f.shape) == (2, 6, 48, (2, 3))


def test_matmul(spark):
    a, b = np.full((4, 4, 2), 0.01), np.full((4, 2, 3), 0.001)
    got = matmul(tensor(spark, a), tensor(spark, b, "y"), 2, 0.5).to_numpy()
    assert np.allclose(got, 0.5 * np.einsum("abc,bcd->ad", a, b))
    with pytest.raises(TensorError):
        matmul(tensor(spark, a), tensor(spark, b, "y"), 3)


def test_known_values(spark):
    """Constant tensors, whose results follow from a formula."""
    n, x, y = 4, 1.234e-3 - 2.567e-4j, -9.743e-4 + 3.576e-3j
    left, right = full(spark, "id", (n, n), x, "C8"), full(spark, "abcd", (n,) * 4, y, "C8")
    d = contract("D(i,a,b,c)+=L(i,d)*R(a,b,c,d)", left, right)
    d = contract("D(i,a,b,c)+=L(i,d)*R(a,b,c,d)", left, right, d)
    assert np.allclose(d.to_numpy(), 2 * n * x * y)
    assert inner(d, d, conj=True).get_scalar() == pytest.approx(n**4 * abs(2 * n * x * y) ** 2)
    v, o = 4, 3
    d = full(spark, "abij", (v, v, o, o), 1.0)
    args = full(spark, "dicj", (o, v, o, v), 0.01), full(spark, "jbia", (v,) * 4, 0.001), d, 0.5
    once = contract("D(a,b,c,d)+=L(d,i,c,j)*R(j,b,i,a)", *args, accumulate=False)
    assert np.allclose(once.to_numpy(), 0.01 * 0.001 * v**2 * 0.5)
    assert np.allclose(add(once, once).to_numpy(), 0.01 * 0.001 * v**2)


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("text, shape, extents", [("D(a,b,c)=L(c,i,a)*R(i,b)", (3, 4, 2), None), ("D(a,b)=L(i,a)*R(b,i)", (5, 3), None), ("D(a,b)=L(i,a)*R(b,i)", (3, 5), None), ("D(a,b,c,d)=L(c,i,j,a)*R(j,d,i,b)", (2, 3, 2, 2), (2, 2))])
def test_decompositions(spark, text, shape, extents, whole):
    rng = np.random.default_rng(1)
    a = rng.normal(size=shape) + (1j * rng.normal(size=shape) if whole else 0)
    t = tensor(spark, a)
    p = P.parse(text)
    left, s, right = linalg.svd(p, t, inner_extents=extents)
    scaled = contract(P.Pattern(P.Operand("L", left.dims), (P.Operand("L", left.dims), P.Operand("S", s.dims))), left, s)
    assert np.allclose(contract(p, scaled, right).to_numpy(), a)
    for absorb in ("left", "right", "both"):
        x, _, y = linalg.svd(p, t, inner_extents=extents, absorb=absorb)
        assert np.allclose(contract(p, x, y).to_numpy(), a)


def test_truncation_and_orthogonalisation(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(6, 4))
    u, s, v = np.linalg.svd(a, full_matrices=False)
    t = tensor(spark, a)
    left, mid, right = linalg.svd("D(a,b)=L(a,i)*R(i,b)", t, k=2, absorb="left")
    assert np.allclose(mid.to_numpy(), s[:2]) and np.allclose(contract("D(a,b)+=L(a,i)*R(i,b)", left, right).to_numpy(), (u[:, :2] * s[:2]) @ v[:2])
    assert np.allclose(linalg.orthogonalise("D(a,b)=L(a,i)*R(i,b)", t).to_numpy(), u @ v)
    rank1 = np.outer([1.0, 2, 3], [4.0, 5])
    left, mid, right = linalg.svd("D(a,b)=L(a,i)*R(i,b)", tensor(spark, rank1), absorb="both")
    assert np.allclose(contract("D(a,b)+=L(a,i)*R(i,b)", left, right).to_numpy(), rank1) and mid.to_numpy()[1] == 0
    with pytest.raises(P.PatternError):
        linalg.svd("D(a,b)=L(a,i)*R(b,j)", t)
    with pytest.raises(TensorError):
        linalg.svd("D(a,b)=L(a,i)*R(i,b)", Tensor.zeros(spark, "ab", (5000, 5000)))


@pytest.mark.parametrize("whole", [False, True])
def test_gram_schmidt(spark, whole):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(3, 2, 4)) + (1j * rng.normal(size=(3, 2, 4)) if whole else 0)
    got = linalg.gram_schmidt("D(a,b,c)=L(i,c,a)*R(b,i)", tensor(spark, a)).to_numpy()
    q, r = np.linalg.qr(a.transpose(2, 0, 1).reshape((12, 2), order="F"))
    want = q * (np.diag(r) / np.abs(np.diag(r)))
    assert np.allclose(got.transpose(2, 0, 1).reshape((12, 2), order="F"), want)
    ones = linalg.gram_schmidt("D(a,b)=L(i,a)*R(b,i)", tensor(spark, np.ones((3, 2)))).to_numpy()
    assert np.allclose(ones, np.outer(np.ones(3), [1, 0]) / np.sqrt(3))
    near = np.array([[1, 1, 0], [1e-8, 0, 0], [0, 1e-8, 1.0]])
    u = linalg.gram_schmidt("D(a,b)=L(i,a)*R(b,i)", tensor(spark, near)).to_numpy()
    assert np.allclose(u.T @ u, np.eye(3), atol=1e-7)


@pytest.mark.parametrize("whole", [False, True])
def test_small_singular_values(spark, whole, monkeypatch):
    """Values far below the square root of the machine's epsilon stay, through a tree of many blocks, for both shapes."""
    values = np.array([1, 1e-5, 1e-9])
    got = linalg.singular_values("D(a,b)=L(a,i)*R(i,b)", tensor(spark, np.diag(values))).to_numpy()
    assert np.allclose(got, values, rtol=1e-12, atol=0)
    monkeypatch.setattr(linalg, "BLOCK", 1)
    monkeypatch.setattr(linalg, "FAN", 2)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 3)) + (1j * rng.normal(size=(40, 3)) if whole else 0)
    for a in (m, m.T):
        s = np.linalg.svd(a, compute_uv=False)
        assert np.allclose(linalg.singular_values("D(a,b)=L(a,i)*R(i,b)", tensor(spark, a)).to_numpy(), s, rtol=1e-12)
