"""Contractions that deal their rows over as many tasks as these need."""

import random
import re

import numpy as np
import pytest

from tensorweft.operators import algebra, linalg, reduce
from tensorweft.operators.algebra import Spread, contract
from tensorweft.operators.tensor import Tensor, TensorError
from tensorweft.plans.queries import QUERIES


def exchanged(df) -> list[int]:
    """Tasks of each shuffle by key that the plan has."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(r"Exchange (?:hashpartitioning|shufflepartitionidpassthrough)\(.*, (\d+)\), ", plan)]


def queried(spark, sf_dir, monkeypatch, name: str) -> list[int]:
    monkeypatch.setattr(algebra, "TASK_ROWS", 500, raising=False)
    return exchanged(QUERIES[name](spark, sf_dir))


def test_tasks_of_keys_contraction(spark, sf_dir, monkeypatch):
    """A table of 12 times a task's rows goes to 12 tasks, whatever the session's number of shuffle partitions (4)."""
    assert set(queried(spark, sf_dir, monkeypatch, "keys_contraction")) == {12}


ROWS = [(random.Random(i).randint(0, 9), random.Random(-i - 1).randint(0, 5), i % 7 - 3, i % 3) for i in range(300)]
ROWS += [(3, 2, 1, 1)] * 200  # a coordinate with many rows


def dense(rows, k):
    out = np.zeros((10, 6), complex)
    for o, s, a, b in rows:
        out[o, s] += (a, b, a + 1j * b)[k]
    return out


@pytest.mark.parametrize("sums", [False, True])
@pytest.mark.parametrize("extents", [(10, 6), None])
def test_same_as_dense(spark, monkeypatch, sums, extents):
    df = spark.createDataFrame(ROWS, "o int, s int, a int, b int").repartition(3)
    made = lambda v, kind="R8": Tensor.from_table(df, {"o": "o", "s": "s"}, v, extents, kind, sums=sums)
    x, y, z = dense(ROWS, 0), dense(ROWS, 1), dense(ROWS, 2)
    read = lambda t, shape: t.with_df(t.df, extents=shape).to_numpy()
    spread = Spread(("o",), 5)
    for limit in (1, 1 << 18):  # the destination's coordinates are dealt anew, or not
        monkeypatch.setattr(algebra, "TASK_ROWS", limit)
        got = contract("D(a,b)+=L(o,a)*R(o,b)", made("a"), made("b"), factor=2.0, spread=spread)
        assert got.df.count() == got.df.select("a", "b").distinct().count()
        assert np.array_equal(read(got, (6, 6)), 2 * (x.T @ y).real)
        got = contract("D(a,b)+=L+(o,a)*R(o,b)", made(("a", "b"), "C8"), made("b"), spread=spread)
        assert np.array_equal(read(got, (6, 6)), z.conj().T @ y)
    got = contract("H(o,s)+=L(o,s)*R(o,s)", made("a"), made("b"), spread=Spread(("o", "s"), 7))
    assert np.array_equal(read(got, (10, 6)), (x * y).real) and got.df.count() == got.df.select("o", "s").distinct().count()
    got = contract("D(o,a,b)+=L(o,a)*R(o,b)", made("a"), made("b"), restrict=algebra.F.col("a") < algebra.F.col("b"), spread=spread)
    assert np.array_equal(read(got, (10, 6, 6)), np.triu(np.einsum("oa,ob->oab", x, y).real, 1))
    # one input has the labels, the other is small
    got = contract("D(o,q)+=L(o,s)*R(q,s)", made("a"), made("b").relabel(("q", "s")), spread=spread)
    assert np.array_equal(read(got, (10, 10)), (x @ y.T).real)
    into = made("a")
    got = contract("D(o,s)+=L(o,s)*R(o,s)", made("a"), made("b"), into, spread=spread)
    assert np.array_equal(read(got, (10, 6)), (x + x * y).real)


def test_no_rows_and_labels(spark):
    none, one = Tensor.zeros(spark, ("o", "s"), (4, 4)), Tensor.from_numpy(spark, np.eye(4), ("o", "s"))
    assert contract("D(a,b)+=L(o,a)*R(o,b)", none, one, spread=Spread(("o",), 3)).df.count() == 0
    for labels in (("o", "a"), ("x",)):
        with pytest.raises(TensorError):
            contract("D(a,b)+=L(o,a)*R(o,b)", one, one, spread=Spread(labels, 3))


def test_tasks_of_keys_orthogonal(spark, sf_dir, monkeypatch):
    """The sum of each task's 64 products is left to the session's four."""
    assert sorted(queried(spark, sf_dir, monkeypatch, "keys_orthogonal")) == [4] + [12] * 4


@pytest.mark.parametrize("kind", ["R8", "C8"])
@pytest.mark.parametrize("sums", [False, True])
def test_decompositions_by_tasks(spark, monkeypatch, kind, sums):
    """The same with rows dealt over tasks as numpy gives, in blocks of 12 elements; of the sides, either may be long."""
    monkeypatch.setattr(linalg, "BLOCK", 12)
    df = spark.createDataFrame(ROWS, "o int, s int, a int, b int").repartition(3)
    t = Tensor.from_table(df, {"o": "o", "s": "s"}, ("a", "b") if kind == "C8" else "a", (10, 6), kind, sums=sums)
    want = dense(ROWS, 2 if kind == "C8" else 0)
    for tasks in (1, 3, 50):
        u = linalg.gram_schmidt("D(o,s)=L(o,m)*R(m,s)", t, tasks=tasks).to_numpy()
        assert np.allclose(u.conj().T @ u, np.eye(6)) and np.allclose(u @ (u.conj().T @ want), want)
    for pattern, m in (("D(o,s)=L(o,m)*R(m,s)", want), ("D(s,o)=L(s,m)*R(m,o)", want.T)):
        x = t if m is want else algebra.add_pattern("D(s,o)+=L(o,s)", t)
        left, middle, right = linalg.svd(pattern, x, tasks=3)
        assert np.allclose((left.to_numpy() * middle.to_numpy()) @ right.to_numpy(), m)
        assert np.allclose(middle.to_numpy(), np.linalg.svd(m)[1])


def test_decompositions_without_rows(spark):
    for shape in ((5, 3), (0, 3)):
        none = Tensor.zeros(spark, ("o", "s"), shape)
        assert linalg.gram_schmidt("D(o,s)=L(o,m)*R(m,s)", none, tasks=4).df.filter("v <> 0").count() == 0


@pytest.mark.parametrize("name", ["keys_hadamard", "keys_hyper_contraction"])
def test_tasks_of_products_without_sums(spark, sf_dir, monkeypatch, name):
    assert queried(spark, sf_dir, monkeypatch, name) == [12, 12]


@pytest.mark.parametrize("name", ["keys_addition", "keys_custom"])
def test_tasks_of_sums(spark, sf_dir, monkeypatch, name):
    assert queried(spark, sf_dir, monkeypatch, name) == [12]


@pytest.mark.parametrize("sums", [False, True])
def test_sums_by_tasks(spark, sums):
    df = spark.createDataFrame(ROWS, "o int, s int, a int, b int").repartition(3)
    made = lambda v, kind="R8": Tensor.from_table(df, {"o": "o", "s": "s"}, v, (10, 6), kind, sums=sums)
    x, y, z = dense(ROWS, 0).real, dense(ROWS, 1).real, dense(ROWS, 2)
    spread = Spread(("o", "s"), 5)
    assert np.array_equal(algebra.add(made("a"), made("b"), 3.0, spread).to_numpy(), y + 3 * x)
    assert np.array_equal(algebra.add(made("a"), made(("a", "b"), "C8"), 2.0, spread).to_numpy(), z + 2 * x)
    got = algebra.custom(algebra.F.greatest, made("a"), made("b"), spread=spread)
    assert np.array_equal(got.to_numpy(), np.maximum(x, y)) and got.df.count() == got.df.select("o", "s").distinct().count()
    assert reduce.compare(made("a"), made("b"), spread=spread).first()[0] == (x != y).sum()
