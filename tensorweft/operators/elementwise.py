"""Unary operations: values, permutations, shapes, slices and diagonals. All but densifying ones are projections."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from tensorweft.operators.tensor import KINDS, VALUE, Tensor, TensorError, as_complex, c, dense, full, literal, settled, summed
from tensorweft.plans import pattern as P


def initialise(t: Tensor, value: complex | float = 0.0) -> Tensor:
    """Every element set to value; zero needs no rows."""
    spark = t.df.sparkSession
    if value == 0:
        return t.with_df(Tensor.zeros(spark, t.dims, t.extents, t.kind).df)
    return full(spark, t.dims, t.known(), value, t.kind, t.name)


def scale(t: Tensor, factor: complex | float) -> Tensor:
    factor = complex(factor)
    if factor.imag:
        t = as_complex(t)
    if not t.complex:
        return t.with_df(t.df.select(*map(c, t.dims), (F.col("v") * F.lit(factor.real)).cast(VALUE[t.kind]).alias("v")))
    re, im = F.col("re").cast("double"), F.col("im").cast("double")
    parts = (re * factor.real - im * factor.imag).alias("re"), (re * factor.imag + im * factor.real).alias("im")
    return t.with_df(t.df.select(*map(c, t.dims), *[x.cast(VALUE[t.kind]).alias(n) for x, n in zip(parts, ("re", "im"))]))


def conjugate(t: Tensor) -> Tensor:
    return t.with_df(t.df.select(*map(c, t.dims), "re", (-F.col("im")).alias("im"))) if t.complex else t


def real(t: Tensor) -> Tensor:
    return t.with_df(t.df.select(*map(c, t.dims), F.col("re").alias("v")), kind="R" + t.kind[1]) if t.complex else t


def imaginary(t: Tensor) -> Tensor:
    if t.complex:
        return t.with_df(t.df.select(*map(c, t.dims), F.col("im").alias("v")), kind="R" + t.kind[1])
    return t.with_df(t.df.filter(F.lit(False)))


def to_real(t: Tensor) -> Tensor:
    """Complex to real with the modulus kept and the sign of the real part; purely imaginary elements give their im."""
    if not t.complex:
        return t
    t = settled(t)
    re, im = F.col("re").cast("double"), F.col("im").cast("double")
    v = F.when(re != 0, F.hypot(re, im) * F.signum(re)).otherwise(im)
    return t.with_df(t.df.select(*map(c, t.dims), v.cast(VALUE[t.kind]).alias("v")), kind="R" + t.kind[1])


def cast(t: Tensor, kind: str) -> Tensor:
    """To another element kind; complex ones become real as by to_real."""
    if kind not in KINDS:
        raise TensorError(f"no such kind: {kind}")
    t = as_complex(t) if kind[0] == "C" else to_real(t)
    return t.with_df(t.df.select(*map(c, t.dims), *[F.col(n).cast(VALUE[kind]).alias(n) for n in t.values]), kind=kind)


def permute(t: Tensor, order: Sequence[str | int]) -> Tensor:
    """Dimensions in another order, given by names or positions."""
    names = [t.dims[x] if isinstance(x, int) else x for x in order]
    if sorted(names) != sorted(t.dims):
        raise TensorError(f"{order} isn't an order of {t.dims}")
    return t.with_df(t.df.select(*map(c, names), *t.values), dims=tuple(names), extents=tuple(t.extents[t.dims.index(n)] for n in names))


def copy(p: P.Pattern | str, t: Tensor) -> Tensor:
    """D(a,b) = L(b,a), conjugated if marked."""
    from tensorweft.operators.algebra import add_pattern

    p = P.parse(p) if isinstance(p, str) else p
    return add_pattern(P.Pattern(p.dest, p.inputs, "=", p.factor, p.text), t)


def _linear(t: Tensor, dims: Sequence[str]) -> Column:
    """Positions of coordinates in the order in which the first dimension runs fastest."""
    out, step = F.lit(0).cast("bigint"), 1
    for d in dims:
        out = out + c(d) * step
        step *= t.known()[t.dims.index(d)]
    return out


def _coordinates(at: Column, extents: Sequence[int]) -> list[Column]:
    out = []
    for n in extents:
        out.append(F.pmod(at, F.lit(n)).cast("bigint"))
        at = F.call_function("div", at, F.lit(n).cast("bigint"))
    return out


def fold(t: Tensor, dims: Sequence[str], into: str) -> Tensor:
    """Two dimensions or more as one, in their place of the first; the first of them runs fastest."""
    if len(dims) < 2:
        raise TensorError("folding takes two dimensions or more")
    at = min(t.dims.index(d) for d in dims)
    rest = [d for d in t.dims if d not in dims]
    n_before = sum(d not in dims for d in t.dims[:at])
    names = [*rest[:n_before], into, *rest[n_before:]]
    extent = prod(t.known()[t.dims.index(d)] for d in dims)
    columns = [(_linear(t, dims) if n == into else c(n)).alias(n) for n in names]
    return t.with_df(t.df.select(*columns, *t.values), dims=tuple(names), extents=tuple(extent if n == into else t.extents[t.dims.index(n)] for n in names))


def unfold(t: Tensor, dim: str, into: Sequence[str], extents: Sequence[int]) -> Tensor:
    """The inverse of fold."""
    k = t.dims.index(dim)
    if t.known()[k] != prod(extents):
        raise TensorError(f"{dim} has extent {t.extents[k]}, not {prod(extents)}")
    parts = [x.alias(n) for x, n in zip(_coordinates(c(dim), extents), into, strict=True)]
    df = t.df.select(*map(c, t.dims[:k]), *parts, *map(c, t.dims[k + 1 :]), *t.values)
    return t.with_df(df, dims=(*t.dims[:k], *into, *t.dims[k + 1 :]), extents=(*t.extents[:k], *extents, *t.extents[k + 1 :]))


def reshape(t: Tensor, dims: Sequence[str], extents: Sequence[int]) -> Tensor:
    """Other extents over the same volume, elements in the same linear order."""
    if prod(t.known()) != prod(extents):
        raise TensorError(f"volumes {prod(t.known())} and {prod(extents)}")
    at = t.df.select(_linear(t, t.dims).alias("_at"), *t.values)
    parts = [x.alias(n) for x, n in zip(_coordinates(F.col("_at"), extents), dims, strict=True)]
    return t.with_df(at.select(*parts, *t.values), dims=tuple(dims), extents=tuple(extents))


def inside(t: Tensor, offsets: Sequence[int], extents: Sequence[int]) -> Column:
    out = F.lit(True)
    for d, a, n in zip(t.dims, offsets, extents, strict=True):
        out = out & c(d).between(a, a + n - 1)
    return out


def slice_of(t: Tensor, offsets: Sequence[int], extents: Sequence[int], into: Tensor | None = None) -> Tensor:
    """t[offset : offset + extent] per dimension, from 0; added into `into` if given. The filter reaches the scan."""
    for n, a, e in zip(t.extents, offsets, extents, strict=True):
        if a < 0 or e < 0 or (n is not None and a + e > n):
            raise TensorError(f"slice {a}+{e} outside of {n}")
    moved = [(c(d) - a).alias(d) for d, a in zip(t.dims, offsets)]
    cut = t.with_df(t.df.filter(inside(t, offsets, extents)).select(*moved, *t.values), extents=tuple(extents))
    if into is None:
        return cut
    from tensorweft.operators.algebra import add

    return add(cut, into)


def insert(t: Tensor, part: Tensor, offsets: Sequence[int], accumulate: bool = False) -> Tensor:
    """part over (or, accumulating, onto) t from the offsets on."""
    part = part.relabel(t.dims)
    for n, a, e in zip(t.extents, offsets, part.known(), strict=True):
        if a < 0 or (n is not None and a + e > n):
            raise TensorError(f"slice {a}+{e} outside of {n}")
    kind = t.kind
    if t.complex != part.complex:
        t, part = as_complex(t), as_complex(part)
        kind = "C" + kind[1]
    moved = part.df.select(*[(c(d) + a).alias(d) for d, a in zip(t.dims, offsets)], *t.values)
    if accumulate:
        return t.with_df(summed([t.df, moved], t.dims, kind), kind=kind, unsummed=False)
    return t.with_df(t.df.filter(~inside(t, offsets, part.known())).unionByName(moved), kind=kind, unsummed=t.unsummed or part.unsummed)


def trace(p: P.Pattern | str, t: Tensor, into: Tensor | None = None) -> Tensor:
    """T(a) += Y(c,a,c): labels that repeat select the diagonal; those that the destination lacks are summed.

    A scalar trace overwrites its destination, others add to it. Equal labels need equal extents.
    """
    from tensorweft.operators.algebra import add

    p = P.check_trace(P.parse(p) if isinstance(p, str) else p)
    one = p.inputs[0]
    if one.rank != t.rank:
        raise TensorError(f"{one.name} has rank {t.rank}, not {one.rank}")
    if one.conj != p.dest.conj:
        t = conjugate(t)
    known: dict[str, int | None] = {}
    first: dict[str, int] = {}
    t = t.relabel([f"_d{i}" for i in range(t.rank)])
    same = F.lit(True)
    for i, x in enumerate(one.labels):
        if x in first:
            same = same & (c(f"_d{first[x]}") == c(f"_d{i}"))
            if None not in (known[x], t.extents[i]) and known[x] != t.extents[i]:
                raise TensorError(f"label {x} has extents {known[x]} and {t.extents[i]}")
        else:
            first[x], known[x] = i, t.extents[i]
    df = t.df.filter(same).select(*[c(f"_d{first[x]}").alias(x) for x in p.dest.labels], *t.values)
    if set(one.labels) - set(p.dest.labels):
        df = summed([df], p.dest.labels, t.kind)
    summing = bool(set(one.labels) - set(p.dest.labels))
    out = Tensor(df, p.dest.labels, tuple(known[x] for x in p.dest.labels), t.kind, p.dest.name, t.unsummed and not summing)
    return out if into is None or not p.dest.labels else add(out, into)


def restrict(t: Tensor, condition: Column | str) -> Tensor:
    """Coordinates under a condition alone, e.g. "a < b": ordered groups or any predicate."""
    return t.with_df(t.df.filter(condition))


def ordered(t: Tensor, *groups: tuple[Sequence[str], str]) -> Tensor:
    """Index restrictions: (dims, relation) with <, >, <= or >= between neighbours."""
    for dims, relation in groups:
        test = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}[relation]
        for a, b in zip(dims, dims[1:]):
            t = restrict(t, test(c(a), c(b)))
    return t


def transform(t: Tensor, f: Callable[..., Column | tuple[Column, Column]], keeps_zero: bool = True) -> Tensor:
    """v = f(v, coordinates...), for complex kinds (re, im) = f((re, im), coordinates...).

    A function that doesn't keep zero gets every coordinate.
    """
    t = settled(t) if keeps_zero else dense(t)
    value = tuple(map(F.col, t.values))
    made = f(value if t.complex else value[0], *map(c, t.dims))
    columns = [x.cast(VALUE[t.kind]).alias(n) for x, n in zip(made if t.complex else (made,), t.values, strict=True)]
    return t.with_df(t.df.select(*map(c, t.dims), *columns))


def fill(t: Tensor, value: complex | float) -> Tensor:
    """value at every coordinate that t has a row for."""
    t = settled(t)
    return t.with_df(t.df.select(*map(c, t.dims), *literal(value, t.kind)))
