"""Binary tensor algebra: contraction in all its forms, addition, matrix products and custom element-wise operations.

A contraction is an equi-join on the labels that both inputs have, a product and a sum by the destination's labels; the
sum is partial on the map side and Catalyst picks the join. Labels that nothing sums need no aggregation. Products
without a shared label have no key to join by: the side that is small, by a count of it, is broadcast; if neither is,
both are dealt over a grid of blocks, so that no task holds a whole side.

A contraction, addition or custom operation that is told to spread deals its rows over as many tasks as their number needs
(see Spread), and sums and joins within these tasks, so that a task's memory doesn't grow with the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from tensorweft.operators.tensor import VALUE, Tensor, TensorError, as_complex, c, dense, summed, wider
from tensorweft.plans import pattern as P

#: Bytes that a broadcast side of a product has at most.
BROADCAST_BYTES = 16 << 20
#: Rows of a task of an operation that spreads.
TASK_ROWS = 1 << 18


@dataclass(frozen=True)
class Spread:
    """Rows go to tasks by the hash of their coordinates in labels: for many coordinates that have few rows each."""

    labels: tuple[str, ...]
    tasks: int

    def deal(self, df: DataFrame) -> DataFrame:
        """df, with the number of each row's task in _task. What keeps this column is grouped or joined by it without a shuffle."""
        return df.withColumn("_task", F.pmod(F.xxhash64(*[c(x).cast("bigint") for x in self.labels]), F.lit(self.tasks)).cast("int")).repartitionById(self.tasks, F.col("_task"))


def grouped(df: DataFrame, dims: Sequence[str], spread: Spread | None = None) -> GroupedData:
    """Rows by coordinates; with spread, within the tasks that it deals them to."""
    return df.groupBy(*map(c, dims)) if spread is None else spread.deal(df).groupBy(*map(c, dims), "_task")


def tasks(df: DataFrame) -> int:
    """That a spread operation on df's rows needs, by a count of them; as many as a shuffle has at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def _pattern(p: P.Pattern | str) -> P.Pattern:
    return P.parse(p) if isinstance(p, str) else p


def _bound(p: P.Pattern, tensors: Sequence[Tensor]) -> list[Tensor]:
    """The tensors under the pattern's labels, with equal labels held to equal extents."""
    out = [t.relabel(o.labels) for o, t in zip(p.inputs, tensors, strict=True)]
    extents(p, out)
    return out


def extents(p: P.Pattern, tensors: Sequence[Tensor]) -> tuple[int | None, ...]:
    """Of the destination."""
    known: dict[str, int] = {}
    for t in tensors:
        for d, n in zip(t.dims, t.extents, strict=True):
            if n is not None and known.setdefault(d, n) != n:
                raise TensorError(f"label {d} has extents {known[d]} and {n}")
    return tuple(known.get(d) for d in p.dest.labels)


def _valued(t: Tensor, side: str, conj: bool) -> DataFrame:
    """The tensor with its value columns named for a side; conjugation changes the sign of im."""
    if not t.complex:
        return t.df.select(*map(c, t.dims), F.col("v").cast("double").alias(f"_{side}"))
    im = F.col("im").cast("double")
    return t.df.select(*map(c, t.dims), F.col("re").cast("double").alias(f"_{side}_re"), (-im if conj else im).alias(f"_{side}_im"))


def _product(left: Tensor, right: Tensor, factor: complex | float) -> list[Column]:
    """re and im, or v, of factor x left x right."""
    factor = complex(factor)
    if not (left.complex or right.complex or factor.imag):
        product = F.col("_l") * F.col("_r")
        return [(product if factor == 1 else product * F.lit(factor.real)).alias("v")]
    part = lambda t, s: (F.col(f"_{s}_re"), F.col(f"_{s}_im")) if t.complex else (F.col(f"_{s}"), None)
    (a, b), (x, y) = part(left, "l"), part(right, "r")
    zero = F.lit(0.0)
    re = a * x - (b * y if b is not None and y is not None else zero)
    im = (a * y if y is not None else zero) + (b * x if b is not None else zero)
    if factor == 1:
        return [re.alias("re"), im.alias("im")]
    return [(re * factor.real - im * factor.imag).alias("re"), (re * factor.imag + im * factor.real).alias("im")]


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], row_bytes: int = 64) -> DataFrame:
    """Equi-join on the shared labels; without any, a product that spreads over blocks of both sides.

    row_bytes: what a row holds at most, so that a side is broadcast only if BROADCAST_BYTES bound it.
    """
    if on:
        return left.join(right, list(on))
    most = max(1, BROADCAST_BYTES // row_bytes)
    if right.limit(most + 1).count() <= most:
        return left.crossJoin(F.broadcast(right))
    if left.limit(most + 1).count() <= most:
        return F.broadcast(left).crossJoin(right)
    # Neither side is small: n x n blocks for about as many tasks as a shuffle has, each row copied to the n blocks of its row or column.
    n = max(2, math.isqrt(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    spread = lambda df, here, there: df.withColumn(here, F.pmod(F.xxhash64(*map(c, df.columns)), F.lit(n)).cast("int")).withColumn(there, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return spread(left, "_i", "_j").join(spread(right, "_j", "_i"), ["_i", "_j"]).drop("_i", "_j")


def _dealt(t: Tensor, df: DataFrame, spread: Spread) -> DataFrame:
    """The rows of df, _valued of t, with their tasks and a row per coordinate."""
    return grouped(df, t.dims, spread).agg(*[F.sum(n).alias(n) for n in df.columns[t.rank :]]) if t.unsummed else spread.deal(df)


def contract(p: P.Pattern | str, left: Tensor, right: Tensor, into: Tensor | None = None, factor: complex | float = 1.0, accumulate: bool = True, restrict: Column | None = None, spread: Spread | None = None) -> Tensor:
    """into += factor x left x right, by labels; without `into`, or with accumulate=False, the product alone.

    restrict: a condition on the labels of both inputs, applied before anything is summed. A conjugated destination
    (`D+(...)`) toggles the conjugation of both inputs; the factor stays.

    spread: deals the inputs that have its labels, one at least, over its tasks; of its labels an input has all or none.
    """
    p = P.check_pair(_pattern(p))
    left, right = _bound(p, (left, right))
    kind = wider(left.kind, right.kind)
    if complex(factor * p.factor).imag:
        kind = "C" + kind[1]
    toggled = [o.conj != p.dest.conj for o in p.inputs]
    sides, on, own = [_valued(left, "l", toggled[0]), _valued(right, "r", toggled[1])], list(p.shared()), []
    has = [spread is not None and set(spread.labels) <= set(t.dims) for t in (left, right)]
    if spread is not None:
        if not any(has) or any(set(spread.labels) & set(t.dims) for t, x in zip((left, right), has) if not x):
            raise TensorError(f"an input has all labels of {spread.labels} or none, and one has them")
        sides, own = [_dealt(t, df, spread) if x else df for t, df, x in zip((left, right), sides, has)], ["_task"]
        on += own if all(has) else []
    both = joined(*sides, on)
    if restrict is not None:
        both = both.filter(restrict)
    product = both.select(*map(c, own), *map(c, p.dest.labels), *_product(left, right, factor * p.factor))
    summing = bool(p.contracted()) or any(t.unsummed and not x for t, x in zip((left, right), has))
    if summing and spread is not None:
        # sums within the tasks; coordinates that several tasks have are then dealt anew, unless they are few
        product = product.groupBy(*map(c, p.dest.labels), "_task").agg(*[F.sum(n).alias(n) for n in product.columns[1 + len(p.dest.labels) :]])
        summing = not set(spread.labels) <= set(p.dest.labels)
        known = extents(p, (left, right))
        if summing and (None in known or math.prod(known) > TASK_ROWS):
            product = product.repartition(spread.tasks, *map(c, p.dest.labels))
    if summing:
        product = summed([product], p.dest.labels, kind)
    else:
        names = ("re", "im") if kind[0] == "C" else ("v",)
        product = product.select(*map(c, p.dest.labels), *[F.col(n).cast(VALUE[kind]).alias(n) for n in names])
    out = Tensor(product, p.dest.labels, extents(p, (left, right)), kind, p.dest.name)
    if into is None or not accumulate or p.assign == "=":
        return out if into is None else out.relabel(into.dims).named(into.name)
    return add(out, into)


def add(t: Tensor, into: Tensor, factor: complex | float = 1.0, spread: Spread | None = None) -> Tensor:
    """into + factor x t, dimension by dimension: a union and one sum by coordinates."""
    from tensorweft.operators.elementwise import scale

    if t.rank != into.rank:
        raise TensorError(f"ranks {t.rank} and {into.rank}")
    for a, b in zip(t.extents, into.extents, strict=True):
        if a is not None and b is not None and a != b:
            raise TensorError(f"extents {t.extents} and {into.extents}")
    t = t.relabel(into.dims)
    t = t if factor == 1 else scale(t, factor)
    kind = wider(t.kind, into.kind)
    if kind[0] == "C":
        t, into = as_complex(t), as_complex(into)
    known = tuple(b if b is not None else a for a, b in zip(t.extents, into.extents, strict=True))
    if spread is None:
        total = summed([into.df, t.df], into.dims, kind)
    else:
        names = ("re", "im") if kind[0] == "C" else ("v",)
        total = grouped(into.df.unionByName(t.df), into.dims, spread).agg(*[F.sum(n).cast(VALUE[kind]).alias(n) for n in names]).drop("_task")
    return Tensor(total, into.dims, known, kind, into.name)


def add_pattern(p: P.Pattern | str, t: Tensor, into: Tensor | None = None, factor: complex | float = 1.0) -> Tensor:
    """D(a,b) += L(b,a) * factor: permutation by labels, conjugation by marks."""
    from tensorweft.operators.elementwise import conjugate, scale

    p = P.check_unary(_pattern(p))
    t = t.relabel(p.inputs[0].labels)
    if p.inputs[0].conj != p.dest.conj:
        t = conjugate(t)
    at = [t.dims.index(x) for x in p.dest.labels]
    t = Tensor(t.df.select(*map(c, p.dest.labels), *t.values), p.dest.labels, tuple(t.extents[i] for i in at), t.kind, p.dest.name, t.unsummed)
    if into is None or p.assign == "=":
        return t if factor * p.factor == 1 else scale(t, factor * p.factor)
    return add(t, into, factor * p.factor)


def inner(left: Tensor, right: Tensor, conj: bool = False) -> Tensor:
    """The scalar sum of left (conjugated, if asked for) x right over all coordinates."""
    labels = ",".join(f"x{i}" for i in range(left.rank))
    return contract(f"E()+=L{'+' if conj else ''}({labels})*R({labels})", left, right)


def matmul(left: Tensor, right: Tensor, rank: int, factor: complex | float = 1.0, into: Tensor | None = None, accumulate: bool = True) -> Tensor:
    """Positional product: the last dimensions of left with the first of right, as many as `rank` of the result leaves."""
    n = left.rank + right.rank - rank
    if n < 0 or n % 2 or n // 2 > min(left.rank, right.rank):
        raise TensorError(f"ranks {left.rank} and {right.rank} give no rank {rank}")
    n //= 2
    names = [f"x{i}" for i in range(left.rank + right.rank - n)]
    a, b = names[: left.rank], names[left.rank - n :]
    return contract(f"D({','.join(a[: left.rank - n] + b[n:])})+=L({','.join(a)})*R({','.join(b)})", left, right, into, factor, accumulate)


def custom(f: Callable[..., Column | tuple[Column, Column]], *tensors: Tensor, fills: bool = False, spread: Spread | None = None) -> Tensor:
    """T = f(values of all at a coordinate) for tensors of one shape; missing coordinates read as zero.

    Values are columns; if one of the tensors is complex, all are pairs of columns (re, im), and so is f's result. One
    union and one pass of sums line the values up, whatever the number of tensors. fills: f of zeros isn't zero, so
    coordinates that no tensor has need a row too.
    """
    first = tensors[0]
    if any(t.rank != first.rank for t in tensors):
        raise TensorError("custom operations take tensors of one rank")
    whole = any(t.complex for t in tensors)
    tensors = tuple(map(as_complex, tensors)) if whole else tensors
    if fills:
        tensors = (dense(tensors[0]), *tensors[1:])
    first = tensors[0]
    names = [f"_{j}_{v}" for j in range(len(tensors)) for v in first.values]
    parts = []
    for k, t in enumerate(tensors):
        t = t.relabel(first.dims)
        own = {f"_{k}_{v}": F.col(v).cast("double") for v in t.values}
        parts.append(t.df.select(*map(c, first.dims), *[own.get(n, F.lit(0.0)).alias(n) for n in names]))
    union = parts[0]
    for x in parts[1:]:
        union = union.unionByName(x)
    lined = grouped(union, first.dims, spread).agg(*[F.sum(n).alias(n) for n in names])
    values = [tuple(F.col(f"_{j}_{v}") for v in first.values) for j in range(len(tensors))]
    made = f(*(values if whole else [v[0] for v in values]))
    columns = [x.cast("double").alias(n) for x, n in zip(made if whole else (made,), first.values, strict=True)]
    return first.with_df(lined.select(*map(c, first.dims), *columns), kind="C8" if whole else "R8", unsummed=False)
