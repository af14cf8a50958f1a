"""Views and parts of tensors: slices by description, blocks, direct sums, orders, and contractions in parts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorweft.operators.algebra import add, contract
from tensorweft.operators.elementwise import insert, slice_of
from tensorweft.operators.tensor import Tensor, TensorError, as_complex, c, modulus, settled, wider
from tensorweft.plans import pattern as P


@dataclass(frozen=True)
class SliceView:
    """A window of a tensor: nothing is read until tensor() is used."""

    base: Tensor
    offsets: tuple[int, ...]
    extents: tuple[int, ...]

    @property
    def volume(self) -> int:
        return prod(self.extents)

    def tensor(self) -> Tensor:
        return slice_of(self.base, self.offsets, self.extents)

    def write(self, part: Tensor, accumulate: bool = False) -> Tensor:
        """The base with part over (or onto) the window."""
        return insert(self.base, part, self.offsets, accumulate)


def whole(t: Tensor) -> SliceView:
    return SliceView(t, (0,) * t.rank, t.known())


def halves(view: SliceView) -> list[SliceView]:
    """Two parts along the longest dimension, the first the longer by one if it must be; a single element stays whole."""
    k = max(range(len(view.extents)), key=lambda i: view.extents[i], default=0)
    if not view.extents or view.extents[k] < 2:
        return [view]
    n = (view.extents[k] + 1) // 2
    first = (*view.extents[:k], n, *view.extents[k + 1 :])
    second = (*view.extents[:k], view.extents[k] - n, *view.extents[k + 1 :])
    return [SliceView(view.base, view.offsets, first), SliceView(view.base, (*view.offsets[:k], view.offsets[k] + n, *view.offsets[k + 1 :]), second)]


def subtensors(t: Tensor, most: int) -> list[SliceView]:
    """The tensor as views of at most `most` elements each."""
    todo, done = [whole(t)], []
    while todo:
        view = todo.pop()
        parts = halves(view) if view.volume > most else [view]
        (done if len(parts) == 1 else todo).extend(parts)
    return sorted(done, key=lambda v: v.offsets)


def direct_sum(t: Tensor, *parts: tuple[Sequence[int], Tensor]) -> Tensor:
    """t with parts (offsets, tensor) put side by side: a union, since they don't overlap each other or rows of t."""
    out, kind = t, t.kind
    for _, p in parts:
        kind = wider(kind, p.kind)
    out = as_complex(out) if kind[0] == "C" else out
    df = out.df
    for offsets, p in parts:
        p = (as_complex(p) if kind[0] == "C" else p).relabel(t.dims)
        df = df.unionByName(p.df.select(*[(c(d) + a).alias(d) for d, a in zip(t.dims, offsets)], *p.values))
    return out.with_df(df, kind=kind)


def block_keys(t: Tensor, sizes: Sequence[int], prefix: str = "b") -> DataFrame:
    """t's rows with their blocks' coordinates."""
    return t.df.select("*", *[F.call_function("div", c(d), F.lit(s).cast("bigint")).alias(f"{prefix}_{d}") for d, s in zip(t.dims, sizes, strict=True)])


def matching_blocks(p: P.Pattern | str, left: Tensor, right: Tensor, size: int) -> DataFrame:
    """Pairs of blocks of a contraction that both have rows: (blocks by label, n_left, n_right)."""
    p = P.check_pair(P.parse(p) if isinstance(p, str) else p)
    left, right = left.relabel(p.inputs[0].labels), right.relabel(p.inputs[1].labels)
    count = lambda t, n: block_keys(t, [size] * t.rank).groupBy(*[f"b_{d}" for d in t.dims]).agg(F.count("*").alias(n))
    return count(left, "n_left").join(count(right, "n_right"), [f"b_{x}" for x in p.shared()])


def split_operation(p: P.Pattern, sizes: dict[str, int]) -> tuple[str, int] | None:
    """The label to halve and its first half: the longest batch label, or else the longest of all; None for single elements."""
    batch = [x for x in p.batch() if sizes[x] > 1]
    labels = batch or [x for x in dict.fromkeys((*p.dest.labels, *p.contracted())) if sizes[x] > 1]
    if not labels:
        return None
    x = max(labels, key=lambda x: sizes[x])
    return x, (sizes[x] + 1) // 2


def operation_parts(p: P.Pattern, sizes: dict[str, int], most: int) -> dict[str, int]:
    """The operation as a grid of parts: an extent per label, with which no operand of a part has more than `most` elements."""
    extents = dict(sizes)
    while any(prod(extents[x] for x in o.labels) > most for o in (p.dest, *p.inputs)):
        split = split_operation(p, extents)
        if split is None:
            break
        extents[split[0]] = split[1]
    return extents


def contract_in_parts(p: P.Pattern | str, left: Tensor, right: Tensor, most: int, into: Tensor | None = None) -> Tensor:
    """The contraction part by part, each with at most `most` elements an operand.

    One plan whatever the number of parts: the parts' coordinates are labels beside the others, by which the rows meet
    and are summed; a last sum puts the parts together.
    """
    p = P.check_pair(P.parse(p) if isinstance(p, str) else p)
    left, right = left.relabel(p.inputs[0].labels), right.relabel(p.inputs[1].labels)
    sizes = dict(zip(left.dims + right.dims, left.known() + right.known()))
    if any(n == 0 for n in sizes.values()):
        raise TensorError("an extent is zero")
    part = operation_parts(p, sizes, most)
    block = lambda x: f"part_{x}"
    dealt = lambda t: Tensor(block_keys(t, [part[x] for x in t.dims], "part"), (*t.dims, *map(block, t.dims)), (*t.extents, *(-(-sizes[x] // part[x]) for x in t.dims)), t.kind, t.name, t.unsummed)
    labels = list(dict.fromkeys((*p.dest.labels, *p.contracted())))
    wider_ = lambda o, names: P.Operand(o.name, (*o.labels, *map(block, names)), o.conj)
    whole_ = P.Pattern(wider_(p.dest, labels), tuple(wider_(o, o.labels) for o in p.inputs), p.assign, p.factor)
    made = contract(whole_, dealt(left), dealt(right))
    total = made.df.groupBy(*map(c, p.dest.labels)).agg(*[F.sum(v).alias(v) for v in made.values])
    out = Tensor(total, p.dest.labels, tuple(sizes[x] for x in p.dest.labels), made.kind, p.dest.name)
    return add(out, into) if into is not None else out


def compare_indices(a: str, b: str):
    """Of two columns of coordinates (arrays): -1, 0 or 1 by the first that differs, else by their number."""
    return F.when(F.col(a) < F.col(b), -1).when(F.col(a) == F.col(b), 0).otherwise(1)


def merged(a: Tensor, b: Tensor) -> DataFrame:
    """The rows of both by coordinates, of equal ones a's first, with where they come from (0, 1)."""
    both = a.df.withColumn("source", F.lit(0)).unionByName(b.relabel(a.dims).df.withColumn("source", F.lit(1)))
    return both.orderBy(*map(c, a.dims), "source")


def ordered(t: Tensor, *dims: str) -> DataFrame:
    """Rows by coordinates, the dims given first."""
    rest = [d for d in t.dims if d not in dims]
    return t.df.orderBy(*map(c, (*dims, *rest)))


def top(t: Tensor, k: int) -> DataFrame:
    """The k elements of the largest moduli, of equals those with the smaller coordinates."""
    return settled(t).df.orderBy(modulus(t).desc(), *map(c, t.dims)).limit(k)


def strong_dimensions(extents: Sequence[int], strength: Callable[[int, int], float] | None = None, threshold: float = 0.0) -> list[int]:
    """Dimensions worth splitting, by a strength of position and extent (default the extent): those above the threshold."""
    strength = strength or (lambda _, n: float(n))
    return [i for i, n in enumerate(extents) if strength(i, n) > threshold]
