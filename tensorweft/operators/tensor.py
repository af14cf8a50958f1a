"""Tensors as DataFrames: a bigint column per dimension and a value, `v` or `re` and `im`.

A row per coordinate at most; a coordinate without a row is zero. Dimensions have extents (their coordinates run from 0)
and names, the columns' names. Element kinds are R4, R8 (real) and C4, C8 (complex).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("R4", "R8", "C4", "C8")
VALUE = {"R4": "float", "R8": "double", "C4": "float", "C8": "double"}


class TensorError(ValueError):
    pass


def c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Tensor:
    """df has the columns dims and the values'. nonzero rows suffice; extents may be None where they aren't known."""

    df: DataFrame
    dims: tuple[str, ...]
    extents: tuple[int | None, ...]
    kind: str = "R8"
    name: str = "T"
    #: Rows of one coordinate may repeat and count as their sum (see from_table); operations that need one row sum first.
    unsummed: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise TensorError(f"no such kind: {self.kind}")
        if len(self.dims) != len(self.extents) or len(set(self.dims)) != len(self.dims):
            raise TensorError("dimensions need a name and an extent each, and different names")
        if {"v", "re", "im"} & {d.lower() for d in self.dims}:
            raise TensorError("v, re and im are the values' columns, not names of dimensions")

    # -- metadata

    @property
    def rank(self) -> int:
        return len(self.dims)

    @property
    def shape(self) -> tuple[int | None, ...]:
        return self.extents

    @property
    def volume(self) -> int | None:
        return None if None in self.extents else prod(self.extents)

    @property
    def complex(self) -> bool:
        return self.kind[0] == "C"

    @property
    def values(self) -> tuple[str, ...]:
        return ("re", "im") if self.complex else ("v",)

    @property
    def bytes(self) -> int | None:
        """Of a dense body."""
        return None if self.volume is None else self.volume * {"R4": 4, "R8": 8, "C4": 8, "C8": 16}[self.kind]

    @property
    def empty(self) -> bool:
        return self.df.isEmpty()

    def with_df(self, df: DataFrame, **changes) -> Tensor:
        return Tensor(df, changes.get("dims", self.dims), changes.get("extents", self.extents), changes.get("kind", self.kind), changes.get("name", self.name), changes.get("unsummed", self.unsummed))

    def named(self, name: str) -> Tensor:
        return self.with_df(self.df, name=name)

    def relabel(self, dims: Sequence[str]) -> Tensor:
        """The same tensor with other dimension names."""
        if len(dims) != self.rank:
            raise TensorError(f"{self.name} has rank {self.rank}, not {len(dims)}")
        df = self.df.select(*[c(a).alias(b) for a, b in zip(self.dims, dims, strict=True)], *self.values)
        return self.with_df(df, dims=tuple(dims))

    def known(self) -> tuple[int, ...]:
        if None in self.extents:
            raise TensorError(f"{self.name} needs known extents here")
        return self.extents  # type: ignore[return-value]

    # -- sources

    @staticmethod
    def zeros(spark: SparkSession, dims: Sequence[str], extents: Sequence[int | None], kind: str = "R8", name: str = "T") -> Tensor:
        value = VALUE[kind]
        parts = [f"`{d}` bigint" for d in dims] + ([f"re {value}", f"im {value}"] if kind[0] == "C" else [f"v {value}"])
        return Tensor(spark.createDataFrame([], ", ".join(parts)), tuple(dims), tuple(extents), kind, name)

    @staticmethod
    def scalar(spark: SparkSession, value: complex | float = 0.0, kind: str = "R8", name: str = "T") -> Tensor:
        return full(spark, (), (), value, kind, name)

    @staticmethod
    def from_table(df: DataFrame, coordinates: dict[str, Column | str], value: Column | str | tuple = 1.0, extents: Sequence[int | None] | None = None, kind: str = "R8", name: str = "T", sums: bool = True) -> Tensor:
        """Coordinates and values from columns; rows of one coordinate are summed, and rows with a null are dropped.

        sums=False leaves the rows as they are, which saves a shuffle: for coordinates that repeat little or not at all.
        Linear operations take such a tensor as it is, since its rows add up; others sum it when they need to.
        """
        col = lambda x: F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
        values = value if isinstance(value, tuple) else (value,)
        names = ("re", "im") if kind[0] == "C" else ("v",)
        if len(values) != len(names):
            values = (*values, 0.0)
        picked = df.select(*[col(x).cast("bigint").alias(d) for d, x in coordinates.items()], *[col(x).cast("double").alias(n) for n, x in zip(names, values, strict=True)])
        for name in picked.columns:  # not dropna, which takes NaN for null
            picked = picked.filter(c(name).isNotNull())
        dims = tuple(coordinates)
        if dims and not sums:
            out = picked.select(*map(c, dims), *[F.col(n).cast(VALUE[kind]).alias(n) for n in names])
            return Tensor(out, dims, tuple(extents) if extents is not None else (None,) * len(dims), kind, name, True)
        summed = picked.groupBy(*map(c, dims)).agg(*[F.sum(n).alias(n) for n in names])
        if not dims:
            summed = summed.select(*[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
        out = summed.select(*map(c, dims), *[F.col(n).cast(VALUE[kind]).alias(n) for n in names])
        return Tensor(out, dims, tuple(extents) if extents is not None else (None,) * len(dims), kind, name)

    @staticmethod
    def from_array_column(df: DataFrame, coordinates: dict[str, Column | str], array: Column | str, dim: str, extent: int | None = None, extents: Sequence[int | None] | None = None, name: str = "T") -> Tensor:
        """An array column as one more dimension: its positions."""
        col = lambda x: F.col(x) if isinstance(x, str) else x
        wide = df.select(*[col(x).cast("bigint").alias(d) for d, x in coordinates.items()], F.posexplode(col(array)).alias(dim, "v"))
        outer = tuple(extents) if extents is not None else (None,) * len(coordinates)
        return Tensor.from_table(wide, {**{d: c(d) for d in coordinates}, dim: c(dim)}, F.col("v"), (*outer, extent), name=name)

    @staticmethod
    def from_flat(df: DataFrame, position: str, value: str | tuple[str, str], dims: Sequence[str], extents: Sequence[int], kind: str = "R8", name: str = "T") -> Tensor:
        """A body as a table of positions and values, the first dimension running fastest."""
        coordinates, rest = {}, F.col(position).cast("bigint")
        for d, n in zip(dims, extents, strict=True):
            coordinates[d] = F.pmod(rest, F.lit(n))
            rest = F.call_function("div", rest, F.lit(n).cast("bigint"))
        return Tensor.from_table(df, coordinates, value, extents, kind, name)

    @staticmethod
    def from_numpy(spark: SparkSession, array, dims: Sequence[str], name: str = "T") -> Tensor:
        """A local array, through Arrow; its nonzero elements become rows."""
        import numpy as np
        import pyarrow as pa

        array = np.asarray(array)
        whole = np.iscomplexobj(array)
        kind = "C8" if whole else "R8"
        at = np.nonzero(array) if array.ndim else ()
        found = array[at] if array.ndim else array.reshape(1)
        columns = {d: x.astype(np.int64) for d, x in zip(dims, at, strict=True)}
        columns |= {"re": found.real.astype(float), "im": found.imag.astype(float)} if whole else {"v": found.astype(float)}
        return Tensor(spark.createDataFrame(pa.table({n: pa.array(np.ascontiguousarray(x)) for n, x in columns.items()})), tuple(dims), array.shape, kind, name)

    # -- reads

    def to_numpy(self):
        """The dense body on the driver: for small tensors and slices."""
        import numpy as np

        rows = self.df.select(*map(c, self.dims), *self.values).toArrow()
        get = lambda n: rows.column(n).to_numpy()
        out = np.zeros(self.known(), complex if self.complex else float)
        at = np.ravel_multi_index(tuple(map(get, self.dims)), self.known()) if self.rank else np.zeros(len(rows), np.int64)
        np.add.at(out.reshape(-1), at, get("re") + 1j * get("im") if self.complex else get("v"))
        return out

    def get_scalar(self) -> complex | float:
        """Of a tensor of rank 0; no row reads as zero."""
        if self.rank:
            raise TensorError(f"{self.name} has rank {self.rank}, not 0")
        row = self.df.first()
        if self.complex:
            return complex(row["re"] or 0.0, row["im"] or 0.0) if row else 0j
        return (row["v"] or 0.0) if row else 0.0

    def show(self, threshold: float = 1e-13) -> DataFrame:
        """Elements with a modulus above threshold, ordered by coordinates."""
        rows = settled(self).df.filter(modulus(self) > threshold)
        return rows.orderBy(*map(c, self.dims)) if self.rank else rows


def settled(t: Tensor) -> Tensor:
    """The same tensor with a row per coordinate."""
    return t.with_df(summed([t.df], t.dims, t.kind), unsummed=False) if t.unsummed else t


def modulus(t: Tensor) -> Column:
    return F.hypot(F.col("re").cast("double"), F.col("im").cast("double")) if t.complex else F.abs(F.col("v").cast("double"))


def literal(value: complex | float, kind: str) -> list[Column]:
    if kind[0] == "C":
        value = complex(value)
        return [F.lit(value.real).cast(VALUE[kind]).alias("re"), F.lit(value.imag).cast(VALUE[kind]).alias("im")]
    if isinstance(value, complex) and value.imag:
        raise TensorError(f"a complex value for kind {kind}")
    return [F.lit(float(value.real if isinstance(value, complex) else value)).cast(VALUE[kind]).alias("v")]


def grid(spark: SparkSession, dims: Sequence[str], extents: Sequence[int], name: str = "n") -> DataFrame:
    """All coordinates, made from one range of the volume: spread over the executors, without joins."""
    rest, out = F.col(name), []
    for d, n in zip(dims, extents, strict=True):
        out.append(F.pmod(rest, F.lit(n)).cast("bigint").alias(d))
        rest = F.call_function("div", rest, F.lit(n).cast("bigint"))
    return spark.range(prod(extents)).toDF(name).select(*out)


def full(spark: SparkSession, dims: Sequence[str], extents: Sequence[int], value: complex | float, kind: str = "R8", name: str = "T") -> Tensor:
    return Tensor(grid(spark, dims, extents).select(*map(c, dims), *literal(value, kind)), tuple(dims), tuple(extents), kind, name)


def random(spark: SparkSession, dims: Sequence[str], extents: Sequence[int], seed: int = 0, kind: str = "R8", name: str = "T") -> Tensor:
    """Uniform in [0, 1) per component, drawn from hashes of seed and coordinates: the same on any partitioning."""
    draw = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), *map(c, dims)), 11) * F.lit(2.0**-53)).cast(VALUE[kind])
    values = [draw(0).alias("re"), draw(1).alias("im")] if kind[0] == "C" else [draw(0).alias("v")]
    return Tensor(grid(spark, dims, extents).select(*map(c, dims), *values), tuple(dims), tuple(extents), kind, name)


def from_function(spark: SparkSession, dims: Sequence[str], extents: Sequence[int], f: Callable[..., Column | tuple[Column, Column]], kind: str = "R8", name: str = "T") -> Tensor:
    """f gets a column per coordinate and gives the value's column, or two for complex kinds."""
    made = f(*map(c, dims))
    made = made if isinstance(made, tuple) else (made,)
    names = ("re", "im") if kind[0] == "C" else ("v",)
    return Tensor(grid(spark, dims, extents).select(*map(c, dims), *[m.cast(VALUE[kind]).alias(n) for m, n in zip(made, names, strict=True)]), tuple(dims), tuple(extents), kind, name)


def dense(t: Tensor) -> Tensor:
    """A row for every coordinate: needed before functions that don't keep zero."""
    if not t.rank:
        one = t.df.sparkSession.range(1).select(*literal(0.0, t.kind))
        total = t.df.unionByName(one).agg(*[F.sum(v).cast(VALUE[t.kind]).alias(v) for v in t.values])
        return t.with_df(total)
    zero = grid(t.df.sparkSession, t.dims, t.known()).select(*map(c, t.dims), *literal(0.0, t.kind))
    both = t.df.unionByName(zero).groupBy(*map(c, t.dims)).agg(*[F.sum(v).cast(VALUE[t.kind]).alias(v) for v in t.values])
    return t.with_df(both, unsummed=False)


def wider(a: str, b: str) -> str:
    return ("C" if "C" in (a[0], b[0]) else "R") + ("8" if "8" in (a[1], b[1]) else "4")


def as_complex(t: Tensor) -> Tensor:
    if t.complex:
        return t
    df = t.df.select(*map(c, t.dims), F.col("v").alias("re"), F.lit(0.0).cast(VALUE[t.kind]).alias("im"))
    return t.with_df(df, kind="C" + t.kind[1])


def summed(parts: Sequence[DataFrame], dims: Sequence[str], kind: str) -> DataFrame:
    names = ("re", "im") if kind[0] == "C" else ("v",)
    whole = reduce(DataFrame.unionByName, parts)
    out = whole.groupBy(*map(c, dims)).agg(*[F.sum(n).cast(VALUE[kind]).alias(n) for n in names])
    return out if dims else out.select(*[F.coalesce(n, F.lit(0.0).cast(VALUE[kind])).alias(n) for n in names])
