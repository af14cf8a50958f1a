"""Reductions. Extrema are by modulus; the 2-norm is the squared one unless its root is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorweft.operators.algebra import Spread, grouped
from tensorweft.operators.tensor import Tensor, c, modulus, settled

ABSOLUTE, RELATIVE = 1e-13, 1e-2


def _one(t: Tensor, value: Column, name: str) -> DataFrame:
    return settled(t).df.agg(value.alias(name))


def norm1(t: Tensor) -> DataFrame:
    """(norm1): the sum of moduli."""
    return _one(t, F.coalesce(F.sum(modulus(t)), F.lit(0.0)), "norm1")


def squared(t: Tensor) -> Column:
    if t.complex:
        re, im = F.col("re").cast("double"), F.col("im").cast("double")
        return re * re + im * im
    return F.col("v").cast("double") * F.col("v").cast("double")


def norm2(t: Tensor, root: bool = False) -> DataFrame:
    """(norm2): the sum of squared moduli, or its root."""
    total = F.coalesce(F.sum(squared(t)), F.lit(0.0))
    return _one(t, F.sqrt(total) if root else total, "norm2")


def max_abs(t: Tensor) -> DataFrame:
    """(max_abs)"""
    return _one(t, F.coalesce(F.max(modulus(t)), F.lit(0.0)), "max_abs")


def min_abs(t: Tensor) -> DataFrame:
    """(min_abs): zero if some coordinate has no row."""
    least = F.when(F.count("*") < F.lit(t.volume if t.volume is not None else 1 << 62), F.lit(0.0)).otherwise(F.min(modulus(t)))
    return _one(t, least, "min_abs")


def argmax(t: Tensor) -> DataFrame:
    """The element of the largest modulus with its coordinates; of equals the one with the smallest coordinates."""
    place = F.struct((-modulus(t)).alias("m"), *map(c, t.dims), *[F.col(v) for v in t.values])
    best = settled(t).df.agg(F.min(place).alias("b")).filter("b IS NOT NULL")
    return best.select(*[F.col(f"b.`{d}`").alias(d) for d in t.dims], *[F.col(f"b.{v}").alias(v) for v in t.values])


def has_nan(t: Tensor) -> DataFrame:
    """(has_nan)"""
    bad = F.lit(False)
    for v in t.values:
        bad = bad | F.isnan(v)
    return _one(t, F.coalesce(F.max(bad), F.lit(False)), "has_nan")


def compare(a: Tensor, b: Tensor, relative: bool = False, threshold: float | None = None, spread: Spread | None = None) -> DataFrame:
    """(diff_count): coordinates where the two differ.

    Elements differ if the modulus of their difference is above the threshold (1e-13), or, compared relatively, above the
    threshold (1e-2) times the larger modulus. A coordinate that one lacks is zero there. NaN differs from nothing.
    """
    b = b.relabel(a.dims)
    threshold = (RELATIVE if relative else ABSOLUTE) if threshold is None else threshold
    names = a.values if a.complex == b.complex else ("re", "im")
    part = lambda t, s: t.df.select(*map(c, a.dims), *[(F.col(v) if v in t.values else F.col("v") if v == "re" else F.lit(0.0)).cast("double").alias(f"{s}_{v}") for v in names], *[F.lit(0.0).alias(f"{'b' if s == 'a' else 'a'}_{v}") for v in names])
    lined = grouped(part(a, "a").unionByName(part(b, "b")), a.dims, spread).agg(*[F.sum(f"{s}_{v}").alias(f"{s}_{v}") for s in "ab" for v in names])
    size = lambda s: F.hypot(f"{s}_re", f"{s}_im") if len(names) == 2 else F.abs(f"{s}_v")
    gap = F.hypot(F.col("a_re") - F.col("b_re"), F.col("a_im") - F.col("b_im")) if len(names) == 2 else F.abs(F.col("a_v") - F.col("b_v"))
    differs = ~F.isnan(gap) & (gap > (threshold * F.greatest(size("a"), size("b")) if relative else F.lit(threshold)))
    return lined.agg(F.coalesce(F.sum(differs.cast("long")), F.lit(0)).alias("diff_count"))
