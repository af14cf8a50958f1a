"""Scalar functions: complex arithmetic, combinatorics and small helpers, as column expressions where data is columns."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- complex numbers as pairs of columns


def complex_multiply(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def complex_divide(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """Null where b is zero."""
    n = F.nullif(b[0] * b[0] + b[1] * b[1], F.lit(0.0))
    return (a[0] * b[0] + a[1] * b[1]) / n, (a[1] * b[0] - a[0] * b[1]) / n


def complex_add(a, b):
    return a[0] + b[0], a[1] + b[1]


def complex_subtract(a, b):
    return a[0] - b[0], a[1] - b[1]


def complex_conjugate(a):
    return a[0], -a[1]


def complex_abs(a) -> Column:
    return F.hypot(a[0], a[1])


def complex_sqrt(a: tuple[Column, Column]) -> tuple[Column, Column]:
    """The root with a real part that isn't negative."""
    r = F.hypot(a[0], a[1])
    im = F.sqrt((r - a[0]) / 2)
    return F.sqrt((r + a[0]) / 2), F.when(a[1] < 0, -im).otherwise(im)


# -- combinatorics


def factorial(n: Column | str) -> Column:
    """-1 for negative numbers; null beyond 20, where longs end."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n < 0, F.lit(-1).cast("bigint")).when(n <= 20, F.factorial(F.greatest(F.lit(0), F.least(n, F.lit(20))).cast("int")))


def binomial(n: Column | str, k: Column | str) -> Column:
    """Exact for results within 2^53; 0 outside of 0 <= k <= n."""
    n, k = (F.col(x) if isinstance(x, str) else x for x in (n, k))
    short = F.least(k, n - k)
    steps = F.when(short > 0, F.sequence(F.lit(1).cast("bigint"), short.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    # after step i the product is a binomial itself, so every division is exact
    value = F.aggregate(steps, F.lit(1).cast("bigint"), lambda acc, i: ((acc * (n - short + i)) / i).cast("bigint"))
    return F.when((k < 0) | (k > n), F.lit(0).cast("bigint")).otherwise(value)


def permutation_sign(p: Column | str) -> Column:
    """Of an array of distinct numbers: 1 or -1 by its inversions."""
    p = F.col(p) if isinstance(p, str) else p
    pairs = F.aggregate(
        F.transform(p, lambda x, i: F.size(F.filter(p, lambda y, j: (j > i) & (y < x)))), F.lit(0), lambda acc, x: acc + x
    )
    return F.when(pairs % 2 == 0, F.lit(1)).otherwise(F.lit(-1))


def inverse_permutation(p: Column | str) -> Column:
    """Of an array that holds 0 .. n - 1."""
    p = F.col(p) if isinstance(p, str) else p
    return F.transform(p, lambda _, i: (F.array_position(p, i) - 1).cast("int"))


def array_hash(a: Column | str) -> Column:
    return F.xxhash64(a)


def permutation_cycles(p: Sequence[int]) -> list[tuple[int, ...]]:
    seen, out = set(), []
    for start in range(len(p)):
        if start not in seen:
            cycle, at = [], start
            while at not in seen:
                seen.add(at)
                cycle.append(at)
                at = p[at]
            out.append(tuple(cycle))
    return out


def random_permutation(n: int, seed: int = 0) -> list[int]:
    out = list(range(n))
    random.Random(seed).shuffle(out)
    return out


def random_composition(n: int, parts: int, seed: int = 0) -> list[int]:
    """n as an ordered sum of `parts` numbers from 1 on."""
    cuts = sorted(random.Random(seed).sample(range(1, n), parts - 1))
    return [b - a for a, b in zip([0, *cuts], [*cuts, n])]


def cluster_points(values: Sequence[float], tolerance: float) -> list[list[float]]:
    """Points, in their order, in classes of close ones.

    A class starts with the first point that none has yet and takes, one after the other, the later ones whose mean
    distance from its points so far is below tolerance x the width of all points / their number.
    """
    limit = tolerance * (max(values) - min(values)) / len(values) if values else 0.0
    out, rest = [], list(values)
    while rest:
        group, left = [rest[0]], []
        for x in rest[1:]:
            (group if sum(abs(x - y) for y in group) / len(group) < limit else left).append(x)
        out.append(group)
        rest = left
    return out


def clusters(df, value: str, tolerance: float):
    """df with cluster (numbered from 0) and cluster_mean, as cluster_points has them of the sorted values; null and NaN have none.

    Among sorted points the mean distance is that from the mean, and a class once left is never met again.

    The scan is one of sorted distinct values. Where two neighbours are further apart than the limit a class ends
    whatever came before, so range partitions are cut at such gaps and scanned on their own, each as a stream.
    """
    from pyspark.sql import Window

    spark, x = df.sparkSession, F.col(value).cast("double")
    points = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("x").agg(F.count("*").alias("times"))
    n, low, high = points.agg(F.sum("times"), F.min("x"), F.max("x")).first()
    limit = tolerance * (high - low) / n if n else 0.0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = points.repartitionByRange(parts, "x").sortWithinPartitions("x")

    def first_gap(frames):
        last, found = None, None
        for frame in frames:
            for p in frame["x"].tolist() if found is None else ():
                if last is not None and p - last >= limit:
                    found = p
                    break
                last = p
        if found is not None:
            import pandas as pd

            yield pd.DataFrame({"x": [found]})

    cuts = sorted(r[0] for r in dealt.select("x").mapInPandas(first_gap, "x double").collect())  # one a partition at most
    run = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col("x")))
    runs = points.withColumn("run", run).repartition(parts, "run").sortWithinPartitions("run", "x")

    def scan(frames):
        now, total, held, number = None, 0.0, 0, 0
        for frame in frames:
            numbers = []
            for r, p, times in zip(frame["run"].tolist(), frame["x"].tolist(), frame["times"].tolist()):
                if r != now:
                    now, total, held, number = r, 0.0, 0, -1
                if not held or p - total / held >= limit:
                    total, held, number = 0.0, 0, number + 1
                total, held = total + p * times, held + times
                numbers.append(number)
            yield frame.assign(number=numbers)

    known = runs.mapInPandas(scan, "x double, times long, run int, number long")
    sizes = known.groupBy("run").agg((F.max("number") + 1).alias("many"))  # a row a run, at most one a partition and cut
    offsets = sizes.withColumn("before", F.coalesce(F.sum("many").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = known.join(offsets, "run").select("x", "times", (F.col("before") + F.col("number")).alias("cluster"))
    means = numbered.groupBy("cluster").agg((F.sum(F.col("x") * F.col("times")) / F.sum("times")).alias("cluster_mean"))
    return df.withColumn("_x", x).join(numbered.join(means, "cluster").select(F.col("x").alias("_x"), "cluster", "cluster_mean"), "_x", "left").drop("_x")
