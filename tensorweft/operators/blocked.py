"""Dense blocks: tensors as rows of sub-blocks, contracted with one matrix product a pair of blocks.

A coordinate table spends a row on every multiplication of a contraction; for dense tensors a block spends a row on
size^3 of them. Blocks of both inputs meet by the block coordinates of the shared labels, their products are summed by
the destination's block coordinates, as whole blocks within a task first. A block has about BLOCK elements a side, so
a task holds two of them and HELD sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorweft.operators.tensor import Tensor, TensorError, c
from tensorweft.plans import pattern as P

#: Elements of a matrix side of a block.
BLOCK = 256
#: Result blocks that a task sums up before it hands them on.
HELD = 64


def block_size(extent: int, rank: int, block: int = BLOCK) -> int:
    """Extent of a block's dimension, such that `rank` of them make a side of about `block`."""
    return max(1, min(extent, round(block ** (1 / max(1, rank)))))


def to_blocks(t: Tensor, sizes: Sequence[int]) -> DataFrame:
    """(b0, ..., positions, values): a row for each block with nonzero elements, elements by their place in it."""
    place, step = F.lit(0).cast("bigint"), 1
    for d, s in zip(t.dims, sizes, strict=True):
        place = place + F.pmod(c(d), F.lit(s)) * step
        step *= s
    cells = t.df.select(*[F.floor(c(d) / s).cast("bigint").alias(f"b{i}") for i, (d, s) in enumerate(zip(t.dims, sizes))], F.struct(place.alias("p"), F.col("v").cast("double").alias("v")).alias("e"))
    keys = [f"b{i}" for i in range(t.rank)]
    grouped = cells.groupBy(*keys).agg(F.collect_list("e").alias("e"))
    return grouped.select(*keys, F.col("e.p").alias("positions"), F.col("e.v").alias("values"))


def from_blocks(blocks: DataFrame, dims: Sequence[str], extents: Sequence[int | None], sizes: Sequence[int], name: str = "T") -> Tensor:
    cells = blocks.select(*[f"b{i}" for i in range(len(dims))], F.explode(F.arrays_zip("positions", "values")).alias("e"))
    at, columns = F.col("e.positions"), []
    for i, (d, s) in enumerate(zip(dims, sizes, strict=True)):
        columns.append((F.col(f"b{i}") * s + F.pmod(at, F.lit(s))).cast("bigint").alias(d))
        at = F.floor(at / s)
    return Tensor(cells.select(*columns, F.col("e.values").alias("v")), tuple(dims), tuple(extents), "R8", name)


def contract_blocked(p: P.Pattern | str, left: Tensor, right: Tensor, block: int = BLOCK) -> Tensor:
    """A pairwise contraction of real tensors without batch labels, by blocks."""
    from tensorweft.operators.algebra import extents

    p = P.check_pair(P.parse(p) if isinstance(p, str) else p)
    if p.batch() or left.complex or right.complex:
        raise TensorError("blocked contractions take real tensors without batch labels")
    left, right = left.relabel(p.inputs[0].labels), right.relabel(p.inputs[1].labels)
    known = dict(zip(left.dims + right.dims, left.known() + right.known()))
    summed_labels = list(p.contracted())
    rows, columns = [x for x in left.dims if x not in summed_labels], [x for x in right.dims if x not in summed_labels]
    size = {x: block_size(known[x], len(g), block) for g in (rows, columns, summed_labels) for x in g}
    a = to_blocks(left, [size[x] for x in left.dims])
    b = to_blocks(right, [size[x] for x in right.dims])
    a = a.select(*[F.col(f"b{i}").alias(f"k_{x}" if x in summed_labels else f"o_{x}") for i, x in enumerate(left.dims)], F.col("positions").alias("lp"), F.col("values").alias("lv"))
    b = b.select(*[F.col(f"b{i}").alias(f"k_{x}" if x in summed_labels else f"o_{x}") for i, x in enumerate(right.dims)], F.col("positions").alias("rp"), F.col("values").alias("rv"))
    on = [f"k_{x}" for x in summed_labels]
    from tensorweft.operators.algebra import joined

    # a row is a block: a position and a value for each of its elements
    met = joined(a, b, on, 16 * max(math.prod(size[x] for x in t.dims) for t in (left, right)))
    out_keys = [f"o_{x}" for x in p.dest.labels]
    shapes = ([size[x] for x in left.dims], [size[x] for x in right.dims], [size[x] for x in p.dest.labels])
    orders = ([left.dims.index(x) for x in rows + summed_labels], [right.dims.index(x) for x in summed_labels + columns], [(rows + columns).index(x) for x in p.dest.labels])
    sides = [[size[x] for x in g] for g in (rows, columns, summed_labels)]

    def product(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        nr, nc, nk = (int(np.prod(s)) if s else 1 for s in sides)

        def matrix(positions, values, shape, order, n, m):
            body = np.bincount(np.asarray(positions, np.int64), np.asarray(values, float), int(np.prod(shape)) if shape else 1)
            body = body.reshape(shape, order="F") if shape else body
            return body.transpose(order).reshape(n, m) if shape else body.reshape(n, m)

        held: dict[tuple, np.ndarray] = {}

        def flush():
            rows = [(*key, at.tolist(), z[at].tolist()) for key, z in held.items() for at in (np.flatnonzero(z),)]
            held.clear()
            return pd.DataFrame(rows, columns=[*out_keys, "positions", "values"])

        for part in parts:
            for r in part.itertuples(index=False):
                x = matrix(r.lp, r.lv, shapes[0], orders[0], nr, nk)
                y = matrix(r.rp, r.rv, shapes[1], orders[1], nk, nc)
                z = (x @ y).reshape(sides[0] + sides[1]).transpose(orders[2]) if shapes[2] else (x @ y).reshape(1)
                key, z = tuple(getattr(r, k) for k in out_keys), z.reshape(-1, order="F")
                if key in held:
                    held[key] += z
                else:
                    if len(held) >= HELD:
                        yield flush()
                    held[key] = z.copy()
        yield flush()

    schema = ", ".join([f"{k} bigint" for k in out_keys] + ["positions array<bigint>", "values array<double>"])
    parts = met.select(*out_keys, "lp", "lv", "rp", "rv").mapInPandas(product, schema)
    parts = parts.select(*[F.col(k).alias(f"b{i}") for i, k in enumerate(out_keys)], "positions", "values")
    cells = from_blocks(parts, p.dest.labels, extents(p, (left, right)), shapes[2], p.dest.name)
    from tensorweft.operators.tensor import summed

    return cells.with_df(summed([cells.df], p.dest.labels, "R8"))
