"""Singular value decompositions of tensors: D(a,b,...) = L(..,k,..) S(k) R(k,..).

The pattern's labels that only the factors have are the inner ones; the destination's labels of L make the rows of a
matrix and those of R its columns. The matrix, taller side down, is cut into blocks of rows; each block's triangular
factor stands for it, triangular factors are stacked and factorised again, FAN at a time, until one is left (a tree of QR
factorisations, which keeps the precision that squaring the matrix would halve). That factor, of the size of the smaller
side, is decomposed on the driver; the long side's vectors are one more contraction. The smaller side has SIDE elements
at most.

Signs and phases are free, as in any such decomposition; products of the factors aren't. Values below the rounding errors
of the largest (its product with the longer extent and the machine's epsilon) are zero, and so is what goes with them.

tasks: number of tasks over which the long side's rows are dealt (see algebra.Spread), blocks in turn; without it, shuffles
have as many as the session says.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import functions as F

from tensorweft.operators.algebra import Spread, contract
from tensorweft.operators.elementwise import fold, permute, unfold
from tensorweft.operators.tensor import Tensor, TensorError, as_complex, c, settled
from tensorweft.plans import pattern as P

#: Longest smaller side: a triangular factor of 4096 x 4096 is 128 MB (complex: 256 MB).
SIDE = 4096
#: Elements of a block of rows, or rows as many as columns; factors that are stacked at a time.
BLOCK, FAN = 1 << 20, 8


def _sides(p: P.Pattern | str) -> tuple[P.Pattern, list[str], list[str], list[str]]:
    p = P.parse(p) if isinstance(p, str) else p
    if len(p.inputs) != 2 or any(o.repeated for o in p.inputs):
        raise P.PatternError("a decomposition has two factors, each without repeated labels")
    left, right = p.inputs
    inner = [x for x in left.labels if x in right.labels]
    if not inner or any(x in p.dest.labels for x in inner):
        raise P.PatternError("the labels that the factors share must be theirs alone, and one at least")
    rows, columns = [x for x in left.labels if x not in inner], [x for x in right.labels if x not in inner]
    if sorted(rows + columns) != sorted(p.dest.labels):
        raise P.PatternError("every label of the destination must be in one factor")
    return p, rows, columns, inner


def _matrix(t: Tensor, rows: list[str], columns: list[str]) -> Tensor:
    """(i, j) with rows and columns folded, first fastest."""
    t = permute(t, rows + columns)
    for names, into in ((rows, "_i"), (columns, "_j")):
        t = fold(t, names, into) if len(names) > 1 else t.relabel([into if d == names[0] else d for d in t.dims]) if names else t
    for into, names in (("_i", rows), ("_j", columns)):
        if not names:
            t = Tensor(t.df.select(F.lit(0).cast("bigint").alias(into), *map(c, t.dims), *t.values), (into, *t.dims), (1, *t.extents), t.kind, t.name)
    return permute(t, ["_i", "_j"])


def triangular(a: Tensor, wide: bool, long: int, short: int, tasks: int | None = None):
    """The triangular factor R of A = Q R, or of A^H = Q R if the matrix A(_i,_j) is wide: short x short, as an array."""
    import numpy as np

    down, across = ("_j", "_i") if wide else ("_i", "_j")
    height, whole = max(short, BLOCK // max(1, short)), a.complex
    kind = np.complex128 if whole else np.float64
    blocks = -(-long // height)
    parts = [F.col(x).cast("double").alias(x) for x in (("re", "im") if whole else ("v",))]
    placed = lambda df: df.select(F.floor(c(down) / height).cast("long").alias("block"), F.pmod(c(down), F.lit(height)).alias("x"), c(across).alias("y"), *parts)
    if tasks is None:
        rows, keys = placed(settled(a).df), ["block"]
    else:
        n, keys = max(1, min(blocks, tasks)), ["_task", "block"]
        rows = placed(a.df).withColumn("_task", F.pmod("block", F.lit(n)).cast("int")).repartitionById(n, F.col("_task"))
        if a.unsummed:
            rows = rows.groupBy(*keys, "x", "y").agg(*[F.sum(x).alias(x) for x in (("re", "im") if whole else ("v",))])

    def factor(m) -> bytes:
        r = np.linalg.qr(m, mode="r")
        return np.vstack([r, np.zeros((short - len(r), short), kind)]).astype(kind).tobytes() if len(r) < short else r.astype(kind).tobytes()

    def first(frame):
        import pandas as pd

        m = np.zeros((height, short), kind)
        m[frame["x"], frame["y"]] = frame["re"] + (-1j if wide else 1j) * frame["im"] if whole else frame["v"]
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "r": [factor(m[m.any(axis=1)])]})

    def more(frame):
        import pandas as pd

        m = np.vstack([np.frombuffer(x, kind).reshape(short, short) for x in frame["r"]])
        return pd.DataFrame({"block": [int(frame["block"].iloc[0]) // FAN], "r": [factor(m)]})

    factors = rows.groupBy(*keys).applyInPandas(first, "block long, r binary")
    while blocks > 1:
        factors = factors.groupBy(F.floor(F.col("block") / FAN)).applyInPandas(more, "block long, r binary")
        blocks = -(-blocks // FAN)
    found = factors.collect()
    return np.frombuffer(found[0]["r"], kind).reshape(short, short).copy() if found else np.zeros((short, short), kind)


def svd(p: P.Pattern | str, t: Tensor, k: int | None = None, inner_extents: tuple[int, ...] | None = None, absorb: str = "none", tasks: int | None = None) -> tuple[Tensor, Tensor, Tensor]:
    """(L, S, R) under the pattern's labels; S has the inner labels. k: how many values stay (default all).

    absorb: "left", "right" or "both" (its root to each) puts S into the factors. Inner labels beyond the first are
    unfolded to inner_extents, whose product is then k.
    """
    import numpy as np

    p, rows, columns, inner = _sides(p)
    t = t.relabel(p.dest.labels)
    m, n = prod(t.known()[t.dims.index(x)] for x in rows), prod(t.known()[t.dims.index(x)] for x in columns)
    small = min(m, n)
    if small > SIDE:
        raise TensorError(f"the smaller side has {small} elements, more than {SIDE}")
    k = small if k is None else min(k, small)
    if inner_extents is None:
        inner_extents = (k,) if len(inner) == 1 else None
    if inner_extents is None or prod(inner_extents) != k:
        raise TensorError(f"extents of {inner} with a product of {k} are needed")
    spark, whole = t.df.sparkSession, t.complex
    a = _matrix(t, rows, columns)
    wide = m <= n
    _, values, turned = np.linalg.svd(triangular(a, wide, max(m, n), small, tasks))
    s, vectors = values[:k], turned.conj().T[:, :k]
    live = s > np.finfo(float).eps * max(m, n) * (s[0] if len(s) else 0.0)
    s, vectors = np.where(live, s, 0.0), vectors * live
    inverse = np.where(live, 1.0 / np.where(live, s, 1.0), 0.0)
    own = Tensor.from_numpy(spark, vectors, ("_i" if wide else "_j", "_k"), "L")
    own = as_complex(own) if whole else own
    scaled = Tensor.from_numpy(spark, vectors * inverse, ("_i" if wide else "_j", "_k"), "L")
    scaled = as_complex(scaled) if whole else scaled
    # A = U S V^H: V^H = (1/S) U^H A, or U = A V (1/S)
    spread = None if tasks is None else Spread(("j" if wide else "i",), tasks)
    if wide:
        left, right = own, contract("R(k,j)+=U+(i,k)*A(i,j)", scaled, a, spread=spread)
    else:
        left, right = contract("L(i,k)+=A(i,j)*V(j,k)", a, scaled, spread=spread), permute(_conj(own), ["_k", "_j"])
    left, right = left.relabel(["_i", "_k"]), right.relabel(["_k", "_j"])
    power = {"none": (0.0, 0.0), "left": (1.0, 0.0), "right": (0.0, 1.0), "both": (0.5, 0.5)}[absorb]
    for side, x in enumerate(power):
        if x:
            d = Tensor.from_numpy(spark, s**x, ("_k",), "S")
            if side == 0:
                left = contract("D(i,k)+=L(i,k)*S(k)", left, d).relabel(["_i", "_k"])
            else:
                right = contract("D(k,j)+=R(k,j)*S(k)", right, d).relabel(["_k", "_j"])
    extent = {x: t.known()[t.dims.index(x)] for x in rows + columns}
    left = _restored(left, "_i", rows, extent, inner, inner_extents, p.inputs[0].labels).named(p.inputs[0].name)
    right = _restored(right, "_j", columns, extent, inner, inner_extents, p.inputs[1].labels).named(p.inputs[1].name)
    middle = Tensor.from_numpy(spark, s, ("_k",), "S")
    middle = unfold(middle, "_k", inner, inner_extents) if len(inner) > 1 else middle.relabel(inner)
    return left, middle, right


def _conj(t: Tensor) -> Tensor:
    from tensorweft.operators.elementwise import conjugate

    return conjugate(t)


def _restored(f: Tensor, side: str, names: list[str], extent: dict[str, int], inner: list[str], inner_extents, labels) -> Tensor:
    f = Tensor(f.df, f.dims, tuple(prod(inner_extents) if d == "_k" else prod(extent[x] for x in names) for d in f.dims), f.kind, f.name)
    if len(names) > 1:
        f = unfold(f, side, names, [extent[x] for x in names])
    elif names:
        f = f.relabel([names[0] if d == side else d for d in f.dims])
    else:
        dims = tuple(d for d in f.dims if d != side)
        f = Tensor(f.df.select(*map(c, dims), *f.values), dims, tuple(n for d, n in zip(f.dims, f.extents) if d != side), f.kind, f.name)
    f = unfold(f, "_k", inner, inner_extents) if len(inner) > 1 else f.relabel([inner[0] if d == "_k" else d for d in f.dims])
    return permute(f, list(labels))


def orthogonalise(p: P.Pattern | str, t: Tensor) -> Tensor:
    """D = L R of its decomposition, the values left out; one inner label, as long as the smaller side."""
    p, rows, columns, inner = _sides(p)
    if len(inner) != 1:
        raise P.PatternError("one inner label expected")
    left, _, right = svd(p, t)
    return contract(p, left, right)


def gram_schmidt(p: P.Pattern | str, t: Tensor, tiny: float = 1e-12, tasks: int | None = None) -> Tensor:
    """The columns of the matrix (labels of R) made orthonormal one after the other, first fastest, in t's own shape.

    A column of which less than `tiny` of its norm is left once the ones before are taken out depends on them: it becomes
    zero and is left out of what follows.
    """
    import numpy as np

    p, rows, columns, _ = _sides(p)
    t = t.relabel(p.dest.labels)
    extent = dict(zip(t.dims, t.known()))
    n = prod(extent[x] for x in columns)
    if not rows or not columns or n > SIDE:
        raise TensorError(f"labels on both sides and {SIDE} columns at most are needed")
    a = _matrix(t, rows, columns)
    # the triangular factor's columns have the products of the matrix's own, so what makes the ones orthonormal makes the others
    made_of, r = np.eye(n, dtype=complex if t.complex else float), triangular(a, False, prod(extent[x] for x in rows), n, tasks)
    norms = np.linalg.norm(r, axis=0)
    for j in range(n):
        for _ in range(2):
            shares = r[:, :j].conj().T @ r[:, j]
            r[:, j] -= r[:, :j] @ shares
            made_of[:, j] -= made_of[:, :j] @ shares
        left = np.linalg.norm(r[:, j])
        scale = 1 / left if left > tiny * norms[j] and left > 0 else 0.0
        r[:, j] *= scale
        made_of[:, j] *= scale
    turn = Tensor.from_numpy(t.df.sparkSession, made_of, ("_j", "_q"))
    spread = None if tasks is None else Spread(("i",), tasks)
    made = contract("D(i,q)+=A(i,j)*B(j,q)", a, as_complex(turn) if t.complex else turn, spread=spread).relabel(["_i", "_j"])
    for side, names in (("_i", rows), ("_j", columns)):
        made = unfold(made, side, names, [extent[x] for x in names]) if len(names) > 1 else made.relabel([names[0] if d == side else d for d in made.dims])
    return permute(made, list(p.dest.labels)).named(t.name)


def singular_values(p: P.Pattern | str, t: Tensor, k: int | None = None, tasks: int | None = None) -> Tensor:
    return svd(p, t, k, tasks=tasks)[1]
