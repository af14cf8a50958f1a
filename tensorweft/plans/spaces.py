"""Vector spaces: bases, subspace aggregation trees, relations between subspaces, and real-space boxes.

A space is a basis of n vectors with a tree of subspaces over it: each node is a range of the basis, split into up to
`branch` parts until parts are single segments of a color (or single vectors). The tree is a small table, (space, id,
parent, level, lo, hi) with basis range [lo, hi), and everything about it is table algebra.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BRANCH = 2
SCHEMA = "space string, subspace_id bigint, parent_id bigint, level int, lo bigint, hi bigint"
RELATIONS = ("SAME", "LESS", "GREATER", "PARENT", "CHILD", "SIBLING", "UNRELATED")


class SpaceError(ValueError):
    pass


def segment_count(extent: int, limit: int) -> int:
    """Segments of at most `limit` that an extent takes; none for extents or limits that aren't positive."""
    return -(-extent // limit) if extent > 0 and limit > 0 else 0


def split_range(lo: int, hi: int, parts: int, borders: Sequence[int] | None = None) -> list[tuple[int, int]]:
    """[lo, hi) in up to `parts` parts of nearly equal length, cut at borders only if these are given."""
    n = hi - lo
    parts = max(1, min(parts, n))
    allowed = sorted({b for b in borders if lo < b < hi}) if borders is not None else None
    cuts, last = [], lo
    for k in range(1, parts):
        ideal = lo + round(k * n / parts)
        if allowed is None:
            cut = ideal
        else:
            later = [b for b in allowed if b > last]
            if not later:
                break
            cut = min(later, key=lambda b: (abs(b - ideal), b))
        if last < cut < hi:
            cuts.append(cut)
            last = cut
    return list(zip([lo, *cuts], [*cuts, hi]))


@dataclass
class Space:
    """A basis of n vectors; colors: a label per vector, whose changes are the only cuts of the tree if given."""

    name: str
    n: int
    branch: int = BRANCH
    colors: Sequence[int] | None = None
    nodes: list[tuple[int, int | None, int, int, int]] = field(default_factory=list)

    def __post_init__(self):
        if self.n <= 0 or self.branch < 2:
            raise SpaceError("a space has a basis, and a tree branches in two parts at least")
        if self.colors is not None and len(self.colors) != self.n:
            raise SpaceError(f"{len(self.colors)} colors for {self.n} vectors")
        borders = None if self.colors is None else [i for i in range(1, self.n) if self.colors[i] != self.colors[i - 1]]
        level = [(None, 0, self.n)]
        depth = 0
        while level:
            following = []
            for parent, lo, hi in level:
                me = len(self.nodes)
                self.nodes.append((me, parent, depth, lo, hi))
                parts = split_range(lo, hi, self.branch, borders)
                if len(parts) > 1:
                    following += [(me, a, b) for a, b in parts]
            level, depth = following, depth + 1

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.name, *x) for x in self.nodes], SCHEMA)

    def level(self, depth: int) -> list[tuple[int, int]]:
        """Ranges of the nodes at a depth and of leaves above it: they cover the basis."""
        parents = {p for _, p, *_ in self.nodes}
        return sorted((lo, hi) for me, _, d, lo, hi in self.nodes if d == depth or (d < depth and me not in parents))


@dataclass
class SpaceRegistry:
    """Spaces, subspaces and index labels by name."""

    spaces: dict[str, Space] = field(default_factory=dict)
    subspaces: dict[str, tuple[str, int, int]] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)

    def register_space(self, name: str, n: int, branch: int = BRANCH, colors: Sequence[int] | None = None) -> Space:
        if self.exists(name):
            raise SpaceError(f"{name} is there already")
        self.spaces[name] = out = Space(name, n, branch, colors)
        return out

    def unregister_space(self, name: str) -> None:
        self.spaces.pop(name)
        for s in [s for s, (space, *_) in self.subspaces.items() if space == name]:
            self.unregister_subspace(s)

    def register_subspace(self, name: str, space: str, lo: int, hi: int) -> None:
        """A range [lo, hi) of a space's basis under a name."""
        if self.exists(name):
            raise SpaceError(f"{name} is there already")
        if not 0 <= lo < hi <= self.spaces[space].n:
            raise SpaceError(f"[{lo}, {hi}) isn't in {space}")
        self.subspaces[name] = (space, lo, hi)

    def unregister_subspace(self, name: str) -> None:
        self.subspaces.pop(name)
        for label in [x for x, s in self.labels.items() if s == name]:
            del self.labels[label]

    def register_label(self, label: str, subspace: str) -> None:
        if subspace not in self.subspaces and subspace not in self.spaces:
            raise SpaceError(f"no such subspace: {subspace}")
        self.labels[label] = subspace

    def unregister_label(self, label: str) -> None:
        self.labels.pop(label)

    def exists(self, name: str) -> bool:
        return name in self.spaces or name in self.subspaces or name in self.labels

    def status(self, name: str) -> str:
        """space, subspace, label or absent."""
        return next((kind for kind, held in (("space", self.spaces), ("subspace", self.subspaces), ("label", self.labels)) if name in held), "absent")

    def range_of(self, name: str) -> tuple[str, int, int]:
        """(space, lo, hi) of a label, subspace or space."""
        name = self.labels.get(name, name)
        if name in self.subspaces:
            return self.subspaces[name]
        if name in self.spaces:
            return name, 0, self.spaces[name].n
        raise SpaceError(f"no such symbol: {name}")

    def extent(self, name: str) -> int:
        _, lo, hi = self.range_of(name)
        return hi - lo

    def smallest_covering(self, name: str) -> tuple[int, int]:
        """Range of the smallest tree node that holds a subspace."""
        space, lo, hi = self.range_of(name)
        return min(((a, b) for _, _, _, a, b in self.spaces[space].nodes if a <= lo and hi <= b), key=lambda r: r[1] - r[0])

    def embedding(self, name: str) -> tuple[int, int]:
        """(extent, offset): a tensor over the subspace lies in one over the node that covers it, from the offset on."""
        _, lo, _ = self.range_of(name)
        a, b = self.smallest_covering(name)
        return b - a, lo - a

    def resolve(self, extents: Sequence[int], callback: Callable[[int], int]) -> tuple[int, ...]:
        """Deferred extents (0), resolved by position."""
        return tuple(n or callback(i) for i, n in enumerate(extents))


# ------------------------------------------------------------------ the tree as a table


def relation(a: str, b: str) -> Column:
    """How node a stands to node b (structs with subspace_id, parent_id, lo, hi) of one tree."""
    x, y = F.col(a), F.col(b)
    return (
        F.when(x["subspace_id"] == y["subspace_id"], "SAME")
        .when(F.coalesce(x["subspace_id"] == y["parent_id"], F.lit(False)), "PARENT")
        .when(F.coalesce(y["subspace_id"] == x["parent_id"], F.lit(False)), "CHILD")
        .when(F.coalesce(x["parent_id"] == y["parent_id"], F.lit(False)), "SIBLING")
        .when(x["hi"] <= y["lo"], "LESS")
        .when(x["lo"] >= y["hi"], "GREATER")
        .otherwise("UNRELATED")
    )


def ancestors(tree: DataFrame) -> DataFrame:
    """(subspace_id, ancestor_id, distance): every node with all above it; a join a level, over the tree alone."""
    step = tree.select("subspace_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance")).filter("ancestor_id IS NOT NULL")
    out, now = step, step
    up = tree.select(F.col("subspace_id").alias("ancestor_id"), "parent_id").filter("parent_id IS NOT NULL")
    depth = tree.agg(F.max("level")).first()[0] or 0
    for _ in range(depth - 1):
        now = now.join(up, "ancestor_id").select("subspace_id", F.col("parent_id").alias("ancestor_id"), (F.col("distance") + 1).alias("distance"))
        out = out.unionAll(now)
    return out


def common_subspace(tree: DataFrame, a: int, b: int) -> DataFrame:
    """(subspace_id, lo, hi): the smallest node that holds both."""
    ends = tree.filter(F.col("subspace_id").isin(a, b)).agg(F.min("lo").alias("a"), F.max("hi").alias("b"))
    held = tree.join(F.broadcast(ends), (F.col("lo") <= F.col("a")) & (F.col("hi") >= F.col("b")))
    return held.orderBy(F.col("hi") - F.col("lo"), F.col("level").desc()).limit(1).select("subspace_id", "lo", "hi")


# ------------------------------------------------------------------ ranges and boxes


def overlap(a_lo: str, a_hi: str, b_lo: str, b_hi: str) -> Column:
    """Length that two ranges share."""
    return F.greatest(F.lit(0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo))


def range_union(a_lo: str, a_hi: str, b_lo: str, b_hi: str) -> Column:
    """The smallest range around two."""
    return F.struct(F.least(a_lo, b_lo).alias("lo"), F.greatest(a_hi, b_hi).alias("hi"))


def range_join(left: DataFrame, right: DataFrame, lo: str, hi: str, other_lo: str, other_hi: str, width: int) -> DataFrame:
    """Pairs of ranges that overlap: an equi-join on cells of `width` that both touch, each pair in its first cell only.

    Ranges are [lo, hi) of integers. A range lies in (hi - lo) / width + 2 cells at most, so width belongs near the
    typical length.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    x = left.filter(F.col(lo) < F.col(hi)).withColumn("_cell", cells(lo, hi))
    y = right.filter(F.col(other_lo) < F.col(other_hi)).withColumn("_cell", cells(other_lo, other_hi))
    both = x.join(y, "_cell").filter((F.col(lo) < F.col(other_hi)) & (F.col(other_lo) < F.col(hi)))
    return both.filter(F.col("_cell") == F.floor(F.greatest(lo, other_lo) / width)).drop("_cell")


def box_volume(box: Column | str) -> Column:
    """Of an array of (lo, hi): the product of lengths."""
    return F.aggregate(box, F.lit(1.0), lambda acc, r: acc * (r["hi"] - r["lo"]))


def box_overlap(a: Column | str, b: Column | str) -> Column:
    """The box that two share; a range with hi <= lo where they don't meet."""
    return F.zip_with(a, b, lambda x, y: F.struct(F.greatest(x["lo"], y["lo"]).alias("lo"), F.least(x["hi"], y["hi"]).alias("hi")))


def box_union(a: Column | str, b: Column | str) -> Column:
    """The smallest box around two."""
    return F.zip_with(a, b, lambda x, y: F.struct(F.least(x["lo"], y["lo"]).alias("lo"), F.greatest(x["hi"], y["hi"]).alias("hi")))


def vector_norm2(v: Column | str) -> Column:
    """The root of the sum of squares."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def vector_add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vector_scale(v: Column | str, factor: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(factor))


def vector_average(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)
