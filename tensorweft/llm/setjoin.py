"""Links between texts whose sets of word shingles have a Jaccard similarity of t or more; exact.

A text is the set of hashes of its runs of `shingle` words. Under any one order of all shingles, two sets whose
similarity is at least t share one of the first n - ceil(t n) + 1 shingles of each, so postings of these prefixes lose no
pair. The order puts shingles that are common in a sample of the texts last, others by their hashes; the sample decides
what a run costs, never what it finds.

Bounds that a pair must meet are join conditions, so only pairs that can reach t become rows: what is left of the sets
behind the shared shingle, and a parity sketch (256 bits, each the parity of the hashes that fall on it: sets that differ
in d shingles differ in at most d bits). Counts by bucket come next, then the sets themselves.

Texts that are linked already (roots) aren't compared again. Postings of up to max_posting sets give all their pairs.
The sets of a longer one are first held against HUBS of its members, drawn by hash; what these links leave apart is
compared with salts, about SALT sets a task, so no task holds a long posting. That last step compares, but doesn't emit,
as many pairs as the posting has sets that are neither linked nor alike.
"""

from __future__ import annotations

import math
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tensorweft.llm.common import annotate, discard, emit, materialise, maybe_broadcast

SEED = 42
HUBS = 4
SALT = 1000
#: Shingles before its own that an entry knows.
BEFORE = 8
#: Longs of a parity sketch.
SKETCH = 4
#: Texts whose shingles are counted for the order, about; shingles of COMMON_LEAST of them are common; so many at most travel.
ORDER_TEXTS, COMMON_LEAST, COMMON_MOST = 8000, 3, 200_000

#: What an entry of a posting says of its set.
COLUMNS = ("node", "place", "before", *(f"k{i}" for i in range(SKETCH)))
FIELDS = "node long, n long, counts binary, " + ", ".join(f"k{i} long" for i in range(SKETCH))


def shingles(text: bytes | None, shingle: int, seed: int = SEED):
    """Sorted distinct hashes."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)] if words else []
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, runs, repeat(seed))), ">i8").astype(np.int64))


def node_of(held) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(held.tobytes(), SEED), "big", signed=True)


def counts_of(held) -> bytes:
    """How many hashes each of 256 buckets has, 255 for more."""
    import numpy as np

    return np.minimum(np.bincount(held & 255, minlength=256), 255).astype(np.uint8).tobytes()


def parity_of(held) -> tuple[int, ...]:
    """The parity sketch as longs."""
    import numpy as np

    bits = np.bincount((held >> 8) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return tuple(np.packbits(bits.astype(np.uint8)).view(">i8").tolist())


def described(sets) -> tuple:
    """The columns of FIELDS."""
    sketches = [parity_of(x) for x in sets]
    return [node_of(x) for x in sets], [len(x) for x in sets], [counts_of(x) for x in sets], *([k[i] for k in sketches] for i in range(SKETCH))


def most_shared(x: bytes, y: bytes) -> float:
    """No two sets with these counts share more."""
    import numpy as np

    least = np.minimum(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))
    return math.inf if (least == 255).any() else int(least.sum(dtype=np.int64))


def least_overlap(n: int, m: int, t: float) -> int:
    return math.ceil(t / (1 + t) * (n + m) - 1e-9)


def prefix(held, common, t: float):
    """The shingles that a set of similarity t must share one of, in the order's order."""
    import numpy as np

    late = np.isin(held, common, assume_unique=True)
    ordered = np.concatenate([held[~late], held[late]])
    return ordered[: len(held) - math.ceil(t * len(held) - 1e-9) + 1]


def verified(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, t: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose sets reach t, written. texts: (text, node), a row or more for each node; sizes: (node, n, counts)."""
    of = lambda c, k: sizes.select(F.col("node").alias(c), F.col("n").alias(f"n{k}"), F.col("counts").alias(f"c{k}"))
    counted = pairs.distinct().join(of("a", 1), "a").join(of("b", 2), "b")
    can = annotate(counted, ["n1", "n2", "c1", "c2"], lambda n, m, x, y: ([most_shared(c, d) >= least_overlap(a, b, t) for a, b, c, d in zip(n, m, x, y)],), "can boolean", ["a", "b"])
    pairs = materialise(can.filter("can").select("a", "b"), "candidates")
    wanted = materialise(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
    one = texts.select("node", "text").join(maybe_broadcast(wanted), "node", "left_semi").dropDuplicates(["node"])
    sets = materialise(annotate(one, ["text"], lambda ts: ([shingles(x, shingle).tolist() for x in ts],), "held array<long>", ["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")

    def near(xs, ys):
        import numpy as np

        shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(xs, ys)]
        return ([s >= least_overlap(len(x), len(y), t) for s, x, y in zip(shared, xs, ys)],)

    links = materialise(annotate(both, ["x", "y"], near, "near boolean", ["a", "b"]).filter("near").select("a", "b"), "links")
    discard(sets, wanted, pairs)
    return links


def common_shingles(texts: DataFrame, rows: int, shingle: int):
    import numpy as np

    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, rows // ORDER_TEXTS))) == 0)
    each = emit(some, ["text"], lambda ts: (np.concatenate([np.zeros(0, np.int64), *(shingles(x, shingle) for x in ts)]),), "s long")
    found = each.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_LEAST).orderBy(F.desc("n"), "s").limit(COMMON_MOST)
    return np.sort(np.array([r[0] for r in found.collect()], np.int64))


def entries_of(texts: DataFrame, sizes: DataFrame, t: float, shingle: int) -> DataFrame:
    """(s, times, node, place, before, k0, ...): the prefixes' shingles that two sets or more have.

    place: size << 32 | place in the order. before: up to BEFORE shingles of the kind that the set has before s. A pair
    whose entries both know a shingle before theirs meets, or met, there.
    """
    held = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, texts.count(), shingle))

    def post(given, nodes):
        import numpy as np

        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        for x, node in zip(given, nodes):
            have = shingles(x, shingle)
            first = prefix(have, held.value, t) if len(have) else have
            for column, part in zip(out, (first, np.full(len(first), node), (len(have) << 32) + np.arange(len(first)))):
                column.append(part)
        return tuple(np.concatenate(c) for c in out)

    posts = materialise(emit(texts, ["text", "node"], post, "s long, node long, place long"), "posts")
    live = posts.groupBy("s").agg(F.count("*").alias("times"), F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("s", "times")
    sketches = sizes.select("node", *(f"k{i}" for i in range(SKETCH)))
    earlier = Window.partitionBy("node").orderBy("place").rowsBetween(-BEFORE, -1)
    shared = posts.join(live, "s").distinct().withColumn("before", F.collect_list("s").over(earlier))
    entries = materialise(shared.join(sketches, "node"), "entries")
    discard(posts)
    return entries


def can_reach(x: str, y: str, t: float, once: bool):
    """Whether two entries of one posting, columns with the suffixes x and y, may be of sets that reach t.

    once: all pairs of the postings meet, so let one do so a single time, in one order.
    """
    size = lambda e: F.shiftright(f"place{e}", 32)
    left = lambda e: size(e) - F.col(f"place{e}").bitwiseAND(F.lit(0xFFFFFFFF))
    shared = F.ceil(F.lit(t / (1 + t)) * (size(x) + size(y)) - 1e-9)
    apart = sum(F.bit_count(F.col(f"k{i}{x}").bitwiseXOR(F.col(f"k{i}{y}"))) for i in range(SKETCH))
    able = (F.least(left(x), left(y)) >= shared) & (apart <= size(x) + size(y) - 2 * shared)
    able = (F.col(f"root{x}") != F.col(f"root{y}")) & able
    return (F.col(f"node{x}") < F.col(f"node{y}")) & able & ~F.arrays_overlap(f"before{x}", f"before{y}") if once else able


def rooted(entries: DataFrame, roots: DataFrame) -> DataFrame:
    return entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def suffixed(entries: DataFrame, suffix: str, by: tuple[str, ...] = ("s",)) -> DataFrame:
    return entries.select(*by, *(F.col(c).alias(c + suffix) for c in (*COLUMNS, "root")))


def found(left: DataFrame, right: DataFrame, by: list[str], t: float, once: bool = True) -> DataFrame:
    """(a, b), a < b: pairs of the two sides' entries that may reach t."""
    return left.join(right, by).filter(can_reach("1", "2", t, once)).select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"))


def short_pairs(entries: DataFrame, roots: DataFrame, t: float, max_posting: int) -> DataFrame:
    """All pairs of short postings."""
    short = rooted(entries.filter(F.col("times") <= max_posting), roots)
    return found(suffixed(short, "1"), suffixed(short, "2"), ["s"], t)


def hub_pairs(entries: DataFrame, roots: DataFrame, t: float, max_posting: int) -> DataFrame:
    """Pairs of long postings whose one side is a hub: HUBS of its sets, drawn for every posting."""
    long = rooted(entries.filter(F.col("times") > max_posting), roots)
    entry = lambda k: F.struct(F.xxhash64("s", "node", F.lit(k)).alias("o"), *COLUMNS, "root")
    drawn = long.groupBy("s").agg(*(F.min(entry(k)).alias(f"h{k}") for k in range(HUBS)), F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
    hubs = drawn.select("s", F.explode(F.array_distinct(F.array(*(F.struct(*(F.col(f"h{k}.{c}").alias(c) for c in (*COLUMNS, "root"))) for k in range(HUBS))))).alias("h")).select("s", "h.*")
    return found(suffixed(long, "1"), suffixed(hubs, "2"), ["s"], t, once=False)


def long_pairs(entries: DataFrame, roots: DataFrame, t: float, max_posting: int) -> DataFrame:
    """Pairs of long postings whose sets are still apart."""
    held = rooted(entries.filter(F.col("times") > max_posting), roots)
    open_ = held.groupBy("s").agg(F.count("*").alias("many"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
    open_ = open_.select("s", F.ceil(F.col("many") / SALT).cast("int").alias("salts"))
    held = materialise(held.join(open_, "s"), "open")
    one = held.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    all_ = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    pairs = materialise(found(suffixed(one, "1", ("s", "salt")), suffixed(all_, "2", ("s", "salt")), ["s", "salt"], t), "pairs")
    discard(held)
    return pairs
