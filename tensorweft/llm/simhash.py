"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has eight bytes at eight positions. Two fingerprints that differ in at most two bits share at least six
of these positional bytes; cut into four blocks of two bytes, they share two whole blocks, so one of six postings of
four positional bytes holds both. Postings of up to max_posting fingerprints give pairs; a pair's shared positional
bytes are counted, pairs under the guaranteed minimum of six go, the others are verified bit by bit. Longer postings
are not cut: their fingerprints are linked exactly, without pairs, through the fingerprints one bit away (two are at
most two bits apart just if they have such a neighbour, or each other, in common), and each such hub has 65 members at
most.

With a similarity, texts are linked by the Jaccard similarity of their sets of word shingles, exactly: links of the
fingerprints of these sets come first and are verified by the sets. But sets of similarity 0.8 differ in some 15 % of
their fingerprints' bits, ten of 64, where no positional byte is guaranteed; so prefixes of the sets (setjoin.py) find
the pairs that the fingerprints leave apart.

Equal fingerprints (sets) are one node from the start, so copies never meet as pairs. A fingerprint of a text without words
(null included) is zero and linked like any other; by similarity such texts are one node. Texts of fewer words than a
shingle are one shingle. Texts are read whole, in slices. Repeated rows and ids are rows of one group. A null id is the
smallest id of no group. No rows give no rows. Columns beyond id and text are not read (near_duplicates) or stay (keep_one).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorweft.llm import setjoin
from tensorweft.llm.common import annotate, discard, materialise
from tensorweft.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Positional bytes that two fingerprints share at least when they differ in MAX_BITS bits at most.
MIN_SHARED = 8 - MAX_BITS
MAX_POSTING = 64
BLOCKS = 4


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """Eight bytes, most significant first."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return bytes(8)
    if len(words) < shingle:
        return xxhash.xxh64_digest(b" ".join(words), seed)
    count, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for i in range(0, n, 1 << 15):
        part = words[i : i + (1 << 15) + shingle - 1]
        hashes = b"".join(map(xxhash.xxh64_digest, map(b" ".join, zip(*(part[k:] for k in range(shingle)))), repeat(seed)))
        count += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > n).tobytes()


def fingerprints(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with fp, the fingerprint as a long."""

    def run(texts):
        return [[int.from_bytes(fingerprint(t, shingle, seed), "big", signed=True) for t in texts]]

    return annotate(docs, [text], run, "fp long", keep)


def postings(fps: DataFrame) -> DataFrame:
    """(key, fp): six postings a fingerprint, each of the bytes at four positions."""
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [
        F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j))
        for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def shared_bytes(a: str, b: str):
    x = F.col(a).bitwiseXOR(F.col(b))
    return sum((F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(0xFF)) == 0).cast("int") for i in range(8))


def links(fps: DataFrame, max_posting: int = MAX_POSTING) -> DataFrame:
    """(a, b): enough links between distinct fingerprints at most two bits apart to connect all that are."""
    posts = postings(fps)
    sizes = posts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    live = materialise(posts.join(sizes, "key"), "postings")
    short = live.filter(F.col("n") <= max_posting)
    pairs = (
        short.select("key", F.col("fp").alias("a"))
        .join(short.select("key", F.col("fp").alias("b")), "key")
        .filter("a < b")
        .filter(shared_bytes("a", "b") >= MIN_SHARED)
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
        .select("a", "b")
    )
    rest = live.filter(F.col("n") > max_posting).select("fp").distinct()
    near = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    hubs = rest.select("fp", F.explode(near).alias("hub")).groupBy("hub").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    starred = hubs.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")
    return pairs.unionAll(starred)


def grouped(rows: DataFrame, first: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """rows with component_id: the smallest id (first, of each node) that links between nodes reach."""
    groups = materialise(components(links).withColumnRenamed("node", node).join(first, node), "groups")
    least = groups.groupBy("root").agg(F.min("first").alias("least"))
    ids = first.join(groups.join(least, "root").select(node, "least"), node, "left").select(node, F.coalesce("least", "first").alias("component_id"))
    return rows.join(ids, node)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_posting: int = MAX_POSTING, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of docs; component_id is the smallest id that links reach.

    similarity: link texts of this Jaccard similarity instead of fingerprints at most MAX_BITS apart; fp is then that of the set.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if similarity is not None:
        return near_by_similarity(named, max_posting, shingle, similarity)
    rows = materialise(fingerprints(named, keep=["doc_id"], shingle=shingle), "fingerprints")
    first = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    return grouped(rows, first, links(first.select("fp"), max_posting), "fp").select("doc_id", "fp", "component_id")


def set_fingerprint(held) -> int:
    """The fingerprint of a set of hashes, as a long."""
    import numpy as np

    if not len(held):
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, len(held), 1 << 15):
        count += np.unpackbits(held[i : i + (1 << 15)].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(held)).tobytes(), "big", signed=True)


def near_by_similarity(named: DataFrame, max_posting: int, shingle: int, t: float) -> DataFrame:
    def read(texts):
        sets = [setjoin.shingles(x, shingle) for x in texts]
        return *setjoin.described(sets), [set_fingerprint(x) for x in sets]

    rows = materialise(annotate(named, ["text"], read, f"{setjoin.FIELDS}, fp long"), "nodes")
    sizes = materialise(rows.groupBy(*(c for c in rows.columns if c not in ("doc_id", "text"))).agg(F.min("doc_id").alias("first")), "sizes")
    # 1. fingerprints of a few bits' distance; one set stands for all of a fingerprint
    by_fp = materialise(sizes.groupBy("fp").agg(F.min("node").alias("a")), "fingerprints")
    same = sizes.join(by_fp, "fp").filter("node <> a").select("a", F.col("node").alias("b"))
    close = links(by_fp.select("fp"), max_posting).withColumnsRenamed({"a": "fp1", "b": "fp2"})
    of = lambda fp, c: by_fp.select(F.col("fp").alias(fp), F.col("a").alias(c))
    near = close.join(of("fp1", "x"), "fp1").join(of("fp2", "y"), "fp2").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    check = lambda pairs: setjoin.verified(pairs, rows, sizes, t, shingle)
    sure = check(same.unionAll(near))
    roots = lambda: materialise(components(sure), "roots")
    # 2. prefixes of the sets, for what these leave apart
    entries = setjoin.entries_of(rows, sizes, t, shingle)
    has_long = not entries.filter(F.col("times") > max_posting).isEmpty()
    pairs = setjoin.short_pairs(entries, known := roots(), t, max_posting)
    if has_long:
        pairs = pairs.unionAll(setjoin.hub_pairs(entries, known, t, max_posting))
    sure = sure.unionAll(check(pairs))
    if has_long:
        sure = sure.unionAll(check(setjoin.long_pairs(entries, roots(), t, max_posting)))
    discard(entries)
    first = sizes.select("node", "first")
    return grouped(rows.select("doc_id", "node", "fp"), first, sure, "node").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of docs with the smallest id of each near-duplicate group.

    Of equal rows under one id one stays; different texts under one id both stay, as do rows without an id.
    """
    found = near_duplicates(docs, doc_id, text, shingle=shingle, similarity=similarity)
    kept = materialise(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    ids = kept.select(F.col("doc_id").alias(doc_id))
    held = docs.join(ids.hint("shuffle_hash"), doc_id, "left_semi").select(docs.columns)
    spare = docs.filter(F.col(doc_id).isNull())
    often = kept.filter("n > 1").select(F.col("doc_id").alias(doc_id))
    if not often.isEmpty():
        once = held.join(often.hint("shuffle_hash"), doc_id, "left_anti").select(docs.columns)
        held = once.unionAll(held.join(often.hint("shuffle_hash"), doc_id, "left_semi").select(docs.columns).dropDuplicates([doc_id, text]))
    return held.unionAll(spare)
