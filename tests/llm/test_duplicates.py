"""SimHash groups and repeated substrings against plain versions."""

import hashlib
import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tensorweft.llm import components, simhash, substrings

from .conftest import awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def plain_groups(fps, ids, bits=2):
    distinct = sorted(set(fps))
    at = {f: i for i, f in enumerate(distinct)}
    r = roots(len(distinct), [(i, j) for i in range(len(distinct)) for j in range(i) if bin(distinct[i] ^ distinct[j]).count("1") <= bits])
    least = {}
    for f, i in zip(fps, ids):
        if i is not None:
            k = r[at[f]]
            least[k] = min(least.get(k, i), i)
    return [least.get(r[at[f]]) for f in fps]


@given(st.text(alphabet="aB cÄ\n\t\x85\xa0", max_size=40))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(text.encode()), "big") == plain_fingerprint(text)


def test_groups(docs):
    rows = awkward()
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    want = sorted(zip(map(str, [r[0] for r in rows]), fps, map(str, plain_groups(fps, [r[0] for r in rows]))))
    got = sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want


@pytest.mark.parametrize("most", [1, 4, 64])
def test_links_connect_all(spark, most):
    """Few long postings, many chains: with every limit on postings the same groups come out."""
    r = random.Random(7)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(r.randint(1, 3)):
                x ^= 1 << r.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), most)
    at = {f: i for i, f in enumerate(signed)}
    got = roots(len(fps), [(at[a], at[b]) for a, b in edges.collect()])
    want = plain_groups(fps, range(len(fps)))
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


@pytest.mark.parametrize("shape", ["path", "star", "clique", "random"])
def test_components(spark, shape):
    r = random.Random(3)
    n = 60
    edges = {
        "path": [(i, i + 1) for i in range(n - 1)],
        "star": [(0, i) for i in range(1, n)],
        "clique": [(i, j) for i in range(15) for j in range(i)],
        "random": [(r.randrange(n), r.randrange(n)) for _ in range(35)],
    }[shape]
    got = dict(tuple(x) for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = roots(n, edges)
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in got for j in got)


def test_no_links(spark, none):
    assert simhash.near_duplicates(none).count() == 0
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(docs):
    kept = sorted((str(r.doc_id), r.text or "") for r in simhash.keep_one(docs).collect())
    ids = [i for i, _ in kept]
    assert "2" not in ids and "7" not in ids and "1" in ids and "6" in ids
    assert ids.count("None") == 2 and ids.count("13") == 2 and simhash.keep_one(docs).columns == docs.columns


def plain_cut(rows, target):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - target + 1):
            if i is not None:
                g = tuple(w[k : k + target])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - target + 1):
            if i is not None and first[tuple(w[k : k + target])] < i:
                gone |= set(range(k, k + target))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize("target", [13, 5, 2])
def test_repeats(docs, target):
    rows = [(i, t) for i, t, *_ in awkward() if t is None or target == 13 or len(t) < 5000]
    df = docs if target == 13 else docs.filter("text IS NULL OR length(text) < 5000")
    got = sorted((str(r[0]), *r[1:]) for r in substrings.remove_repeats(df, target=target).collect())
    assert got == plain_cut(rows, target)


def test_repeats_of_random_texts(spark):
    r = random.Random(11)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(40)]
    got = sorted((str(x[0]), *x[1:]) for x in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), target=7).collect())
    assert got == plain_cut(rows, 7)


def test_repeats_empty(none, clashing):
    assert substrings.remove_repeats(none).count() == 0
    assert substrings.remove_repeats(clashing, texts=False).count() == len(awkward())


def test_levels():
    assert substrings.levels(13) == [7, 13]
    assert substrings.levels(50, 10) == [7, 13, 25, 50]


def test_doubling_ends(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, "x " + base), (3, base[:200]), (4, None), (5, "short")]
    got = {r.length: (r.n_windows, r.n_docs) for r in substrings.doubled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(got) == [13, 26, 52]
    assert got[13] == (48, 3) and got[52] == (9, 3)


def test_hash_is_stable_over_slices(spark):
    rows = [(i, f"a b c d e f g h i j k l m {i}" * (1 + i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted(tuple(r) for r in substrings.remove_repeats(df.repartition(n)).collect()) for n in (1, 17))
    assert one == many and F
