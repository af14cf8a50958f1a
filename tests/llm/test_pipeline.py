"""The pipeline against its parts' plain versions, stage by stage."""

import random
import re

import pytest
import zstandard

import corpus_pipeline
from tensorweft.llm import quality, simhash
from tensorweft.llm.common import table

from .test_counts import ITEMS, plain_counts, plain_hits
from .test_duplicates import roots
from .conftest import DOCS, words
from .test_pii import plain


def similar_groups(texts, ids):
    """Smallest id of each text's group: all pairs of texts, sets of five-word runs, similarity 0.8."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]
    near = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    root = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if near(sets[i], sets[j])])
    return [min((ids[j] for j, r in enumerate(root) if r == x and ids[j] is not None), default=None) for x in root]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('tables')}"
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    z, columns = zstandard.ZstdCompressor(level=3), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        before, after = [tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]
        if name != "mixing":
            assert out.columns == columns and out.dtypes == docs.dtypes
        if name == "quality":
            counts = {r: plain_counts(r[1]) for r in before}
            want = [r for r in before if counts[r][0] >= 50 and 2 * counts[r][4] <= counts[r][0] and quality.compression(r[1].encode(), z)[0]]
            assert sorted(map(str, after)) == sorted(map(str, want))
        elif name == "near_duplicates":
            groups = similar_groups([r[1] for r in before], [r[0] for r in before])
            want = {str(r) for r, g in zip(before, groups) if r[0] is None or r[0] == g}
            assert sorted(map(str, after)) == sorted(want)
        elif name == "decontamination":
            want = [r for r in before if not plain_hits(r[1], [i for i in ITEMS if i[0] not in ()])[4]]
            assert sorted(map(str, after)) == sorted(map(str, want))
        elif name == "personal_data":
            assert len(after) == len(before) and not any(any(plain(r[1])) for r in after)
            assert all(r[4] == len(r[1]) for r in after)
        else:
            sizes = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in before}
            assert all(0 < r.taken <= 2 * sizes[r.doc_id] for r in out.collect())
        docs = out


def test_run(spark, folder, sf_dir):
    first, again = (sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) for _ in range(2))
    assert first == again
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_empty(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_near_copies_by_similarity(spark):
    """Groups are those of all pairs whose five-word shingles reach 0.8, also where every posting is a long one."""
    r = random.Random(3)
    texts = []
    for k in range(12):
        base = words(r.randint(60, 300), k, 400).split()
        for _ in range(r.randint(1, 8)):
            base = list(base)
            for _ in range(r.randint(0, 5)):
                base[r.randrange(len(base))] = f"w{r.randrange(10**6)}"
            texts.append(" ".join(base))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS).repartition(3)
    groups = similar_groups(texts, list(range(len(texts))))
    least = set(groups)
    assert 12 <= len(least) < len(texts) - 12
    for most in (1, 64):
        got = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs, max_posting=most, shingle=5, similarity=0.8).collect()}
        assert got == dict(enumerate(groups))
    # copies that op2's two bits keep apart don't pass the stage
    kept = [x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted(least) and simhash.keep_one(docs).count() > len(kept)


def test_bounds_lose_no_pair():
    """The parity sketch and the counts by bucket let every pair of similar sets pass."""
    import numpy as np

    from tensorweft.llm import setjoin

    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(2, 900))
        x = np.unique(r.integers(-(1 << 62), 1 << 62, n))
        y = np.unique(np.concatenate([x[: len(x) - int(r.integers(0, max(1, len(x) // 8)))], r.integers(-(1 << 62), 1 << 62, int(r.integers(0, 1 + n // 10)))]))
        shared = len(np.intersect1d(x, y))
        apart = sum(bin((a ^ b) & (1 << 64) - 1).count("1") for a, b in zip(setjoin.parity_of(x), setjoin.parity_of(y)))
        assert apart <= len(x) + len(y) - 2 * shared
        assert setjoin.most_shared(setjoin.counts_of(x), setjoin.counts_of(y)) >= shared
