"""URL filters: explicit rules, and gradient-boosted trees on lexical features for the rest.

A rule is (verdict, host, path). It fits its host and all subdomains if the url's path starts with the rule's; of the
rules that fit the longest wins, of equally long ones the one listed first. Other urls get the trees' verdict.

Features: lengths of url, host, path and query; depth; digit and hyphen shares; entropy of host and path; numbers of
parameters and subdomains; the longest label; and suffix statistics, the smoothed share of blocked labels among all
labelled urls with the same last one, two and three host labels. A training url doesn't count itself in these.

The trees are trained on at most SAMPLE labelled urls, those with the smallest hashes of the url, so the fit is bounded
and the same on every run; scoring covers all rows. Without labelled urls of both kinds the method allows everything
(or blocks, if all labels say so). Null urls and urls without :// have an empty host and path and no rule, and are scored
like others, as are very long ones, which are read whole. Repeated rows get the same verdict, and count once in training.
A score of just the threshold blocks. Empty tables give empty results. Other columns stay (judge) or those of keep; one
with the name of a computed column gives way to it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from copy import copy
from itertools import repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorweft.llm.common import annotate, emit, materialise, maybe_broadcast, quoted

#: Labelled urls that a fit reads at most.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAF = 40, 3, 0.3, 32, 5
SMOOTH = 2.0
THRESHOLD = 0.5

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Terms that label a url for training (a seed list): a host label with one of them is bad.
BAD_TERMS = ("adult", "ads", "bet", "bets", "betting", "bingo", "casino", "cheap", "dating", "escort", "farm", "free", "gambling", "jackpot", "loan", "loans", "lottery", "pharma", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "track", "tracker", "tracking", "viagra", "warez", "win", "xxx")

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path)"""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[cut:]
    end = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return rest[:cut].translate(_UPPER), path[:end]


class Rules:
    """Rules by host, so that a url meets only those of its host's suffixes."""

    def __init__(self, rules: Sequence[tuple[str, str, str]] = RULES):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, host + path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, labels = None, host.split(".")
        for i in range(len(labels)):
            for start, name, verdict in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(start) and (best is None or len(name) > len(best[0])):
                    best = (name, verdict)
        return best


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[-k:]) if len(labels) >= k else "" for k in (1, 2, 3)]


def lexical(url: str | None) -> list[float]:
    url = url or ""
    host, path = split_url(url)
    query = url.partition("?")[2].partition("#")[0]
    labels, n = host.split("."), max(1, len(url))
    return [
        len(url), len(host), len(path), len(query), path.count("/"),
        sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host), host.count("-"),
        entropy(host), entropy(path), query.count("=") + query.count("&"), len(labels), max(map(len, labels)),
    ]


class SuffixStatistics:
    """Blocked and all labels by (place, suffix); those of the given urls, or counted before."""

    def __init__(self, hosts: Sequence[str], labels: Sequence[int], seen: dict | None = None, prior: float | None = None):
        self.seen: dict[tuple[int, str], list[int]] = dict(seen or {})
        for h, y in zip(hosts, labels) if seen is None else ():
            for key in enumerate(suffixes(h)):
                x = self.seen.setdefault(key, [0, 0])
                x[0] += y
                x[1] += 1
        self.prior = sum(labels) / max(1, len(labels)) if prior is None else prior

    def shares(self, host: str, own: int | None = None, counts: Sequence[tuple[int, int]] | None = None) -> list[float]:
        """own: the label of a training url, taken out of the counts. counts: blocked and all labels of the host's suffixes, where known."""
        out = []
        for k, s in enumerate(suffixes(host)):
            bad, n = self.seen.get((k, s), (0, 0)) if counts is None else counts[k]
            if own is not None:
                bad, n = bad - own, n - 1
            out.append((bad + SMOOTH * self.prior) / (n + SMOOTH))
        return out


class Trees:
    """Gradient-boosted trees for a logistic loss, on binned features, grown level by level."""

    def fit(self, x, y):
        import numpy as np

        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        p = y.mean()
        self.base = math.log(p / (1 - p))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-score))
            grad, hess = y - q, q * (1 - q)
            node, tree = np.zeros(len(y), np.int64), {}
            for depth in range(DEPTH):
                for leaf in np.unique(node):
                    at = np.flatnonzero(node == leaf)
                    split = self._split(bins[at], grad[at], hess[at])
                    if split is not None and leaf >= (1 << depth) - 1:
                        tree[int(leaf)] = split
                        node[at] = 2 * leaf + 1 + (bins[at, split[0]] > split[1])
            values = {int(k): float(RATE * grad[node == k].sum() / (hess[node == k].sum() + 1.0)) for k in np.unique(node)}
            score += np.array([values[k] for k in node.tolist()])
            self.trees.append((tree, values))
        return self

    @staticmethod
    def _split(bins, grad, hess):
        import numpy as np

        best, total_g, total_h, n = (1e-6, None), grad.sum(), hess.sum(), len(grad)
        whole = total_g**2 / (total_h + 1)
        for j in range(bins.shape[1]):
            g, h, c = (np.bincount(bins[:, j], w, BINS + 1).cumsum()[:-1] for w in (grad, hess, np.ones(n)))
            gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - whole
            gain[(c < LEAF) | (n - c < LEAF)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k))
        return best[1]

    def score(self, x):
        import numpy as np

        bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        total = np.full(len(x), self.base)
        for tree, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for k in sorted(tree):
                j, b = tree[k]
                here = node == k
                node[here] = 2 * k + 1 + (bins[here, j] > b)
            table = np.zeros(1 << (DEPTH + 1))
            for k, v in values.items():
                table[k] = v
            total += table[node]
        return 1 / (1 + np.exp(-total))


class UrlModel:
    #: (k, suffix, bad, n) of all labelled urls, which judge() joins to every url.
    counts: DataFrame | None = None

    def __init__(self, urls: Sequence[str | None], labels: Sequence[int], seen: dict | None = None, prior: float | None = None):
        import numpy as np

        hosts = [split_url(u)[0] for u in urls]
        self.statistics, self.trees = SuffixStatistics(hosts, labels, seen, prior), None
        self.always = 1.0 if labels and all(labels) else 0.0
        if 0 < sum(labels) < len(labels):
            x = np.array([lexical(u) + self.statistics.shares(h, y) for u, h, y in zip(urls, hosts, labels)])
            self.trees = Trees().fit(x, np.array(labels, float))

    def score(self, urls: Sequence[str | None], counts: Sequence | None = None) -> list[float]:
        """Chance of a block, per url. counts: those of each url's suffixes."""
        import numpy as np

        if self.trees is None or not len(urls):
            return [self.always] * len(urls)
        x = np.array([lexical(u) + self.statistics.shares(split_url(u)[0], None, c) for u, c in zip(urls, counts or repeat(None))])
        return self.trees.score(x).tolist()


def seed_label(url: Column, terms: Sequence[str] = BAD_TERMS) -> Column:
    """1 if a host label has one of the terms between hyphens, else 0: labels to train on where no others are given."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))
    return F.arrays_overlap(F.split(found, r"[.-]"), F.array(*map(F.lit, terms))).cast("int")


def text_of(url: bytes | None) -> str | None:
    return None if url is None else url.decode("utf-8", "replace")


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(k, suffix, bad, n) over all rows of (url, label)."""

    def run(urls, labels):
        rows = [(k, s, y) for u, y in zip(urls, labels) for k, s in enumerate(suffixes(split_url(text_of(u))[0]))]
        return tuple(zip(*rows)) if rows else ((),) * 3

    each = emit(labelled, ["url", "label"], run, "k int, suffix string, label long")
    return materialise(each.groupBy("k", "suffix").agg(F.sum("label").alias("bad"), F.count("*").alias("n")), "suffixes")


def train(labelled: DataFrame, url: str = "url", label: str = "label", sample: int = SAMPLE) -> UrlModel:
    """Fit on the `sample` labelled urls with the smallest hashes; suffixes are counted over all of them."""
    few = labelled.select(quoted(url).alias("url"), quoted(label).cast("int").alias("label")).filter("label IS NOT NULL").distinct()
    counts = suffix_counts(few)
    n = few.count()
    # of many urls only those below a hash that leaves half as many again as needed go on to be sorted
    least = -(1 << 63) + int((1 << 64) * min(1.0, 1.5 * sample / max(1, n)))
    some = few.filter(F.xxhash64("url") < F.lit(min(least, (1 << 63) - 1))) if n > 2 * sample else few
    order = (F.xxhash64("url"), "url", "label")
    rows = some.orderBy(*order).limit(sample).collect()
    if n > 2 * sample and len(rows) < sample:
        rows = few.orderBy(*order).limit(sample).collect()
    urls, labels = [r[0] for r in rows], [r[1] for r in rows]
    wanted = sorted({x for u in urls for x in enumerate(suffixes(split_url(u)[0]))})
    there = counts.join(F.broadcast(labelled.sparkSession.createDataFrame(wanted, "k int, suffix string")), ["k", "suffix"], "left_semi").collect()
    total = counts.filter("k = 0").agg(F.sum("bad"), F.sum("n")).first()
    model = UrlModel(urls, labels, {(r.k, r.suffix): [r.bad, r.n] for r in there}, (total[0] or 0) / (total[1] or 1))
    model.counts = counts
    return model


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", keep: Sequence[str] | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and score (the model's, also where a rule decides)."""
    counts, keep, found = model.counts, pages.columns if keep is None else list(keep), []
    bare = copy(model)
    bare.counts = None
    held = pages.sparkSession.sparkContext.broadcast((bare, Rules(rules)))
    if counts is not None:
        named = lambda urls: tuple(zip(*(suffixes(split_url(text_of(u))[0]) for u in urls))) if urls else ((),) * 3
        pages = annotate(pages, [url], named, "_suffix0 string, _suffix1 string, _suffix2 string", list(dict.fromkeys([*keep, url])))
        for k in range(3):
            part = counts.filter(F.col("k") == k).select(F.col("suffix").alias(f"_suffix{k}"), F.col("bad").alias(f"_bad{k}"), F.col("n").alias(f"_n{k}"))
            pages = pages.join(maybe_broadcast(part), f"_suffix{k}", "left")
            found += [f"_bad{k}", f"_n{k}"]

    def run(urls, *seen):
        trained, known = held.value
        urls = [text_of(u) for u in urls]
        known_counts = [[(x[2 * k] or 0, x[2 * k + 1] or 0) for k in range(3)] for x in zip(*seen)] if seen else None
        parts = [split_url(u) for u in urls]
        fits, scores = [known.find(*p) for p in parts], trained.score(urls, known_counts)
        verdicts = [f[1] if f else "block" if s >= THRESHOLD else "allow" for f, s in zip(fits, scores)]
        return [h for h, _ in parts], [p for _, p in parts], [f[0] if f else None for f in fits], verdicts, scores

    return annotate(pages, [url, *found], run, "host string, path string, rule string, verdict string, score double", keep)
