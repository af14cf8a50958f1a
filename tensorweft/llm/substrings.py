"""Substring dedup by level-wise doubling.

Levels are word lengths, each at most twice the one before, up to the target (7 and 13 words for a target of 13) and, if
asked for, on past it (26, 52, ...) until no candidate survives. Windows that are repeated at one level alone are
extended to the next:

* The first level keeps, of every run of target-length windows, the sub-window with the smallest hash. Two equal windows
  of the target length choose the same sub-window, so a window whose choice has no second occurrence can't be repeated;
  a quarter of the positions stands for all.
* At the target level only windows with a repeated choice are hashed (in two 64-bit halves) and met with the smallest doc_id that
  has them; a window with a smaller document than its own is a repeat.
* Past the target a window is its two repeated halves.

Hot passages meet as partial sums (smallest and count) first; the way back is a join that Spark may split by rows.
Documents are told apart by doc_id: rows of one id don't remove each other, repeated rows lose the same words. Rows
without an id neither remove nor lose; ids are integers, and others are refused. Null texts have no words. A text without
a window of the target length stays; texts are read whole, however long. An empty table gives an empty result. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorweft.llm.common import annotate, discard, emit, materialise, quoted

TARGET = 13
#: Ranges of window hashes that are met one after the other.
PARTS = 4


def levels(target: int, start: int | None = None) -> list[int]:
    """Lengths from about half the target up, each at most twice the one before."""
    out = [target]
    while out[0] > (start or max(1, (target + 1) // 2)):
        out.insert(0, (out[0] + 1) // 2)
    return out


#: Space and the control characters 9 to 13 part words.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


class Hasher:
    """Hashes of any run of words of many texts from running sums over their bytes.

    The texts' bytes, white space made one space a word, are looked up in a table of random longs, weighted by powers of
    an odd number and summed up; the sum between two places, shifted to its start, is the run's hash. Two tables and
    numbers give two 64-bit halves.
    """

    def __init__(self):
        import numpy as np

        rng = np.random.default_rng(20)
        self.white = np.zeros(256, bool)
        self.white[list(WHITE)] = True
        self.tables = [rng.integers(0, 1 << 64, 256, dtype=np.uint64) for _ in range(2)]
        self.bases = [int(x) * 8 + 3 for x in rng.integers(1, 1 << 60, 2)]
        self.powers: list = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2

    def powers_to(self, half: int, n: int):
        import numpy as np

        up, down = self.powers[half]
        if len(up) < n:
            base = self.bases[half] % (1 << 64)
            size = max(n, (1 << 20) + 64)
            grown = []
            for x in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, x, np.uint64)
                steps[0] = 1
                grown.append(np.multiply.accumulate(steps))
            up, down = self.powers[half] = tuple(grown)
        return up, down


class Texts:
    """Texts as one array of words: bytes with a space behind each word, the words' starts and ends, and their texts'."""

    def __init__(self, hasher: Hasher, texts: Sequence[bytes | None]):
        import numpy as np

        self.hasher = hasher
        whole = np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]), np.uint8)
        white = hasher.white[whole]
        keep = ~white
        keep[1:] |= ~white[:-1]
        self.bytes = whole[keep]
        gaps = white[keep]
        self.bytes[gaps] = 0x20
        self.ends = np.flatnonzero(gaps)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])[: len(self.ends)]
        limits = np.cumsum([len(t or b"") + 1 for t in texts]) - 1
        before = np.cumsum(keep)[limits] if len(limits) else np.zeros(0, np.int64)
        #: first[i]: the number of words before text i; the last: of all.
        self.first = np.concatenate([[0], np.searchsorted(self.ends, before, side="left")])
        self.counts = np.diff(self.first)
        self.sums: list = [None, None]

    def hashes(self, length: int, half: int = 0):
        """Of every run of `length` words, also those that cross from a text to the next (see inside)."""
        import numpy as np

        up, down = self.hasher.powers_to(half, len(self.bytes) + 1)
        if self.sums[half] is None:
            sums = np.zeros(len(self.bytes) + 1, np.uint64)
            np.cumsum(self.hasher.tables[half][self.bytes] * up[: len(self.bytes)], out=sums[1:])
            self.sums[half] = sums
        n = len(self.ends) - length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        sums, starts = self.sums[half], self.starts[:n]
        out = (sums[self.ends[length - 1 :]] - sums[starts]) * down[starts]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        return out

    def owners(self, n: int):
        """The text of each of the first n words."""
        import numpy as np

        return np.repeat(np.arange(len(self.counts)), self.counts)[:n]

    def inside(self, length: int, owners):
        """Whether the run of `length` words from each word on ends in the word's text."""
        import numpy as np

        return np.arange(len(owners)) + length <= self.first[1:][owners]


#: Factors that keep equal hashes of different texts of a slice apart.
APART = (0xD1B54A32D192ED03, 0xABC98388FB8FAC03)


def apart(hashes, owners, half: int = 0):
    import numpy as np

    return hashes + owners.astype(np.uint64) * np.uint64(APART[half])


def least_in_window(x, span: int):
    """The smallest of each `span` neighbours, by minima over doubled spans."""
    import numpy as np

    have = 1
    while have < span:
        step = min(have, span - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def text_words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def changes(*columns):
    """Where a row of sorted or running columns differs from the one before."""
    import numpy as np

    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def _choices(target: int, length: int):
    hasher: list[Hasher] = []

    def run(texts, ids):
        """The chosen sub-windows, once for each text."""
        import numpy as np

        hasher or hasher.append(Hasher())
        t = Texts(hasher[0], texts)
        least = least_in_window(t.hashes(length), target - length + 1)
        owners = t.owners(len(least))
        at = np.flatnonzero(t.inside(target, owners) & changes(least, owners))
        order = np.argsort(least[at], kind="stable")
        order = np.sort(order[changes(least[at][order], owners[at][order])])  # in the texts' order: ids are stored in runs
        at = at[order]
        return least[at].view(np.int64), np.array(ids, np.int64)[owners[at]]

    return run


def _extended(target: int, length: int, parts: int):
    hasher: list[Hasher] = []

    def run(texts, ids, marked):
        """The target-length windows whose choice is marked, once for each text."""
        import numpy as np

        hasher or hasher.append(Hasher())
        t = Texts(hasher[0], texts)
        least = least_in_window(t.hashes(length), target - length + 1)
        owners = t.owners(len(least))
        wanted = apart(np.concatenate([np.asarray(m, np.int64) for m in marked] or [np.empty(0, np.int64)]).view(np.uint64), np.repeat(np.arange(len(marked)), [len(m) for m in marked]))
        runs = np.flatnonzero(changes(least, owners))
        live = np.repeat(np.isin(apart(least[runs], owners[runs]), wanted), np.diff(np.append(runs, len(least))))
        at = np.flatnonzero(live & t.inside(target, owners))
        a, b = t.hashes(target)[at], t.hashes(target, 1)[at]
        order = np.argsort(a, kind="stable")
        order = np.sort(order[changes(a[order], b[order], owners[at][order])])
        a, b = a[order], b[order]
        return a.view(np.int64), b.view(np.int64), np.array(ids, np.int64)[owners[at][order]], (a >> np.uint64(40)) % np.uint64(parts)

    return run


def checked(docs: DataFrame, doc_id: str) -> None:
    if docs.schema[doc_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{doc_id} must be a column of integers, whose order says which document keeps a passage")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", target: int = TARGET) -> DataFrame:
    """(doc_id, high, low): for each document with any, the hashes of its target-length windows that a smaller one has.
    """
    length = levels(target)[-2] if target > 1 else 1
    checked(docs, doc_id)
    named = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    choices = emit(named, ["text", "doc_id"], _choices(target, length), "anchor long, doc_id long")
    choices = materialise(choices, "choices")
    twice = choices.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")  # a row a document, as a rule
    marked = choices.join(twice.hint("shuffle_hash"), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    marked = materialise(marked, "marked")
    discard(choices)
    live = named.join(marked.hint("shuffle_hash"), "doc_id")
    windows = materialise(emit(live, ["text", "doc_id", "anchors"], _extended(target, length, PARTS), "high long, low long, doc_id long, part int"), "windows", by="part")
    discard(marked)
    parts = []
    for k in range(PARTS):  # by ranges of the hash, so that the shuffles of one range at a time are on disk
        some = windows.filter(F.col("part") == k).drop("part")
        least = some.groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("high", "low", "least")
        later = some.join(least.hint("shuffle_hash"), ["high", "low"]).filter("least < doc_id")
        parts.append(materialise(later.groupBy("doc_id").agg(F.collect_list(F.struct("high", "low")).alias("windows")), f"repeats-{k}"))
    discard(windows)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    found = found.groupBy("doc_id").agg(F.flatten(F.collect_list("windows")).alias("windows"))
    return found.select("doc_id", F.col("windows.high").alias("high"), F.col("windows.low").alias("low"))


def _cut(target: int, texts_too: bool):
    hasher: list[Hasher] = []

    def run(texts, highs, lows):
        import numpy as np

        hasher or hasher.append(Hasher())
        t = Texts(hasher[0], texts)
        keep = np.ones(len(t.ends), bool)
        sizes = [0 if h is None else len(h) for h in highs]
        if any(sizes):
            whose = np.repeat(np.arange(len(sizes)), sizes)
            high, low = (apart(np.concatenate([x for x in half if x is not None]).view(np.uint64), whose, k) for k, half in enumerate((highs, lows)))
            order = np.argsort(high, kind="stable")
            high, low = high[order], low[order]
            a, b = t.hashes(target), t.hashes(target, 1)
            owners = t.owners(len(a))
            a, b, hit = apart(a, owners), apart(b, owners, 1), np.zeros(len(a), bool)
            place = np.searchsorted(high, a, side="left")
            left = np.flatnonzero(t.inside(target, owners))
            while len(left):  # entries with one high half stand side by side; as a rule there is one
                left = left[place[left] < len(high)]
                left = left[high[place[left]] == a[left]]
                hit[left] |= low[place[left]] == b[left]
                place[left] += 1
            change = np.zeros(len(keep) + 1, np.int64)
            starts = np.flatnonzero(hit)
            change[starts] += 1
            change[starts + target] -= 1
            keep = change.cumsum()[:-1] == 0
        sizes = t.ends - t.starts + 1
        kept = t.bytes[np.repeat(keep, sizes)].tobytes()
        total = np.concatenate([[0], np.cumsum(np.where(keep, sizes, 0))])[t.first].tolist()
        gone = np.concatenate([[0], np.cumsum(~keep)])[t.first]
        lines = [kept[x : max(x, y - 1)] for x, y in zip(total, total[1:])]
        out = t.counts, np.diff(gone), [hashlib.sha256(x).hexdigest() for x in lines]
        return (*out, [x.decode("utf-8", "replace") for x in lines]) if texts_too else out

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", target: int = TARGET, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]), a row for each row of docs: the words of repeats cut out."""
    found = repeats(docs, doc_id, text, target)
    named = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    both = named.join(found.withColumnRenamed("doc_id", "_id").hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("_id"), "left")
    ddl = "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return annotate(both, ["text", "high", "low"], _cut(target, texts), ddl, ["doc_id"])


def doubled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", target: int = TARGET) -> DataFrame:
    """(length, n_windows, n_docs): from the target on, how many distinct windows two documents or more share.

    Each length is twice the one before; the loop ends where no candidate survives.
    """
    named = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    hasher: list[Hasher] = []

    def places(texts, ids):
        import numpy as np

        hasher or hasher.append(Hasher())
        t = Texts(hasher[0], texts)
        a = t.hashes(target)
        owners = t.owners(len(a))
        at = np.flatnonzero(t.inside(target, owners))
        owners = owners[at]
        return a[at].view(np.int64), t.hashes(target, 1)[at].view(np.int64), np.array(ids, np.int64)[owners], at - t.first[owners]

    now = emit(named, ["text", "doc_id"], places, "high long, low long, doc_id long, pos long")
    length, result = target, []
    while True:
        often = now.groupBy("high", "low").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("high", "low")
        now = materialise(now.join(often, ["high", "low"]), f"level-{length}")
        if now.isEmpty():
            break
        result.append(now.agg(F.lit(length).cast("long").alias("length"), F.countDistinct("high", "low").alias("n_windows"), F.countDistinct("doc_id").alias("n_docs")))
        second = now.select(F.col("high").alias("h2"), F.col("low").alias("l2"), "doc_id", (F.col("pos") - length).alias("pos")).distinct()
        now = now.distinct().join(second, ["doc_id", "pos"]).select(F.xxhash64("high", "low", "h2", "l2").alias("high"), F.xxhash64("low", "h2", "l2", "high").alias("low"), "doc_id", "pos")
        length *= 2
    if not result:
        return named.sparkSession.createDataFrame([], "length long, n_windows long, n_docs long")
    out = result[0]
    for r in result[1:]:
        out = out.unionAll(r)
    return out
