"""Benchmark decontamination with a broadcast set of normalised n-grams.

Words are runs of ASCII letters and digits (A-Z lowered) and of all characters beyond ASCII. Every 10 consecutive words
of an item are a window, an item of fewer words is one window. The windows' words are numbered; a text's words become
these numbers (0: in no window), rolling sums look up all its windows in a bit table, and every hit is verified by the
numbers themselves, so no hash decides.

The broadcast tables' size follows the benchmark, not the corpus, and is checked: items are dealt into blocks of about
BLOCK_BYTES, each a broadcast of its own. The texts are read once; a slice of them meets the blocks one after the other.

Null and empty texts have no words: no hits, not contaminated. Items without words have no window. Repeated items and
rows count once and each. Texts are read whole, however long. Empty tables give empty results, or no hits. A null item_id marks words but is not listed. A column named as a computed one gives way.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorweft.llm.common import SLICE_BYTES, annotate, quoted

WINDOW = 10
#: Bytes of item texts whose windows are broadcast at once: about 600,000 windows, 150 MB in a worker.
BLOCK_BYTES = 4 << 20
FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Byte to byte: A-Z lowered, word bytes kept, others a space.
TABLE = bytes(b if b in _WORD else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


class Windows:
    """The windows of a block of items, by length: a bit table of rolling sums and the exact windows behind it."""

    BITS = 22

    def __init__(self, items: Sequence[tuple[object, bytes | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        #: Length to windows (their words' numbers as bytes) to the items that have them.
        self.exact: dict[int, dict[bytes, tuple]] = {}
        for item, text in items:
            numbers = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            if not numbers:
                continue
            size, row, own = min(window, len(numbers)), array("Q", numbers), (item,)
            known = self.exact.setdefault(size, {})
            for i in range(len(numbers) - size + 1):
                before = known.setdefault(row[i : i + size].tobytes(), own)
                if item not in before:
                    known[row[i : i + size].tobytes()] = (*before, item)
        self.tables = None

    def prepare(self) -> None:
        import numpy as np

        rng = np.random.default_rng(7)
        self.weights = (rng.integers(1, 1 << 62, max(self.exact, default=1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.tables = {}
        for size, windows in self.exact.items():
            rows = np.frombuffer(b"".join(windows), np.uint64).reshape(-1, size)
            bits = np.zeros(1 << self.BITS, bool)
            bits[(rows * self.weights[:size]).sum(axis=1, dtype=np.uint64) >> np.uint64(64 - self.BITS)] = True
            self.tables[size] = bits

    def find(self, numbers) -> list[tuple[int, int, tuple]]:
        """(start, length, items) of all windows in a sequence of word numbers."""
        import numpy as np

        if self.tables is None:
            self.prepare()
        found = []
        for size, bits in self.tables.items():
            n = len(numbers) - size + 1
            if n <= 0:
                continue
            sums = numbers[:n] * self.weights[0]
            for k in range(1, size):
                sums += numbers[k : k + n] * self.weights[k]
            exact = self.exact[size]
            for i in np.flatnonzero(bits[sums >> np.uint64(64 - self.BITS)]).tolist():
                if (items := exact.get(numbers[i : i + size].tobytes())) is not None:
                    found.append((i, size, items))
        return found


def scan(texts: Sequence[bytes | None], windows: Windows) -> list[tuple[int, bytearray, set]]:
    """Per text: its number of words, a mark for each hit word, the items that hit. One rolling pass for all texts."""
    import numpy as np

    out, numbers, starts = [], [], []
    number = windows.ids.get
    for t in texts:
        starts.append(len(numbers))
        words = words_of(t)
        numbers.extend([number(w, 0) for w in words])
        numbers.append(0)  # no window crosses from a text to the next
        out.append((len(words), bytearray(len(words)), set()))
    whole = np.array(numbers, dtype=np.uint64)
    starts = np.array(starts, dtype=np.int64)
    for i, size, items in windows.find(whole):
        at = int(np.searchsorted(starts, i, side="right")) - 1
        _, marks, names = out[at]
        i -= int(starts[at])
        marks[i : i + size] = b"\x01" * size
        names.update(items)
    return out


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(str(x) for x in items if x is not None)).encode()).hexdigest()


def held_blocks(docs: DataFrame, benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> list:
    """The items' windows as broadcasts of about block_bytes of item texts each; an item is in one block.

    The items pass the driver a block at a time; workers hold one block at a time as well.
    """
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    out = []
    for i in range(n):
        some = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect()
        out.append(docs.sparkSession.sparkContext.broadcast(Windows([(r[0], r[1].encode() if r[1] is not None else None) for r in some], window)))
    return out


def scan_all(texts: Sequence[bytes | None], held: Sequence) -> list[tuple[int, bytes, set]]:
    """Per text: its number of words, the marks and the items that hit, over all blocks."""
    out: list = []
    for block in held:
        found = scan(texts, block.value)
        if len(held) > 1 and hasattr(block, "_value"):
            del block._value  # read again when its turn comes, so that one block is in memory
        out = found if not out else [(n, bytes(x | y for x, y in zip(a, b)) if any(b) else a, s | t) for (n, a, s), (_, b, t) in zip(out, found)]
    return out


def slice_of(held: Sequence) -> int:
    """Bytes of texts at a time: with many blocks, more for each time that they are read."""
    return SLICE_BYTES if len(held) == 1 else 32 * SLICE_BYTES


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: Sequence[str] | None = None) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated; one pass over the texts, no shuffle."""
    held = held_blocks(docs, benchmark, item_id, item_text, window, block_bytes)

    def run(texts):
        found = scan_all(texts, held)
        hits = [sum(marks) for _, marks, _ in found]
        return [n for n, _, _ in found], hits, [len({str(x) for x in s if x is not None}) for _, _, s in found], [digest(s) for _, _, s in found], [h > 0 for h in hits]

    return annotate(docs, [text], run, FIELDS, docs.columns if keep is None else list(keep), slice_of(held))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the words that any item hits cut out of their texts, white space around a cut made one space."""
    import re

    held, order = held_blocks(docs, benchmark, item_id, item_text, window, block_bytes), docs.columns
    word, kind = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), docs.schema[text].dataType.simpleString()

    def cut(texts):
        out = []
        for t, (_, marks, _) in zip(texts, scan_all(texts, held)):
            if any(marks):
                parts, last = [], 0
                for m, hit in zip(word.finditer(t), marks):
                    if hit:
                        parts.append(t[last : m.start()])
                        last = m.end()
                t = re.sub(rb" {2,}", b" ", b"".join([*parts, t[last:]]))
            out.append(None if t is None else t.decode())
        return [out]

    return annotate(docs, [text], cut, f"`{text}` {kind}", [c for c in order if c != text], slice_of(held)).select(*map(quoted, order))
