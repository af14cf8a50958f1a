"""Quality rules by compression bands.

A text's zstandard ratio (raw over compressed bytes) is compared with a band for its length: above it the text is
repetitive, below it incompressible. Long texts are also cut into fixed chunks, each held against the band of chunks of
its length; a text with more than half of its chunks outside goes. Plain counts (symbols, repeated lines, repeated
three-word windows) give the base rules.

The bands come from the documents themselves: for each half octave of lengths the quartiles of the ratios of all distinct
texts (chunks) that pass the base rules, widened by FENCE times their distance. The fixed BANDS and CHUNK_BAND bound
them, and hold alone where fewer than LEAST texts (chunks) have such a length.

Nulls count as empty texts; an empty text has no words and fails. Repeated rows are judged alike, and count once for the
bands. Texts are read whole, however long. A ratio on a limit is within it. An empty table gives an empty result. Other
columns stay (annotate) or are left out (the query); one with the name of a computed column gives way to it.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tensorweft.llm.common import annotate, emit

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
#: (bytes below, lowest ratio, highest ratio), the widest that bands from documents get.
BANDS = ((512, 1.10, 2.8), (1024, 1.25, 3.2), (4096, 1.40, 3.8), (16384, 1.55, 4.5), (None, 1.65, 6.0))
CHUNK_BYTES = 4096
CHUNK_BAND = (1.35, 4.5)
#: Where a length class of a band from documents ends; bytes.
EDGES = tuple(math.ceil(2 ** (c / 2)) for c in range(80))
#: Quartile distances that a band goes beyond the quartiles; texts that a class needs; least quartile distance as a share of the median.
FENCE, LEAST, NARROWEST = 2.0, 50, 0.03
#: Steps of a ratio of 1 that quartiles are told by; ratios from TOP on count as it.
STEPS, TOP = 1024, 8
#: A last chunk shorter than this isn't judged.
CHUNK_LEAST = 1024
MAX_BAD_CHUNKS = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"


def repeat_words(words: Sequence[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    times, hit = Counter(windows), bytearray(len(words))
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit[i] = hit[i + 1] = hit[i + 2] = 1
    return sum(hit)


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def band(size: int, bands=BANDS) -> tuple[float, float]:
    return next((low, high) for below, low, high in bands if below is None or size < below)


def pieces(text: bytes, chunk: int = CHUNK_BYTES) -> list[bytes]:
    """The chunks of a text that are judged."""
    if len(text) <= chunk:
        return []
    return [piece for i in range(0, len(text), chunk) if len(piece := text[i : i + chunk]) >= CHUNK_LEAST]


def compression(text: bytes, compressor, bands=BANDS, chunk: int = CHUNK_BYTES, chunk_bands=((None, *CHUNK_BAND),)) -> tuple[bool, float, float]:
    """(within the bands, ratio of the whole, share of chunks outside theirs)"""
    if not text:
        return False, 0.0, 0.0
    ratio = len(text) / len(compressor.compress(text))
    low, high = band(len(text), bands)
    bad, judged = 0, pieces(text, chunk)
    for piece in judged:
        least, most = band(len(piece), chunk_bands)
        bad += not least <= len(piece) / len(compressor.compress(piece)) <= most
    share = bad / len(judged) if judged else 0.0
    return low <= ratio <= high and share <= MAX_BAD_CHUNKS, ratio, share


def base(text: bytes) -> tuple[int, int, bool]:
    """(words, words in repeated windows, whether the base rules reject the text)"""
    words = text.split()
    repeated = repeat_words(words)
    return len(words), repeated, len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * len(words)


def judge(text: bytes | None, compressor, bands=BANDS, chunk: int = CHUNK_BYTES, chunk_bands=((None, *CHUNK_BAND),)) -> tuple:
    text = text or b""
    dense = text.translate(None, WHITE)
    chars = len(dense.decode("utf-8", "replace"))
    n_words, repeated, failed = base(text)
    fits, ratio, share = compression(text, compressor, bands, chunk, chunk_bands)
    return n_words, chars, len(dense) - len(dense.translate(None, SYMBOLS)), duplicate_lines(text), repeated, failed, fits and not failed, ratio, share


def widened(found: dict[int, tuple[float, float, float]], fixed) -> tuple:
    """Bands by length class from quartiles of ratios; the fixed bands where a class has none."""
    out = []
    for c, (start, below) in enumerate(zip(EDGES, EDGES[1:])):
        low, high = band(start, fixed)
        if c in found:
            first, middle, third = found[c]
            room = FENCE * max(third - first, NARROWEST * middle)
            low, high = max(low, first - room), min(high, third + room)
        out.append((below, low, high))
    return (*out, (None, *band(EDGES[-1], fixed)))


def bands_of(docs: DataFrame, text: str = "text", chunk: int = CHUNK_BYTES, level: int = 3) -> tuple[tuple, tuple]:
    """(bands of texts, bands of chunks), from the ratios of all distinct texts that pass the base rules; one pass.

    Ratios are counted by steps of 1 / STEPS, up to TOP, so the quartiles are exact ones of counts: the same on every run
    and any partitioning. A length class has STEPS x TOP counts at most.
    """

    def run(texts):
        import xxhash
        import zstandard

        compressor, rows = zstandard.ZstdCompressor(level=level), []
        for t in texts:
            if t and not base(t)[2]:
                for kind, piece in [(0, t), *((1, x) for x in pieces(t, chunk))]:
                    rows.append((kind, bisect_right(EDGES, len(piece)) - 1, len(piece) / len(compressor.compress(piece)), int.from_bytes(xxhash.xxh64_digest(piece), "big", signed=True)))
        return tuple(zip(*rows)) if rows else ((),) * 4

    ratios = emit(docs, [text], run, "kind long, class long, ratio double, text long").distinct()
    steps = ratios.groupBy("kind", "class", F.floor(F.least("ratio", F.lit(TOP)) * STEPS).alias("step")).agg(F.count("*").alias("times"))
    each = Window.partitionBy("kind", "class")
    counted = steps.withColumn("n", F.sum("times").over(each)).withColumn("upto", F.sum("times").over(each.orderBy("step"))).filter(F.col("n") >= LEAST)
    at = [F.min(F.when(F.col("upto") * 4 >= F.col("n") * k, F.col("step"))) / STEPS for k in (1, 2, 3)]
    spread = counted.groupBy("kind", "class").agg(F.array(*at).alias("q")).collect()  # a row a length class
    return tuple(widened({r["class"]: tuple(r["q"]) for r in spread if r["kind"] == kind}, fixed) for kind, fixed in ((0, BANDS), (1, ((None, *CHUNK_BAND),))))


def quality(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None, bands=None, chunk: int = CHUNK_BYTES, level: int = 3) -> DataFrame:
    """docs with the counts, the two verdicts and the ratios of each text.

    bands: (bands of texts, bands of chunks), those of docs (bands_of) if None.
    """
    whole, parts = bands_of(docs, text, chunk, level) if bands is None else bands

    def run(texts):
        import zstandard

        compressor = zstandard.ZstdCompressor(level=level)
        rows = [judge(t, compressor, whole, chunk, parts) for t in texts]
        return list(zip(*rows)) if rows else [[]] * 9

    return annotate(docs, [text], run, FIELDS, keep)
