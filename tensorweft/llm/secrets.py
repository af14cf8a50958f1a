"""Secret scans: base patterns and dictionary-primed zstandard novelty.

Base kinds are fixed patterns. Beside them, a token of 16 bytes or more with letters and digits that stands just behind
a sensitive word is a candidate. Its novelty is what it adds to the compressed size of the text around it, with a
dictionary of identifiers and code words primed: natural words and identifiers add little, keys add almost themselves.
Candidates whose added share reaches NOVELTY are reported as kind novel.

Positions are code points of the text; all matching is on UTF-8 bytes with ASCII classes, which is the same for these
patterns. Null and empty texts have no spans; texts are read whole, and tokens of any length judged whole. Of spans that
start together the kinds come as listed. Repeated rows are scanned alike. An empty table gives an empty result. A column
named as a computed one gives way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tensorweft.llm.common import annotate

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Equal to runs of [0-9a-f] that have 24 characters or more.
HEX = re.compile(rb"[0-9a-f]{24,}")
_HEX_RUN = bytes(0x78 if b in b"0123456789abcdef" else 0x20 for b in range(256))
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

#: Words that make the place of a string sensitive.
SENSITIVE = (b"key", b"auth", b"bearer", b"secret", b"token", b"passw", b"passphrase", b"pwd", b"credential", b"private", b"signature", b"session", b"cookie")
CONTEXT = re.compile(rb"(?i)(?<![a-z])(?:[a-z]+[_-])?(?:api|access|secret|private|signing|encryption)?[_ -]?(?:key|auth|authorization|bearer|secret|token|password|passphrase|pwd|credentials?|signature|session|cookie)(?![a-z])")
CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
BEFORE = 48
AROUND = 256
NOVELTY = 0.7
#: Identifiers and code words that a primed compressor knows (fixed list; larger dictionaries can be passed).
DICTIONARY = (
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 authorization: bearer access_key_id secret_access_key "
    b"private_key public_key client_id client_secret session_token refresh_token cookie password username user_name api_key "
    b"connection_string database_url localhost https://www.example.com/index.html application/json content-type return function "
    b"import class public static void const let var self def print string integer boolean value config settings environment "
    b"0000000000000000 1111111111111111 xxxxxxxxxxxxxxxx placeholder changeme your_key_here example test dummy sample "
)

FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    found, low = [], text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.translate(_HEX_RUN):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


class Novelty:
    """Bytes that a string adds to its surroundings once the dictionary is primed."""

    def __init__(self, dictionary: bytes = DICTIONARY, level: int = 3):
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)

    def share(self, candidate: bytes, before: bytes, after: bytes) -> float:
        around = before + after
        return (len(self.compressor.compress(around + candidate)) - len(self.compressor.compress(around))) / len(candidate)


def novel_spans(text: bytes, base: Sequence[tuple[int, int, str]], novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, str]]:
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return []
    found = []
    places = [m.end() for m in CONTEXT.finditer(text)]
    if not places:
        return []
    from bisect import bisect_right

    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        at = bisect_right(places, a)
        if not at or a - places[at - 1] > BEFORE or any(a < y and x < b for x, y, _ in base):
            continue
        token = m.group()
        if not (re.search(rb"[0-9]", token) and re.search(rb"[A-Za-z]", token)):
            continue
        if novelty.share(token, text[max(0, a - AROUND) : a], text[b : b + AROUND]) >= least:
            found.append((a, b, "novel"))
    return found


def in_points(text: bytes, spans: Sequence[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Byte spans as code point spans, one pass over the text."""
    if not spans or text.isascii():
        return list(spans)
    at, points, last = {}, 0, 0
    for x in sorted({p for a, b, _ in spans for p in (a, b)}):
        points += len(text[last:x].decode("utf-8", "replace"))
        at[x], last = points, x
    return [(at[a], at[b], k) for a, b, k in spans]


def joined(spans: Sequence[tuple[int, int, str]]) -> str:
    order = {k: i for i, k in enumerate((*KINDS, "novel"))}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]])))


def scan(text: bytes | None, novelty: Novelty, least: float = NOVELTY) -> tuple:
    if not text:
        return 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0
    base = base_spans(text)
    more = novel_spans(text, base, novelty, least)
    counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
    points = in_points(text, [*base, *more])
    return *counts, hashlib.sha256(joined(points[: len(base)]).encode()).hexdigest(), joined(points), len(more)


def secrets(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None, dictionary: bytes = DICTIONARY, least: float = NOVELTY) -> DataFrame:
    """docs with counts of base spans, their digest, all spans and the number of novel ones; one pass, no shuffle."""

    def run(texts):
        novelty = Novelty(dictionary)
        rows = [scan(t, novelty, least) for t in texts]
        return list(zip(*rows)) if rows else [[]] * 6

    return annotate(docs, [text], run, FIELDS, keep)
