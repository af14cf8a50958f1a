"""Personal data by weak supervision, in DataFrame functions only.

Base spans are fixed patterns of four kinds. Beside them looser patterns give candidates (national phone numbers,
security numbers, disguised emails, names behind a title or an introduction). Base spans and candidates alike get votes:
a regex labeler (is the shape that of a valid one), a gazetteer (known top-level domains, country codes, issuers, given
names), a context labeler (words before it), an edge labeler (does it touch other word characters) and a variety labeler
(all digits alike). A vote is -1, 0 (abstains) or 1.

Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability and each pattern's
chance to be personal data. A logistic span classifier is then trained on these chances with features that no labeler
sees: the word before the span (one of WORDS buckets by hash), its separators, its kind with either, and its size, beside
the votes. So a span on which the labelers are split goes with those of like form and neighbourhood. The counts are a
table of bounded size (kinds x 3^5 patterns x 4 sizes x 16 separators x WORDS), whatever the corpus, so both fits are
plain arithmetic on the driver. The classifier is applied as a column expression: candidates it accepts that touch no base
span are added. Base spans stay in any case.

Positions are code points. Match positions come from the pieces between the matches: text split by a pattern, zipped
with what it matched, and summed up. All patterns are such that Java matches them without recursion and in linear time,
and equal the plain ones they stand for. Null and empty texts have no spans; long texts are matched whole. Repeated rows
are judged alike. An empty table gives an empty result. Other columns stay (redact), whatever their names, or aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorweft.llm.common import materialise, quoted

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "name")

#: Starts are held to where a run of the class starts, or the match before ended: elsewhere no match can start.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
NATIONAL = r"(?<![0-9+.])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DISGUISED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}"
NAME = r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Madame|Monsieur|Sr|Sra|my name is|je m'appelle|ich heiße|me llamo)\.? \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30}){0,2}"

# Gazetteers: fixed public values, in natural order.
TOP_DOMAINS = ("at", "be", "biz", "br", "ca", "ch", "cn", "co", "com", "de", "dk", "edu", "es", "eu", "fi", "fr", "gov", "ie", "in", "info", "io", "it", "jp", "mx", "net", "nl", "no", "org", "pl", "pt", "ru", "se", "uk", "us")
COUNTRY_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98", "212", "213", "351", "352", "353", "354", "358", "380")
GIVEN_NAMES = ("Alice", "Andrea", "Anna", "Antonio", "Carlos", "Carmen", "Claude", "David", "Elena", "Emma", "Eva", "Hans", "James", "Jan", "Jean", "John", "Jorge", "José", "Juan", "Karl", "Laura", "Luis", "Maria", "María", "Marie", "Mary", "Michael", "Michel", "Olga", "Paul", "Peter", "Pierre", "Robert", "Sarah", "Sophie", "Stefan", "Susan", "Thomas", "William")
CUES = r"(?:mail|contact|write to|call|phone|tel|fax|mobile|handy|rufen|llame|appelez|card|visa|mastercard|amex|karte|carte|tarjeta|\bip\b|address|adresse|host|server|ssn|social security|name|named|mr|mrs|dr)[^\n]{0,20}$"
ANTI_CUES = r"(?:isbn|issn|version|release|figure|table|page|chapter|section|invoice|order|article|part no|model|build|sha|id)[ #:.]{0,4}$"

LABELERS = ("regex", "gazetteer", "context", "edge", "variety")
SIZES = (8, 16, 24)
ROUNDS = 50
SPAN = "array<struct<start:int,end:int,text:string>>"
CANDIDATE = "array<struct<kind:string,start:int,end:int,votes:int,size:int,marks:int,word:int>>"
#: Separators that a span may have, a bit each; buckets of words before it, 0 for none.
SEPARATORS = ("(", "-", ".", " ")
WORDS = 16


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    d = digits(m)
    digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    twice = lambda x: 2 * x - F.when(x > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + F.when((F.length(d) - i) % 2 == 1, twice(digit(i))).otherwise(digit(i)))
    return F.when(F.length(m) >= 13, F.when(F.length(d).between(13, 19), total % 10 == 0)).otherwise(False)


def octets(m: Column) -> Column:
    return F.forall(F.split(m, "[.]"), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))


def phone_digits(m: Column) -> Column:
    return F.length(digits(m)).between(9, 15)


def found(text: Column, pattern: str, guard: Column, valid=lambda m: F.lit(True)) -> Column:
    """The valid matches of pattern, leftmost and not overlapping, with their places."""
    none = F.array().cast(SPAN)
    zipped = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text"))).cast(SPAN)
        return F.struct(end.alias("at"), F.when(F.coalesce(x["m"].isNotNull() & valid(x["m"]), F.lit(False)), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(guard, F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])).otherwise(none)


def vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(no, F.lit(False)), -1).when(F.coalesce(yes, F.lit(False)), 1).otherwise(0)


def votes(kind: str, loose: bool, text: Column, s: Column) -> Column:
    """The vote pattern of a span as a number to base three, the regex labeler's digit first."""
    m, none = s["text"], F.lit(False)
    d = digits(m)
    tail = F.lower(F.substring_index(F.regexp_replace(m, r"[\])\[( ]|dot", "."), ".", -1))
    shape, known = {
        "email": (vote(tail.rlike("^[a-z]{2,24}$"), ~tail.rlike("^[a-z]{2,24}$")), vote(tail.isin(*TOP_DOMAINS), none)),
        "ip": (vote(~m.rlike(r"(?:^|\.)0[0-9]"), m.rlike(r"(?:^|\.)0[0-9]") | m.startswith("0.")), vote(~m.rlike(r"^(?:0|127|255)\."), m.rlike(r"^(?:0|127|255)\."))),
        "card": (vote(d.rlike("^[3-6]"), ~d.rlike("^[3-6]")), vote(d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), none)),
        "phone": (vote(d.rlike("^[2-9]") if loose else F.lit(True), d.rlike("^[01]") if loose else none), vote(none if loose else F.arrays_overlap(F.array(*(F.substring(d, 1, k) for k in (1, 2, 3))), F.array(*map(F.lit, COUNTRY_CODES))), none)),
        "ssn": (vote(F.lit(True), d.rlike("^(?:000|666|9)|^...00|0000$")), F.lit(0)),
        "name": (F.lit(0), vote(F.arrays_overlap(F.split(m, " "), F.array(*map(F.lit, GIVEN_NAMES))), none)),
    }[kind]
    before = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] - 39), F.least(F.lit(40), s["start"])))
    context = vote(before.rlike(CUES) if kind != "name" else m.rlike("^(?:my|je|ich|me) "), before.rlike(ANTI_CUES))
    last = F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise(F.lit(" "))
    following = F.substring(text, s["end"] + 1, F.lit(1))
    edge = vote(F.lit(True), last.rlike(r"[\p{L}0-9_]") | following.rlike(r"[\p{L}0-9_]"))
    variety = vote(F.length(F.regexp_replace(d, F.substring(d, 1, 1), "")) > 3, (F.length(d) > 6) & (F.length(F.regexp_replace(d, "^(.)\\1*$", "")) == 0)) if kind not in ("email", "name") else F.lit(0)
    total = F.lit(0)
    for v in (shape, known, context, edge, variety):
        total = total * 3 + v + 1
    return total.cast("int")


def candidates(kind: str, loose: bool, text: Column, spans: Column) -> Column:
    size = lambda s: sum(((s["end"] - s["start"]) > x).cast("int") for x in SIZES)
    marks = lambda s: sum(F.contains(s["text"], F.lit(x)).cast("int") * (1 << i) for i, x in enumerate(SEPARATORS))

    def word(s):
        before = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] - 23), F.least(F.lit(24), s["start"])))
        last = F.regexp_extract(before, r"(\p{L}+)[^\p{L}\n]{0,3}$", 1)
        return F.when(last == "", 0).otherwise(F.pmod(F.xxhash64(last), F.lit(WORDS - 1)) + 1)

    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), votes(kind, loose, text, s).alias("votes"), size(s).alias("size"), marks(s).alias("marks"), word(s).alias("word"))).cast(CANDIDATE)


def detected(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """_pii_row (a struct of the columns keep), _pii_base and _pii_more: base spans and further candidates, all with their votes."""
    t = F.coalesce(quoted(text), F.lit(""))
    plus, at, has_digit = F.contains(t, F.lit("+")), F.contains(t, F.lit("@")), t.rlike("[0-9]")
    base = {
        "email": found(t, EMAIL, at),
        "ip": found(t, IP, has_digit & t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), octets),
        "card": found(t, CARD, has_digit & t.rlike(r"[0-9](?:[ -]?[0-9]){12}"), luhn),
        "phone": found(t, PHONE, plus, phone_digits),
    }
    more = {
        ("phone", NATIONAL): has_digit & t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
        ("ssn", SSN): has_digit & t.rlike("[0-9]-[0-9]{2}-[0-9]"),
        ("email", DISGUISED): F.contains(t, F.lit("at)")) | F.contains(t, F.lit("at]")),
        ("name", NAME): t.rlike(r"(?:\.|Herr|Frau|Madame|Monsieur|Mme|Mr|Mrs|Ms|Dr|Prof|Sra?|name is|appelle|heiße|llamo) \p{Lu}") & t.rlike(NAME),
    }
    names = {k: f"_pii_{k}" for k in BASE} | {k: f"_pii_{i}" for i, k in enumerate(more)}
    spans = docs.select(F.struct(*[quoted(c) for c in keep]).alias("_pii_row"), t.alias("_pii_text"), *[v.alias(names[k]) for k, v in base.items()], *[found(t, p, guard).alias(names[k, p]) for (k, p), guard in more.items()])
    u = F.col("_pii_text")
    return spans.select(
        "_pii_row",
        F.concat(*[candidates(k, False, u, F.col(names[k])) for k in BASE]).alias("_pii_base"),
        F.concat(*[candidates(k, True, u, F.col(names[k, p])) for k, p in more]).alias("_pii_more"),
    )


def unpacked(pattern: int) -> list[int]:
    out = []
    for _ in LABELERS:
        out.insert(0, pattern % 3)
        pattern //= 3
    return out


def expectation_maximisation(counts: Sequence[tuple[str, int, int, int]], rounds: int = ROUNDS) -> tuple[list[float], list]:
    """counts: (kind, votes, ..., n). Each row's chance to be personal data, and P(vote | class) per labeler.

    Votes are taken as independent given the class, each kind has its own share of the class, counts are smoothed by one.
    """
    rows = [(k, unpacked(v), n) for k, v, *_, n in counts]
    chance = [1 / (1 + math.exp(-sum(x - 1 for x in v))) for _, v, _ in rows]
    tables: list = []
    for _ in range(rounds):
        tables = []
        for labeler in range(len(LABELERS)):
            table = [[1.0] * 3, [1.0] * 3]
            table[1][2] += 2.0  # a labeler is taken to be better than chance
            table[0][0] += 2.0
            for (_, v, n), p in zip(rows, chance):
                table[1][v[labeler]] += n * p
                table[0][v[labeler]] += n * (1 - p)
            tables.append([[x / sum(side) for x in side] for side in table])
        share: dict[str, list[float]] = {}
        for (k, _, n), p in zip(rows, chance):
            s = share.setdefault(k, [1.0, 1.0])
            s[0] += n * (1 - p)
            s[1] += n * p
        new = []
        for k, v, _ in rows:
            odds = math.log(share[k][1] / share[k][0]) + sum(math.log(t[1][x] / t[0][x]) for t, x in zip(tables, v))
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        moved = max((abs(a - b) for a, b in zip(new, chance)), default=0.0)
        chance = new
        if moved < 1e-6:
            break
    return chance, tables


class SpanClassifier:
    """Logistic regression on kind, votes (one weight per labeler and vote), size, separators and word before, on soft labels.

    counts: (kind, votes, size, marks, word, n).
    """

    def __init__(self, counts: Sequence[tuple[str, int, int, int, int, int]], rounds: int = 200, rate: float = 0.5, decay: float = 1e-3):
        # Patterns come in a fixed order, so that sums and hence results don't depend on that of the rows.
        counts = sorted(counts)
        chance, self.reliabilities = expectation_maximisation(counts)
        self.weights: dict = {}
        rows = [(self.features(*c[:-1]), p, c[-1]) for c, p in zip(counts, chance)]
        total = sum(math.sqrt(n) for *_, n in rows) or 1.0
        for _ in range(rounds):
            step: dict = {}
            for f, p, n in rows:
                error = (p - self.chance(f)) * math.sqrt(n) / total
                for x in f:
                    step[x] = step.get(x, 0.0) + error
            for x, g in step.items():
                self.weights[x] = self.weights.get(x, 0.0) * (1 - decay * rate) + rate * 4 * g

    @staticmethod
    def features(kind: str, pattern: int, size: int, marks: int, word: int) -> list:
        return [("kind", kind), ("size", size), ("marks", kind, marks), ("word", kind, word), *(("vote", i, x) for i, x in enumerate(unpacked(pattern)))]

    def chance(self, features: Sequence) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(self.weights.get(x, 0.0) for x in features)))))

    def accepts(self, c: Column) -> Column:
        """As a column expression over a candidate."""
        w = self.weights
        kinds = F.create_map(*[F.lit(x) for k in KINDS for x in (k, w.get(("kind", k), 0.0))])
        sizes = F.array(*[F.lit(w.get(("size", s), 0.0)) for s in range(len(SIZES) + 1)])
        patterns = F.array(*[F.lit(sum(w.get(("vote", i, x), 0.0) for i, x in enumerate(unpacked(p)))) for p in range(3 ** len(LABELERS))])
        place = F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).cast("int") - 1
        marks = F.array(*[F.lit(w.get(("marks", k, m), 0.0)) for k in KINDS for m in range(1 << len(SEPARATORS))])
        words = F.array(*[F.lit(w.get(("word", k, x), 0.0)) for k in KINDS for x in range(WORDS)])
        form = F.element_at(marks, place * (1 << len(SEPARATORS)) + c["marks"] + 1) + F.element_at(words, place * WORDS + c["word"] + 1)
        return F.element_at(kinds, c["kind"]) + F.element_at(sizes, c["size"] + 1) + F.element_at(patterns, c["votes"] + 1) + form >= 0


def train(detections: DataFrame) -> SpanClassifier:
    rows = detections.select(F.explode(F.concat("_pii_base", "_pii_more")).alias("c")).groupBy("c.kind", "c.votes", "c.size", "c.marks", "c.word").count()
    return SpanClassifier([tuple(r) for r in rows.collect()])


def with_spans(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """_pii_row (a struct of docs' columns, or of keep), _pii_base and _pii_spans: arrays of candidates.

    The detections are written once, so that texts are matched once for the training and the result.
    """
    held = materialise(detected(docs, text, docs.columns if keep is None else keep), "pii")
    model = train(held)
    free = F.filter("_pii_more", lambda c: model.accepts(c) & ~F.exists("_pii_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return held.select("_pii_row", "_pii_base", F.concat("_pii_base", free).alias("_pii_spans"))


def joined(spans: str) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    of = lambda k: F.array_sort(F.transform(F.filter(spans, lambda c: c["kind"] == k), lambda c: F.struct(c["start"].alias("a"), c["end"].alias("b"), F.lit(k).alias("k"))))
    return F.array_join(F.transform(F.concat(*map(of, KINDS)), lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)"""
    found_ = with_spans(docs, text, [doc_id])
    count = lambda k: F.size(F.filter("_pii_base", lambda c: c["kind"] == k)).cast("long").alias(f"n_{k}")
    return found_.select(F.col("_pii_row")[doc_id].alias("doc_id"), *map(count, BASE), F.sha2(F.encode(joined("_pii_base"), "UTF-8"), 256).alias("base_sha256"), joined("_pii_spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of a text replaced by its kind in brackets; spans that overlap are replaced together."""
    found_ = with_spans(docs, text)
    t = F.col("_pii_row")[text]
    ordered = F.array_sort(F.transform("_pii_spans", lambda c: F.struct(c["start"].alias("a"), c["end"].alias("b"), c["kind"].alias("k"))))

    def step(acc, s):
        gap = F.substring(t, acc["at"] + 1, F.greatest(F.lit(0), s["a"] - acc["at"]))
        more = F.concat(acc["out"], gap, F.lit("["), F.upper(s["k"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["b"]).alias("at"), F.when(s["a"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t)))
    clean = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    columns = [F.when(F.size("_pii_spans") > 0, clean).otherwise(t).alias(c) if c == text else F.col("_pii_row")[c].alias(c) for c in docs.columns]
    return found_.select(*columns)
