"""Personal data against plain patterns, and the weak supervision on planted votes."""

import hashlib
import re

import pytest

from tensorweft.llm import pii

from .conftest import awkward


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ):
        out.append([(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m[0])])
    return out


TEXTS = [
    "mail é a.b@c.de and x@y@z.com, a@b.c_d@e.f a@b.cc@d.ee a@b. q@w.e.r-t. %@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1.2.3 999999999999999999999.1.1.1 1.1.1.255x", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4785380592391139 5 5 5",
    "+1 (310) 555-4510 then +49 30 1234567 89 +12 +123456789012345678 ++1 234 567 890", "\n\t", None, "", "a" * 5000 + "@" + "b" * 5000 + ".com", "1-" * 20000 + "1", "1 " * 9 + "+" * 300 + "1.1.1.1" * 40, "3.3.3.3" + "9" * 4000,
    "ß@x.y 😀 a@b.c 😀 +123456789 😀 10.0.0.1", "12345678901234567890123 4111111111111111é4111111111111111", "x@" + "a." * 3000 + "b",
]


def test_base(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + k, t) for k, (_, t, *_) in enumerate(awkward())]
    by = dict(rows)
    for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        base = plain(by[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, base)), by[r.doc_id]
        line = ",".join(f"{k}:{a}:{b}" for spans in base for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) <= set(r.spans.split(","))


def test_empty_and_clashes(none, clashing):
    assert pii.report(none).count() == 0
    out = pii.redact(clashing)
    assert out.columns == clashing.columns and out.count() == len(awkward())


def test_redaction(spark):
    rows = [(1, "é a@b.cc, 10.0.0.1! end"), (2, None), (3, "clean"), (4, "+4111111111111111 x")]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "é [EMAIL], [IP]! end" and got[2] is None and got[3] == "clean"
    assert re.fullmatch(r"(\+?)\[(CARD|PHONE)\] x", got[4])


def test_candidates_are_added(spark):
    good = [(i, f"please call our office at (31{i % 10}) 555-{1000 + i} today, or mail to u{i}@example.com soon") for i in range(40)]
    bad = [(100 + i, f"isbn 100-555-{1000 + i} of page 7") for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()}
    assert sum("phone:" in got[i] for i in range(40)) == 40
    assert not any(got[100 + i] for i in range(40))


def pack(*votes):
    out = 0
    for v in votes:
        out = out * 3 + v + 1
    return out


def test_reliabilities():
    """Three labelers that agree, one that says the opposite of them, one that never speaks."""
    counts = [("email", pack(1, 1, 1, -1, 0), 0, 4, 2, 500), ("email", pack(-1, -1, -1, 1, 0), 0, 4, 3, 500), ("email", pack(1, 1, -1, -1, 0), 0, 4, 2, 50), ("email", pack(-1, -1, 1, 1, 0), 0, 4, 3, 50)]
    chance, tables = pii.expectation_maximisation(counts)
    assert chance[0] > 0.95 and chance[1] < 0.05 and chance[2] > 0.9 and chance[3] < 0.1
    assert tables[0][1][2] > 0.95 and tables[3][1][0] > 0.9
    model = pii.SpanClassifier(counts)
    assert model.chance(model.features(*counts[0][:-1])) > 0.5 > model.chance(model.features(*counts[1][:-1]))
    assert pii.SpanClassifier(counts[::-1]).weights == model.weights


def test_neighbourhood_decides():
    """Spans on which no labeler speaks go with those behind the same word: something EM's votes can't tell."""
    sure = [("phone", pack(1, 1, 1, 1, 0), 1, 2, 5, 400), ("phone", pack(-1, -1, -1, -1, 0), 1, 2, 9, 400)]
    split = [("phone", pack(0, 0, 0, 0, 0), 1, 2, word, 20) for word in (5, 9)]
    chance, _ = pii.expectation_maximisation(sure + split)
    assert chance[2] == chance[3]
    model = pii.SpanClassifier(sure + split)
    assert model.chance(model.features(*split[0][:-1])) > 0.5 > model.chance(model.features(*split[1][:-1]))


def test_planted_candidates(spark):
    """National phones, security numbers, disguised emails and introduced names are added; numbers of other kinds aren't."""
    good = [t for i in range(25) for t in (f"please phone me at (3{i:02d}) 555-{1200 + i}", f"his ssn is 5{i:02d}-12-{3400 + i} he said", f"mail me at user{i} [at] example [dot] com please", f"my name is Maria Lopez{'abcdefghijklmnopqrstuvwxyz'[i]} and")]
    bad = [t for i in range(25) for t in (f"see isbn 100-555-{1200 + i} there", f"invoice 000-12-{3400 + i} paid", f"number 9807915762804{490 + i} of the list", f"version 3{i:02d}.555.1{i:02d} is out")]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    hits, wrong = sum(bool(got[i]) for i in range(len(good))), sum(bool(got[i]) for i in range(len(good), len(rows)))
    assert hits >= 0.9 * len(good) and wrong <= 0.05 * len(bad), (hits, wrong)


def test_columns_of_our_names_stay(spark):
    df = spark.createDataFrame([(1, "a@b.cc", "note", 5)], "doc_id long, text string, _pii_note string, _pii_base int")
    assert tuple(pii.redact(df).first()) == (1, "[EMAIL]", "note", 5) and pii.redact(df).columns == df.columns


def test_nothing_to_train_on():
    assert pii.SpanClassifier([]).weights == {}


def test_native(docs):
    plan = pii.report(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
