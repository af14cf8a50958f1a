"""Main text and url verdicts."""

import json
import random

import pytest

from tensorweft.llm import htmlwrap, urlfilter

PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style><script>var x="</p><p>no";</script></head><body>
<header class="top">Welcome</header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side</p></div><!-- <p>hidden</p> -->
<article><header><h1>Title &amp; more</h1></header><p>First   <b>bold</b>,\n line&nbsp;one.</p><p>Second&#33;<br>after
<div class="ad banner">Buy</div><form><p>Name</p><input></form><ul><li>item one<li>item two</ul>
<noscript>turn on</noscript></article><section class="comments"><p>Nice post</p></section><footer>&copy; me</footer></body></html>"""


def test_article():
    text = htmlwrap.main_text(PAGE, None)[0]
    assert text == "Title & more\nFirst bold , line one.\nSecond!\nafter\nitem one\nitem two".replace("bold ,", "bold,")


@pytest.mark.parametrize("html, text", [("", ""), ("<p>a", "a"), ("no tags &lt;b&gt;", "no tags <b>"), ("<div class='menu'>x</div><p>y</p>z", "y\nz"), ("<article><p>a<", "a<"), ("<article>a &a</article>", "a &a"), ("<p " + "x" * 1000, ""), ("</p></div>q", "q"), ("<div class='content with-sidebar'><div class='post-header'><h1>T</h1></div><p>x</p><div class='left-sidebar'>s</div></div>", "T\nx"), ("<p hidden>a</p><p style='overflow: hidden'>b</p><p style=\"display: none\">c</p><p aria-hidden=true>d</p>", "b"), ("<nav>menu<article>inside</article></nav><p>t", "t")])
def test_odd_pages(html, text):
    assert htmlwrap.main_text(html, None)[0] == text


def pages(n, host, extra=""):
    r = random.Random(host)
    body = lambda: "".join(f"<p>{' '.join(r.choices('abcdefgh', k=6))}</p>" for _ in range(r.randint(2, 5)))
    return [(f"http://{host}/{i}", f"<html><body><div><span>Same line on all pages of {host}</span></div><div><h1>t{i}</h1>{body()}{extra * (i % 2)}</div></body></html>") for i in range(n)]


def test_wrappers(spark):
    rows = [(k, u, h) for k, (u, h) in enumerate(pages(12, "one.example.com", "<hr><p>extra</p>") + pages(2, "two.example.com") + [("no host", "<p>x</p>"), (None, None), ("http://three/", "")])]
    out = {r.page_id: r for r in htmlwrap.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(out) == len(rows)
    assert all("Same line" not in out[i].text and out[i].text.startswith(f"t{i}\n") for i in range(12))
    # two pages are too few to tell a template by its text
    assert "Same line" in out[12].text
    assert all(out[i].n_decided == 1 for i in range(12))
    assert out[14].text == "x" and out[15].text == "" and out[16].text == "" and all(r.n_chars == len(r.text) for r in out.values())
    assert sum(out[i].wrapped for i in range(12)) >= 8


def form(items):
    """An expression as text: elements by their labels, # a free slot, = a string that stays."""
    name = {htmlwrap.SLOT: "#", htmlwrap.STRING: "="}
    one = lambda x: (name.get(x[0]) or (f"({form(x[4])})" if x[0] == htmlwrap.GROUP else f"{x[3]}<{form(x[4])}>")) + "+" * x[2] + "?" * x[1]
    return " ".join(map(one, items))


def inferred(*htmls):
    return json.loads(htmlwrap.infer([htmlwrap.sample_of(h) for h in htmls]))


def test_expressions():
    assert form(inferred("<ul><li>a<li>b<li>c</ul>")[0]) == "ul<li<#>+>"
    assert form(inferred("<h2>a</h2><p>b<p>c<h2>d</h2><p>e")[0]) == "(h2<#> p<#>+)+"
    assert form(inferred("<h1>t</h1><p>a", "<h1>t</h1><div>x</div><p>b")[0]) == "h1<=> div<=>? p<#>"
    assert form(inferred("<p>a", "<div>a</div>")[0]) in ("p<=>? div<=>?", "div<=>? p<=>?")
    assert form(inferred("x<br>y", "x")[0]) == "#+"
    r = random.Random(2)
    tags = [r.choice(["h2", "pre", "p", "div"]) for _ in range(4000)]
    assert sorted(form(inferred("".join(f"<{x}>{k}</{x}>" for k, x in enumerate(tags)))[0])[1:-2].split(" ")) == ["div<#>+?", "h2<#>+?", "p<#>+?", "pre<#>+?"]


def random_page(r, depth=0):
    out = []
    for _ in range(r.randint(0, 5)):
        tag = r.choice(["div", "p", "h2", "ul", "section", "blockquote"])
        out.append(r.choice(["text ", "more &amp; ", f"w{r.randrange(9)} "]) if r.random() < 0.3 or depth > 3 else f"<{tag} class='c{r.randrange(3)}'>{random_page(r, depth + 1)}</{tag}>")
    return "".join(out)


def test_every_sampled_page_matches():
    r = random.Random(11)
    for _ in range(150):
        htmls = [random_page(r) for _ in range(r.randint(1, 6))]
        wrapper = htmlwrap.Wrapper(*inferred(*htmls))
        for h in htmls:
            slots, whole = wrapper.read(page := htmlwrap.Page(h))
            assert whole and len(slots) == len(page.blocks)


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert htmlwrap.main_text(deep, htmlwrap.Wrapper(*inferred(deep))) == ("x", True, 0)
    long = "<article>" + "".join(f"<p>word{i}</p>" + "<hr><h3>x</h3>" * (i % 13 == 0) for i in range(30_000)) + "</article>"
    text, whole, _ = htmlwrap.main_text(long, htmlwrap.Wrapper(*inferred(long)))
    assert whole and text.count("\n") + 1 == 30_000 + 2308


def hashed_site(n, seed):
    """Pages whose classes say nothing, and their main texts: menu, box and related links are told by the wrapper alone."""
    r = random.Random(seed)
    some = lambda k: " ".join("".join(r.choices("abcdefghijk", k=r.randint(2, 8))) for _ in range(k))
    link = lambda: f'<li><a href="/{r.randrange(999)}">{some(2)}</a></li>'
    out = []
    for i in range(n):
        blocks = [some(6)] + [some(r.randint(8, 40)) for _ in range(r.randint(2, 7))]
        inside = "".join(f"<p>{b}</p>" for b in blocks[1:])
        box = '<div class="x7f3"><h3>Stay in touch</h3><p>Get our letter every week.</p></div>'
        more = f"<ul class='q9'>{''.join(link() for _ in range(r.randint(2, 5)))}</ul>"
        html = f'<html><body><div class="a1b2"><ul>{"".join(link() for _ in range(5))}</ul></div><article class="zz{i}"><h1>{blocks[0]}</h1>{inside}{box}{more}</article><div class="k0">All rights reserved</div></body></html>'
        out.append((f"http://hashed{seed}.example.com/{i}", html, "\n".join(blocks)))
    return out


def test_wrappers_decide(spark):
    """Without the wrapper no such page is right; with it all are, whether wrappers are broadcast or travel as rows."""
    site = hashed_site(30, 1) + hashed_site(8, 2)
    copies = [(u + "?copy", h, t) for u, h, t in site[:1] * 40]
    rows = [(i, u, h, "own", 1) for i, (u, h, _) in enumerate(site + copies)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string, host int").repartition(4)
    want = {i: t for i, (_, _, t) in enumerate(site + copies)}
    assert not any(htmlwrap.main_text(h, None)[0] == t for _, h, t in site)
    for limit in (1 << 25, 0):
        out = htmlwrap.extract(df, broadcast_bytes=limit)
        assert out.columns == ["page_id", "url", "text", "n_chars", "wrapped", "n_decided"]
        got = out.collect()
        assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
        assert all(r.wrapped and r.n_decided >= 4 for r in got)


def test_repeated_paragraphs_are_no_template(spark):
    """A paragraph that most pages share is the article's where it stands in a repeated group."""
    r = random.Random(4)
    rows = [(i, f"http://a.b/{i}", "<article><h1>t%d</h1>%s</article>" % (i, "".join(f"<p>{x}</p>" for x in r.sample(["same line", f"own {i}", f"other {i}"], 3)))) for i in range(20)]
    got = htmlwrap.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("same line" in x.text and x.text.count("\n") == 3 for x in got)


def test_all_pages_make_the_wrapper(spark):
    """Five pages of 200 have a list of links in their article, and each page has a class of its own: no sample would tell."""
    r = random.Random(6)
    some = lambda k: " ".join("".join(r.choices("abcdefghijk", k=r.randint(2, 8))) for _ in range(k))
    rows, want = [], {}
    for i in range(200):
        blocks = [some(5)] + [some(r.randint(8, 20)) for _ in range(r.randint(2, 4))]
        links = "".join(f"<li><a href='/{k}'>{some(2)}</a></li>" for k in range(3)) if i % 40 == 7 else ""
        body = f"<h1>{blocks[0]}</h1><div class='{'abcdefghij'[i % 10]}{'abcdefghijklmnopqrst'[i // 10]}q'>" + "".join(f"<p>{b}</p>" for b in blocks[1:]) + "</div>"
        rows.append((i, f"http://a.b/{i}", f"<article>{body}{links and f'<ul>{links}</ul>'}</article>"))
        want[i] = "\n".join(blocks)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for limit in (1 << 25, 0):
        got = htmlwrap.extract(df, broadcast_bytes=limit).collect()
        assert {x.page_id: x.text for x in got} == want
        assert all(x.wrapped and x.n_decided == 3 * (x.page_id % 40 == 7) for x in got)


def test_links_are_counted_over_all_pages(spark):
    """A slot that is a link on most pages of a host, and mostly text over all of them, is the article's."""
    slot = lambda i: f"{'word ' * 200}{i}" if i % 25 == 3 else f"<a href=x>link {i}</a>"
    rows = [(i, f"http://h{i % 6}.b/{i}", f"<article><h1>t{i}</h1><div>{slot(i)}</div></article>") for i in range(600)]
    got = htmlwrap.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {x.page_id: x.text for x in got} == {i: f"t{i}\n" + slot(i).replace("<a href=x>", "").replace("</a>", "") for i in range(600)}


def test_rare_classes():
    """Elements whose classes few pages have share a slot, whose links don't tell of the others' text."""
    html = lambda i: f"<article><h1>t{i}</h1><div class='{'abcdefghijkl'[i]}'>{f'text {i}' if i < 3 else f'<a href=x>a link of some length {i}</a>'}</div></article>"
    nested, *_ = [json.loads(htmlwrap.shape_of(htmlwrap.Page(html(i)))) for i in range(12)]
    assert set(htmlwrap.classes_of(nested)) == {"div a"} and json.dumps(htmlwrap.without(nested, frozenset(["div a"]))) == json.dumps(nested).replace("div a", "div *")
    items = [[htmlwrap.ELEMENT, False, False, "article", [[htmlwrap.ELEMENT, False, False, x, [[htmlwrap.SLOT, False, False, "", []]]] for x in ("h1", "div *")]]]
    sums = [12, "0", "f", 300, 320, 1, 1]
    wrapper = htmlwrap.Wrapper(*json.loads(htmlwrap.finished(items, {0: [12, "0", "f", 0, 30, 1, 1], 1: sums}, [])))
    assert wrapper.roles == "++" and htmlwrap.role(True, True, *sums) == "-"
    assert all(wrapper.read(htmlwrap.Page(html(i)))[1] for i in range(12)) and htmlwrap.main_text(html(1), wrapper)[0] == "t1\ntext 1"


def test_many_shapes(spark, monkeypatch):
    """Wrappers of buckets of shapes become one that all pages match."""
    monkeypatch.setattr(htmlwrap, "FAN", 4)
    r = random.Random(13)
    rows = [(i, f"http://{'a' if i % 9 else 'b'}/{i}", random_page(r)) for i in range(150)] + [(150, "http://a/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got, again = (sorted(map(tuple, htmlwrap.extract(x).collect())) for x in (df, df.repartition(5)))
    assert len(got) == 151 and all(wrapped for *_, wrapped, _ in got) and got == again


@pytest.mark.parametrize("kinds, held", [(5000, 400), (100, 2), (1, 1)])
def test_bags(monkeypatch, kinds, held):
    """A list of many unlike children matches in any order, and so do others of these kinds."""
    monkeypatch.setattr(htmlwrap, "KINDS", kinds)
    names = ["".join(x) for x in zip("abcdefghijklmnopqrst" * 20, (y for x in "abcdefghijklmnopqrst" for y in x * 20))]
    page = lambda few: "<article>" + "".join(f"<{'div' if x < 'k' else 'p'} class='{x}'>{x}</{'div' if x < 'k' else 'p'}>" for x in few) + "</article>"
    htmls = [page(names), page(names[::-1]), page(names[:3]), "<article></article>"]
    items, *more = inferred(*htmls)
    assert len(items[0][4]) == 1 and len(items[0][4][0][4]) == held
    for h in htmls:
        slots, whole = htmlwrap.Wrapper(items, *more).read(page := htmlwrap.Page(h))
        assert whole and len(slots) == len(page.blocks)


def test_no_pages(spark):
    assert htmlwrap.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


RULES = [
    ("http://A.Com/en/x", "a.com", "/en/x", "com/en/", "block"), ("http://example.com/en/75?q=/en/", "example.com", "/en/75", "example.com/en/7", "allow"), ("https://m.example.com/en/8", "m.example.com", "/en/8", "com/en/", "block"),
    ("x://example.net/de/8#f", "example.net", "/de/8", "example.net/de/8", "block"), ("http://org/es/", "org", "/es/", "org/es/", "block"), ("http://xorg/es/", "xorg", "/es/", None, None), ("http://a.com?/en/", "a.com", "", None, None),
    ("http://a.com#x/en/", "a.com", "", None, None), ("a.com/en/", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None), ("http://ÄB.COM/en/", "Äb.com", "/en/", "com/en/", "block"), ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, r[0], "keep") for i, r in enumerate(RULES)], "page_id long, url string, host string")
    model = urlfilter.UrlModel([], [])
    for r in urlfilter.judge(df, model).collect():
        want = RULES[r.page_id]
        assert (r.host, r.path, r.rule) == want[1:4] and r.verdict == (want[4] or "allow")


#: The contract's list, in words of its own: url, rule, verdict.
CONTRACT = [
    ("http://a.com/en/1", "com/en/", "block"), ("http://example.com/en/7", "example.com/en/7", "allow"), ("http://a.net/de/1", "net/de/", "allow"),
    ("http://example.net/de/7", "net/de/", "allow"), ("http://www.example.net/de/8x", "example.net/de/8", "block"), ("http://a.org/es/1", "org/es/", "block"),
]


def test_rules_of_the_contract(spark):
    """Each rule's word holds, whatever the method would say of the url."""
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(CONTRACT)], "page_id long, url string")
    for always in (0, 1):
        got = urlfilter.judge(df, urlfilter.UrlModel(["http://x/"], [always])).collect()
        assert sorted((r.page_id, r.rule, r.verdict) for r in got) == [(i, *r[1:]) for i, r in enumerate(CONTRACT)]


def labelled(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(4, 8)))
    out = []
    for _ in range(n):
        bad = r.random() < 0.3
        host = f"{r.choice(['cheap', 'free', 'win'])}-{word()}{r.randint(10, 999)}.example.com" if bad else f"www.{word()}.example.org"
        path = f"/{word()}?id={r.randint(1, 9)}&ref={word()}&x={r.randint(1, 10**6)}" if bad else f"/{word()}/{word()}"
        out.append((f"http://{host}{path}", int(bad)))
    return out


def test_held_out_accuracy(spark):
    train, test = labelled(1500, 1), labelled(600, 2)
    model = urlfilter.train(spark.createDataFrame(train, "url string, label int"))
    again = urlfilter.train(spark.createDataFrame(train[::-1], "url string, label int").repartition(5))
    scores = model.score([u for u, _ in test])
    assert scores == again.score([u for u, _ in test])
    assert sum((s >= 0.5) == bool(y) for s, (_, y) in zip(scores, test)) / len(test) > 0.95


def test_no_labels(spark):
    none = urlfilter.train(spark.createDataFrame([], "url string, label int"))
    assert none.score(["http://a/", None]) == [0.0, 0.0]
    assert urlfilter.train(spark.createDataFrame([("http://a/", 1), (None, None)], "url string, label int")).score(["x"]) == [1.0]
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), none).count() == 0


def test_suffixes_outside_the_sample(spark):
    """Suffixes are counted over all labelled urls, also those that aren't fitted on."""
    rows = labelled(400, 3) + [(f"http://a.rare.net/{i}", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "url string, label int").repartition(3)
    model = urlfilter.train(df, sample=50)
    seen = {(r.k, r.suffix): (r.bad, r.n) for r in model.counts.collect()}
    assert seen[1, "rare.net"] == (40, 40) and seen[0, "net"] == (40, 40)
    assert model.statistics.prior == sum(y for _, y in set(rows)) / len(set(rows))
    got = {r.url: r.score for r in urlfilter.judge(df.select("url"), model).collect()}
    whole = urlfilter.SuffixStatistics([urlfilter.split_url(u)[0] for u, _ in set(rows)], [y for _, y in set(rows)])
    model.statistics = whole
    assert got == dict(zip(got, model.score(list(got))))
