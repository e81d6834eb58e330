import pytest

from trackscan.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/x">Menu {n}</a></ul></nav>
<div class="{main}"><h2>Title &amp; {n}</h2><p>First   paragraph <b>number</b> {n} says something about the {n} things.<p>Second&nbsp;one &lt;{n}&gt;<br>goes on here and on
<div class="q7">Subscribe today for more</div><form>Name <input></form><!-- no --></div>
<aside>Side {n}</aside><div id="comments"><p>Nice {n}</p></div><div class="cookie-notice">We use cookies</div><footer>&copy; {n}</footer></body>"""
TEXT = "Title & {n}\nFirst paragraph number {n} says something about the {n} things.\nSecond one <{n}> goes on here and on"


@pytest.mark.parametrize("main", ["main article", "c12"])
def test_template_is_taken_out(spark, main):
    rows = [(i, f"http://a.example/{i}", PAGE.format(n=i * 7, main=main)) for i in range(8)] + [(100, "http://b.example/", PAGE.format(n=3, main=main))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.query(pages).collect()}
    for i in range(8):
        assert got[i]["text"] == TEXT.format(n=i * 7) and got[i]["n_chars"] == len(got[i]["text"])
    assert "Subscribe today" in got[100]["text"]  # one page has no template
    roles = {(r["kind"], r["role"]) for r in html.templates(pages).collect()}
    assert roles >= {(html.TEXT, html.FIXED), (html.TAG, html.ENTER), (html.TAG, html.LEAVE)}


def article(i, n=12):
    return " ".join(f"word{i}x{k}" for k in range(n * 10))


def test_text_that_no_tag_goes_with_is_template(spark):
    often = {"all": lambda i: 1, "most": lambda i: int(i % 4 > 0), "twice": lambda i: 1 + (i == 3)}
    pages = {name: ["<article>" + f"<p>{article(i)}</p>" + "<p>Read more on our site</p>" * on(i) + "</article>" for i in range(8)] for name, on in often.items()}
    assert hosts(spark, pages) == {name: [article(i) for i in range(8)] for name in often}


def test_pages_of_copies_keep_their_text(spark):
    pages = spark.createDataFrame([(i, "http://a.example/x", "<article><h1>T</h1><p>all the same words here</article>") for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in html.query(pages).collect()} == {"T\nall the same words here"}


def hosts(spark, by_host):
    """Main texts of the pages of each host, in order."""
    rows = [(f"http://{host}/{i}", p) for host, own in by_host.items() for i, p in enumerate(own)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["url"]: r["text"] for r in html.query(frame.coalesce(2)).collect()}
    return {host: [got[f"http://{host}/{i}"] for i in range(len(own))] for host, own in by_host.items()}


def texts(spark, pages):
    return hosts(spark, {"a.example": pages})["a.example"]


def test_unmarked_pages_keep_lead_title_and_links(spark):
    shapes = [
        "<body><h1>{t}</h1><div class='c1'><p>{a}</p></div><div class='c2'><p>{b}</p><p>{b2}</p></div></body>",
        "<body><div><h1><a href='/'>{t}</a></h1><p>{a}</p><p>{b} <a href='/y'>short</a></p></div></body>",
        "<body><div><p>{t}</p><p><a href='/x'>{a}</a></p><div><p>{b}</p></div></div></body>",
        "<body><div><h2>{t}</h2><p>{a}</p><p><b>{b}{b2}{b3}</b></p><p>last {t}</p></div></body>",
        "<body><h1><a href='/'>{t}</a></h1><div><p>{b}</p></div></body>",
        "<body><ul><li><a href='/q'>Elsewhere {t}</a></li></ul><div><p>{t}</p><p>{a}</p></div></body>",
    ]

    def made(shape, i):
        return shape.format(t=f"Title {i}", a=article(10 * i + 1, 3), b=article(10 * i + 2, 9), b2=article(10 * i + 3, 1), b3=article(10 * i + 4, 1))

    pages = {f"h{k}n{n}.example": [made(shape, i) for i in range(n)] for k, shape in enumerate(shapes) for n in (1, 6)}
    for host, found in hosts(spark, pages).items():
        for page, text in zip(pages[host], found):
            assert text == "\n".join(b[1] for b in html.parse(page).blocks if not b[1].startswith("Elsewhere")) and "Title" in text


def test_probes(spark):
    """Boilerplate on short pages, quotes in plain attribute values, links, and names that aren't kinds of slots."""
    promo = "<p>Buy our book now</p>"
    pages = {
        "line": [f"<article><p>{article(i, 1)}</p><p>The same long line stands on every page of this host, again and again.</p></article>" for i in range(4)],
        "promo": [f"<article><p>{article(i, 1)}</p>{promo if i < 7 else ''}</article>" for i in range(10)],
        "quote": ["<article><p class=it's>Hello world</p><p>don't stop</p></article>"],
        "link": ["<article><p>one</p><p><a href='/x'>a whole paragraph that is a link</a></p></article>"],
        "parts": ["<article><p>one <button>Share</button>and more</p><p>two</p><p>one two three</p><section id='comments'><p>Nice</p></section></article>"],
    }
    expected = {"line": [article(i, 1) for i in range(4)], "promo": [article(i, 1) for i in range(10)], "quote": ["Hello world\ndon't stop"], "link": ["one\na whole paragraph that is a link"], "parts": ["one and more\ntwo\none two three"]}
    for name in ("rating", "related-work", "legal", "tags", "has-sidebar", "noticeable"):
        pages[name], expected[name] = [f"<article><p>one</p><div class='{name}'><p>two</p></div></article>"], ["one\ntwo"]
    assert hosts(spark, pages) == expected


def test_the_template_decides(spark):
    """Without a template nothing tells the slots apart; a slot that only one page has belongs to the one around it."""
    page = "<div class='c7'>offer {i}</div><article><p>{a}</p></article>"
    pages = [page.format(i=i, a=article(i, 1)) for i in range(5)] + [f"<div class='c7'>offer</div><article><p>{article(9, 1)}</p><div class='once'><p>more</p></div></article>"]
    assert texts(spark, pages) == [article(i, 1) for i in range(5)] + [article(9, 1) + "\nmore"]
    assert html.extract_page(pages[0], set(), set(), set()) == "offer 0\n" + article(0, 1)


def test_pages_of_another_make_keep_their_text(spark):
    pages = [f"<article><p>{article(i, 1)}</p></article>" for i in range(40)] + ["<div><h1>Other</h1><p>text</p></div><nav>menu</nav>"]
    assert texts(spark, pages)[-1] == "Other\ntext"


def test_classes_equal_brute_force(spark):
    """Classes from summed hashes against whole occurrence vectors, on pages of tables and of a made-up host."""
    supplied = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    made = [(1000 + i, f"http://m.example/{i}", PAGE.format(n=i, main="x") + "<section><p>now</p></section>" * (i % 3)) for i in range(9)]
    pages = supplied.unionByName(spark.createDataFrame(made, supplied.schema))
    by_host = {}
    for r in pages.collect():
        by_host.setdefault(html.host_of(r["url"]), set()).add(r["html"] or "")
    got = {}
    for r in html.templates(pages).collect():
        got.setdefault(r["host"], []).append(r)
    for host, own in by_host.items():
        own = sorted(own)
        vectors, above = {}, {}
        for at, page in enumerate(own):
            made = html.parse(page)
            for i in range(1, len(made.tokens)):
                vectors.setdefault((1, made.tokens[i]), [0] * len(own))[at] += 1
                above[1, made.tokens[i]] = made.tokens[made.parents[i]]
            for element, text, _ in made.blocks:
                key = 2, html._digest(str(made.tokens[element]), "", text)
                vectors.setdefault(key, [0] * len(own))[at] += 1
                above[key] = made.tokens[element]
        met = {k: sum(x > 0 for x in v) for k, v in vectors.items()}
        tags = {k for k in vectors if k[0] == 1 and met[k] >= max(min(3, len(own)), 0.05 * len(own))}
        often = tags | {k for k in vectors if k[0] == 2 and met[k] >= max(3, 0.5 * len(own))}

        def place(k):
            up = above[k]
            while up and (1, up) in vectors and vectors[1, up] == vectors[k]:
                up = above[1, up]
            return up

        classes = {}
        for k in often:
            classes.setdefault((tuple(vectors[k]), place(k)), set()).add(k[1])
        found = {}
        for r in got.get(host, []):
            if r["kind"]:
                found.setdefault(r["class"], set()).add(r["token"])
                assert r["pages"] == met[r["kind"], r["token"]] and r["total"] == sum(vectors[r["kind"], r["token"]])
        assert {frozenset(x) for x in classes.values()} == {frozenset(x) for x in found.values()}
        of = {t: min(x) for x in classes.values() for t in x}
        for r in got.get(host, []):
            if r["kind"]:
                assert r["class_size"] == len(found[r["class"]]) and r["parent"] == of.get(place((r["kind"], r["token"])), 0)


def test_template_goes_from_short_pages_too(spark):
    more = "<div class='q7'>Read more of what we write on our site every day of the week</div>"
    rows = [(i, f"http://www.a.example/{i}", f"<article><p>{article(i, 1 if i == 2 else 20)}</p>{more}</article>") for i in range(8)]
    rows += [(100 + i, "http://a.example/copy", "<article><p>one page met often</p></article>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html.query(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert {i: got[i] for i in range(8)} == {i: article(i, 1 if i == 2 else 20) for i in range(8)}
    assert {got[100 + i] for i in range(30)} == {"one page met often"}


def test_odd_pages(spark):
    rows = [(0, None, None), (1, "", ""), (2, "::", "<"), (3, "http://a/", "<p <p>x"), (4, "http://a/", "<script>x"), (None, "http://a/", "<article>" * 500 + "deep"), (5, "http://a/", "<article>" + "word " * 40000), (5, "http://a/", "plain &eacute; text")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r["page_id"], r["text"]) for r in html.query(frame).collect()]
    assert len(got) == len(rows) and (None, "deep") in got and (5, "plain é text") in got and (0, "") in got
    assert html.query(frame.limit(0)).collect() == []


def test_clashing_columns_stay(spark):
    names = ["text", "_host", "_fixed", "host", "enter", "_own0", "_OWN1"]
    frame = spark.createDataFrame([(1, "http://a/", "<p>x</p>", *range(7))], "page_id long, url string, html string, " + ", ".join(f"{n} long" for n in names))
    row = html.extract(frame).collect()[0].asDict()
    assert row == {"page_id": 1, "url": "http://a/", "html": "<p>x</p>", **{n: i for i, n in enumerate(names)}, "text": "x"}


def test_deep_and_endless_pages(spark):
    assert texts(spark, ["<div>" * 3000 + "deep", "<p " + "a=b " * 20000, "<p title='" + "x" * 50000]) == ["deep", "", ""]
