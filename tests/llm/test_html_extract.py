import math
import random
import time

import pytest

from quire.llm import html_extract as H


def test_article_only():
    page = """<!DOCTYPE html><html><head><title>T &am</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad -->
<div class="ad">buy</div><article><h1>Head &amp; more</h1><p><b>First
 line.<br><p>Second&nbsp; &lt;tag&gt; <span>in</span>line<p>Third</article><footer>&copy; host</footer></body></html>"""
    assert H.extract(page) == "Head & more\nFirst line.\nSecond <tag> inline\nThird"


def test_what_goes():
    inside = "<article><h2>A</h2><aside>no</aside><form>no<input></form><div class='cookie-notice'>no</div><section id=comments><p>no</p></section><p>B</p><div hidden>no</div><script>no()</script><ul><li>C<li>D</ul><table><tr><td>E<td>F</table></article>"
    assert H.extract(f"<header>no</header>{inside}<div role=navigation>no</div>") == "A\nB\nC\nD\nE\nF"
    assert H.extract("<main><p>teaser</p><article>A</article><p>more</p></main>") == "A" and H.extract("x<main><header>H</header><p>M</main>y") == "H\nM"
    assert H.extract("<aside><article>no</article></aside><p>x") == "x"
    assert H.extract("<article><header><h1>Kept</h1></header><p>x</article>") == "Kept\nx"


def test_no_markup_and_broken():
    assert H.extract(None) == H.extract("") == H.extract("   ") == ""
    assert H.extract("just  text") == "just text"
    assert H.extract("<p>a<p class='x>b") .startswith("a")
    assert H.extract("<div><p>a</div>b</p>c") == "a\nbc"
    assert H.extract("<script>x") == ""
    assert H.extract("a < b & c &unknown; &#65;") == "a < b & c &unknown; A"
    assert H.extract("<div>" * 3000 + "deep") == "deep"


def test_style_tree(spark):
    page = lambda i, extra="": f"<body><div class=top><p>Same words on every page</p></div><div class=content><p>Own words {i} of this page {i * 7}</p></div>{extra}</body>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(12)] + [(20, "http://one.example/", page(99)), (21, None, None), (22, "bad url", ""), (None, "http://h.example/x", page(50)), (3, "http://h.example/3", page(3))]
    rows = [(*r, "clash") for r in rows]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {(r["page_id"], r["url"]): r for r in H.report(d).collect()}
    assert got[0, "http://h.example/0"]["text"] == "Own words 0 of this page 0"
    assert got[20, "http://one.example/"]["text"] == "Same words on every page\nOwn words 99 of this page 693"
    assert got[21, None]["text"] == "" and got[21, None]["n_chars"] == 0
    assert H.report(d).count() == len(rows)
    tree = {(r["host"], r["path"]): r for r in H.style_tree(d).collect()}
    top = next(v for k, v in tree.items() if k[0] == "h.example" and k[1].endswith("div.top"))
    own = next(v for k, v in tree.items() if k[0] == "h.example" and k[1].endswith("div.content"))
    assert top["importance"] < 0.05 < 0.9 < own["importance"]
    assert H.report(d.limit(0)).count() == 0


def test_repeated_article_stays(spark):
    rows = [(i, f"http://h.example/{i}", "<nav>m</nav><article><p>An article that many pages hold</p></article>") for i in range(30)]
    got = H.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"An article that many pages hold"}


def test_text_around_an_article_stays(spark):
    rows = [(i, f"http://h.example/{i}", f"<main><h1>Head {i}</h1><p>lead {i}</p><article>A {i}</article><p>Same</p></main><div class=by><p>By the same</p></div><div class=more><p>body {i}</p></div>") for i in range(12)]
    rows += [(100 + i, f"http://t.example/{i}", f"<div class=text><p>All of page {i}</p></div><article class=card>card</article>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in H.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head 3\nlead 3\nA 3\nSame\nbody 3" and got[103] == "All of page 3\ncard"


def test_template_of_a_small_part_of_a_host(spark):
    """Boilerplate of few of a host's pages goes as well, whether branches are sent or joined."""
    rows = [(i, f"http://h.example/{i}", f"<div class=text><p>Own {i}</p></div>" + "<div class=part><p>Of this part</p></div>" * (i < 6)) for i in range(150)]
    d = spark.createDataFrame([*rows, (500, None, None)], "page_id long, url string, html string")
    for n in (1 << 22, 0):
        got = {r["page_id"]: r["text"] for r in H.report(d, broadcast_bytes=n).collect()}
        assert got == {**{i: f"Own {i}" for i in range(150)}, 500: ""}


def test_names_of_wrappers():
    body = "<nav>no</nav><article><h1>A</h1><p>B</p></article><div class='sidebar'>no</div>"
    for wrapper in ("div class='layout has-sidebar'", "div id='page-with-sidebar'", "div class='alert-free menu-open'", "form id='aspnetForm'", "div class=sidebar"):
        for low in (None, frozenset()):
            assert H.extract(f"<{wrapper}>{body}</{wrapper.split()[0]}><div class=cookie-notice>no and no and no and no</div>", low) == "A\nB", wrapper
    assert H.extract("<main><div class='elementor-widget-text'><p>Text of the page</p></div><div class=share>no</div></main>") == "Text of the page"
    assert H.extract("<div class='page has-sidebar'><p>Text of the page</p><div class=sidebar>no</div></div><p>x</p>") == "Text of the page\nx"
    assert H.extract("<div class=widget><p>All there is</p></div><nav>no</nav>") == "All there is"
    assert H.extract("<article>A</article><section class=related><article>no, but longer</article></section>") == "A"
    assert H.extract("<article>A<section id=comments>no, but much longer</section></article>", frozenset()) == "A"


def site(i, host="h.example"):
    return (i, f"http://{host}/{i}", f"""<div class=slogan><p>Always with you</p></div><article><h2 class=part>Introduction</h2><p>Own {i}</p>
<div class=series><p>This text is part of our series.</p></div><p class=close>Thanks for reading</p><ul class=points><li>point {i}</ul></article><div class=after><p>More from the house</p></div>""")


def test_the_tree_decides(spark):
    """Without the tree the boilerplate stays, outside of the article and inside; with it only the page's own text and headings stay."""
    d = spark.createDataFrame([site(i) for i in range(30)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.report(d).collect()}
    assert got == {i: f"Introduction\nOwn {i}\npoint {i}" for i in range(30)}
    off = {r["page_id"]: r["text"] for r in H.report(d, low=0.0).collect()}
    assert off == {i: f"Always with you\nIntroduction\nOwn {i}\nThis text is part of our series.\nThanks for reading\npoint {i}\nMore from the house" for i in range(30)}


def test_copies_of_a_page_are_no_template(spark):
    """A page that the host has many times counts once: its boxes stay, and what is template beside it is found by the others."""
    rows = [site(7, "m.example")] * 40 + [site(i, "n.example") for i in range(10)] + [(i, f"http://n.example/{i}", site(3)[2]) for i in range(20, 60)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r["page_id"], r["url"], r["text"]) for r in H.report(d).collect()]
    assert len(got) == 90 and {t for _, u, t in got if "m.example" in u} == {H.extract(site(7)[2], frozenset())}
    assert {t for i, u, t in got if "n.example" in u and i >= 20} == {"Introduction\nOwn 3\npoint 3"}


def test_importance_against_plain_python(spark):
    rng = random.Random(2)
    rows = [(i, f"http://{rng.choice('ab')}.example/{i}", "".join(f"<div class={c}><p>{rng.choice('xyz')}</p>{'<ul><li>q</ul>' * rng.randrange(2)}</div>" for c in rng.sample("klm", 2)) + f"<article>{rng.randrange(9)}</article>") for i in range(80)]
    got = {(r["host"], r["path"]): (r["n_pages"], r["presentation"], r["content"], r["importance"]) for r in H.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    seen = {}
    for _, url, page in rows:
        article, nodes = H.style_nodes(page)
        for path, style, text in nodes:
            for kind, v in ((0, style), (1, text)):
                seen.setdefault((url.split("/")[2], path), ({}, {}))[kind].setdefault(v, set()).add(article)
    assert set(got) == set(seen)
    for k, kinds in seen.items():
        want = []
        for by in kinds:
            n = [len(x) for x in by.values()]
            m = sum(n)
            want.append((m, 1.0 if m == 1 else -sum(x / m * math.log(x / m) for x in n) / math.log(m)))
        (m0, h0), (m1, h1) = want
        assert got[k][0] == max(m0, m1) and all(abs(a - b) < 1e-9 for a, b in zip(got[k][1:], (h0, h1, max(h0, h1)))), k


def test_work_grows_with_length():
    pages = {
        "stray ends": lambda n: "<div>" * n + "</p>" * n,
        "paragraphs in boxes": lambda n: "<p><button>" + "<div>" * n + "<div></div>" * n,
        "items in boxes": lambda n: "<li><ul>" + "<div>" * n + "<li>" * n,
        "rows": lambda n: "<table>" + "<div>" * n + "<tr><td>" * n,
        "quotes": lambda n: "<a '>" * n + "x",
        "open quotes": lambda n: '<a title="x>' * n,
        "open comments": lambda n: "<!-" * n,
        "open scripts": lambda n: "<script" * n,
    }
    for name, page in pages.items():
        began = time.perf_counter()
        H.extract(page(40_000))
        assert time.perf_counter() - began < 8, name
    assert H.extract("<p>" + "word " * 2_000_000).count("word") == 2_000_000


@pytest.mark.parametrize("wrappers", [1, 8, 40, 3000])
def test_a_box_at_any_depth_is_template(spark, wrappers):
    rows = [(i, f"http://h/{i}", f"<body><div>{'<div>' * wrappers}<div class=x>The same box.</div>{'</div>' * wrappers}</div><article><p>Article number {i}.</p></article></body>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in H.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Article number {i}." for i in range(20)}
