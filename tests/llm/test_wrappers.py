import html
import json
import random
import re

import pytest

from voxelloom.llm.wrappers import _common as common
from voxelloom.llm.wrappers import article_place, extract, host_wrappers, main_text, merge, op10_html_extraction, parse, structure, wrapper


def simple(page):
    """The article of the test tables' one layout, by patterns."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", inner)
    texts = (" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, simple(r.html)) for r in pages.collect()}
    got = op10_html_extraction(pages).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def items(page):
    return wrapper(parse(page))


def test_alignment():
    a = items("<ul><li>x<li>y</ul><p>one<dl><dt>a<dd>b<dt>c<dd>d</dl>")
    ul, p, dl = a
    assert ul[5][0][0] == "li" and ul[5][0][2] == 1 and len(ul[5]) == 1
    assert [i[0] for i in dl[5]] == ["dt", "dd"] and all(i[2] for i in dl[5])
    b = items("<ul><li>z</ul><table><tr><td>1</table><p>one")
    m = merge(a, b)
    assert [(i[0], i[1]) for i in m] == [("ul", 0), ("table", 1), ("p", 0), ("dl", 1)]
    slot = m[2][5][0]
    assert slot[0] == "#" and slot[5] == slot[6] and slot[3] == 2  # the same text on both
    assert {i[0] for i in merge(b, a)} == {i[0] for i in m}


LAYOUT = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="col-{n}"><h2>Head {n}</h2><p>First &amp; {n} &eacute;<b>bo</b>ld<br>line</p><p>{long}</p><form><p>Name</p></form><ul><li>a<li>b</ul></div>
<div class="sidebar"><p>{long} {long}</p></div></div><section id="comments"><p>{long}{long}</p></section><footer>f {n}</footer></body></html>"""


def test_layout_without_article(spark):
    rows = [(i, f"http://h.example/{i}", LAYOUT.format(n=i, long=f"long words number {i} " * 20)) for i in range(6)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        long = ("long words number %d " % i * 20).strip()
        assert got[i] == f"Head {i}\nFirst & {i} ébold line\n{long}\na\nb"


def test_article_with_parts_left_out():
    page = '<main><article class="post"><header><h1>T</h1></header><p>x<aside>no</aside><div class="ad">no</div><p>y<script>"</p>"</script><figure><figcaption>c</figcaption></figure><div class="comments"><p>no</div></article></main>'
    assert main_text(page, None) == "T\nx\ny\nc"


def test_names_that_mention_what_is_left_out():
    assert main_text('<div class="page-with-footer overflow-hidden"><article class="text-share"><p>in</p></article></div>', None) == "in"
    assert main_text('<div class="content no-sidebar has-comments"><p>in</p><div class="sidebar-left"><p>out</p></div><div id="post_comments"><p>out</p></div></div>', None) == "in"


def test_what_follows_and_is_left_out_of_deep_parts():
    deep = "<div>" * 70 + '<aside>no</aside><div class="sidebar"><p>no</p></div>one<div>two</div>three' + "</div>" * 70
    assert main_text(f"<body><div><article>{deep}<p>rest</p></article></div><p>after</p></body>", None) == "one\ntwo\nthree\nrest"
    far = "<div>" * 120 + "<section><h1>t</h1><p>text of the article</p></section>" + "</div>" * 120
    assert main_text(f"<body><p>menu</p>{far}</body>", None) == "t\ntext of the article"
    assert main_text("<article>" + "<span>" * 5000 + "x" + "</span>" * 5000 + "<p>y</article>", None) == "x\ny"


def test_odd_rows(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "::not a url", ""), (3, "http://[x", "plain  text\n&lt;b&gt;"), (4, "http://a/", deep), (5, "http://a/", "<p>a" * 20_000), (6, "http://b/", "<article><p>one</p><p"), (6, "http://b/", "<article><p>one</p><p"), (None, "http://b/", "<!-- x --><article>two<script>never ends")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = sorted(((r.page_id or 0, r.text) for r in op10_html_extraction(pages).collect()))
    assert got == [(0, "two"), (1, ""), (2, ""), (3, "plain text <b>"), (4, "deep"), (5, "\n".join(["a"] * 20_000)), (6, "one"), (6, "one")]
    assert op10_html_extraction(pages.limit(0)).collect() == []


def test_wrappers_are_per_host(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", f"<body><div class={'x' if i % 2 else 'y'}><p>t{i}</p></div></body>") for i in range(8)]
    got = {r.host: (r.pages, json.loads(r.wrapper)) for r in host_wrappers(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got["h0.example"][0] == 4 and article_place(got["h0.example"][1]).path == ["body", "div.y"]
    assert article_place(got["h1.example"][1]).path == ["body", "div.x"]


@pytest.mark.parametrize("names", ["post share", "form", "notice", "article related", "col side", "story comment-count", "sidebar"])
def test_an_element_with_the_text_isnt_left_out_for_its_names(names):
    page = f'<body><ul class="menu"><li>home</ul><div class="{names}"><h1>Title</h1><p>the whole text of this page</p></div><footer>f</footer></body>'
    assert main_text(page, None) == "Title\nthe whole text of this page"


def test_names_of_articles_within_articles():
    assert main_text('<article><p>in, and long enough</p><div class="related post"><p>out</p></div></article>', None) == "in, and long enough"
    assert main_text('<div><div class="body"><p>short</p></div><div class="comments">' + "<p>long comment" * 50 + "</div></div>", None) == "short"


def test_wrappers_dont_depend_on_the_order(spark):
    texts = ["<p>a</p>", "<ul><li>x</ul><p>b</p>", "<p>c</p><table><tr><td>1</table>", "<h2>d</h2><p>e</p><ul><li>y</ul>", "<dl><dt>f</dl><p>g</p><h2>h</h2>", "<p>i</p><div>j</div>"]
    rows = [(f"http://h.example/{i}", f"<body>{texts[i % 6]}<p>{i}</p></body>") for i in range(36)]
    rng, found = random.Random(2), set()
    for n in (1, 2, 5, 7):
        rng.shuffle(rows)
        found.add(host_wrappers(spark.createDataFrame(rows, "url string, html string").repartition(n)).first().wrapper)
    assert len(found) == 1
    assert structure(json.loads(next(iter(found))))


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("uvwxyz") for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        pairs = common(a, b)
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert pairs == sorted(pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
    wide = [f"k{rng.randrange(4000)}" for _ in range(3000)]
    assert len(common(wide, wide[::-1])) > 0


def layouts(rng, n):
    """A page of each of several layouts, and its main text, block by block."""
    words = lambda k: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(k))
    title, paragraphs = words(5), [words(rng.randrange(15, 60)) for _ in range(rng.randrange(1, 6))]
    quote, items = words(9), [words(3) for _ in range(rng.randrange(2, 5))]
    blocks = [title, *paragraphs, quote, *items]
    inner = "".join(f"<p>{p}</p>" for p in paragraphs) + f"<blockquote>{quote}</blockquote><ul>" + "".join(f"<li>{i}" for i in items) + "</ul>"
    menu = "<nav><ul><li>Home<li>News</ul></nav>"
    side = f'<div class="sidebar"><h3>Popular</h3><p>{words(30)}</p></div>'
    comments = "".join(f"<div class=comment><p>{words(12)}</p></div>" for _ in range(rng.randrange(4)))
    yield "tag", f"<body>{menu}<main><article><h1>{title}</h1>{inner}</article></main>{side}<footer>{words(4)}</footer></body>", blocks
    yield "class", f'<body><header><h1>Site</h1></header>{menu}<div class="post"><h1>{title}</h1><div class="post-body">{inner}</div></div><section id="comments">{comments}</section></body>', blocks
    yield "nothing", f"<body><div>{menu}</div><div><div><h1>{title}</h1>{inner}</div></div><div><p>All rights reserved</p></div></body>", blocks
    yield "odd names", f'<body><div class="notice share"><h2>{title}</h2>{inner}</div><div class="cookie">We use cookies</div></body>', blocks
    yield "deep", "<body>" + '<div class="w">' * 90 + f"<h1>{title}</h1>{inner}" + "</div>" * 90 + f"{side}</body>", blocks
    yield "table", f'<body><table><tr><td class="menu"><a href=x>Home</a><td class="cell"><h1>{title}</h1>{inner}</table></body>', blocks
    yield "sections", f"<body><div class=page><h1>{title}</h1><section>{''.join(f'<p>{p}</p>' for p in paragraphs)}</section><section><blockquote>{quote}</blockquote><ul>{''.join(f'<li>{i}' for i in items)}</ul></section></div><aside>{words(40)}</aside></body>", blocks
    yield "no h1", f'<body><div id="hd"><p>Daily {n % 2}</p></div><div id="x1"><p>{title}</p>{inner}</div><form><p>Sign up {words(20)}</p></form></body>', blocks


    prose = "".join(f"<p>{p}</p>" for p in paragraphs)
    yield "style", f'<body>{menu}<div style="overflow: hidden" data-role="dialog" title="a hidden gem"><article data-class="ad" aria-label="hidden"><h1>{title}</h1>{inner}</article></div>{side}</body>', blocks
    yield "one form", f'<body><form id="aspnetForm" action="/p?id=comments"><input name=q value="{words(2)}"><div class="menu">{menu}</div><div id="ctl00_body"><h1>{title}</h1>{inner}<label for=a>Mail</label><select><option>one</select></div></form></body>', blocks
    yield "anchors", f'<body>{menu}<main><h1 class="page-header">{title}</h1>{prose}<h2 id="discussion">{quote}</h2><h2 id="search">{items[0]}</h2><section id="related"><h2>{items[1]}</h2><p>{quote} {n}</p></section></main><section id="comments">{comments}</section></body>', [title, *paragraphs, quote, items[0], items[1], f"{quote} {n}"]
    yield "paragraphs", f'<body><p class="notice">We use cookies</p><article><h1>{title}</h1><p class="alert">{quote}</p>{prose}</article><footer><p>{words(3)}</p></footer></body>', [title, quote, *paragraphs]
    yield "links", f'<body>{menu}<div class="story"><h1>{title}</h1>{prose}<p>See <a href="/hidden-gems/{n}">{items[0]}</a> and <a href=/p?id=related rel=nofollow>{items[1]}</a>.</p></div><ul class="related-links"><li><a href=/1>{words(4)}</a></ul></body>', [title, *paragraphs, f"See {items[0]} and {items[1]}."]
    yield "formula", f"<body><article><h1>{title}</h1>{prose}<p>So <math><mi>x</mi><mo>=</mo><mn>{n}</mn><annotation>x={n}</annotation></math> holds</p></article><svg><title>Share</title><path d='M0'/></svg></body>", [title, *paragraphs, f"So x={n} holds"]
    yield "dialog", f'<body><dialog open><p>Subscribe {n}</p></dialog><div class="page"><h1>{title}</h1>{inner}</div><form class=search><label>Find</label><input></form></body>', blocks


def test_several_layouts_of_several_hosts(spark):
    rng, rows, want = random.Random(7), [], {}
    for n in range(16):
        for kind, page, blocks in layouts(rng, n):
            i = len(rows)
            # Two layouts share each host.
            rows.append((i, f"http://{'abcd'[sum(map(ord, kind)) % 4]}.example/{i}", page))
            want[i] = (kind, blocks)
    got = {r.page_id: r.text.split("\n") for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    there = sum(len(set(b) & set(got[i])) for i, (_, b) in want.items())
    recall, precision = there / sum(len(set(b)) for _, b in want.values()), there / sum(len(set(x)) for x in got.values())
    wrong = sorted({k for i, (k, b) in want.items() if got[i] != b})
    assert len({k for k, _ in want.values()}) == 15
    assert recall > 0.995 and precision > 0.985, (recall, precision, wrong)


@pytest.mark.parametrize("start,end", [('<div style="overflow: hidden">', "</div>"), ("<form id=aspnetForm>", "</form>"), ('<div data-id="comments" data-hidden title="ad">', "</div>"), ("<dialog open>", "</dialog>"), ('<div aria-label="hidden" data-class="ad">', "</div>"), ("<form><fieldset>", "</fieldset></form>")])
def test_what_holds_the_article_is_no_reason_to_leave_it_out(spark, start, end):
    pages = [(i, f"http://h.example/{i}", f"<body><nav>Home</nav>{start}<article><h1>Title {i}</h1><p>words of page {i}</p><p data-id='comments' title='ad'>more {i}</p><form><input value=x><label>Name</label></form></article>{end}<footer>f</footer></body>") for i in range(12)]
    got = {r.page_id: r.text for r in op10_html_extraction(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nwords of page {i}\nmore {i}" for i in range(12)}


def test_labels_and_attributes_of_one_name():
    assert main_text("<article><p>a</p><label>plain</label><label for=x>field</label></article>", None) == "a\nplain"
    assert main_text('<article><p class="x" class="comments">a</p><p CLASS=comments>b</p></article>', None) == "a"
