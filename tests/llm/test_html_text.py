import dataclasses
import html
import random
import re
import time

from treesift.llm import html_text


def article_of(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|h2|h3|li|ul)\b[^>]*>", body.replace("<br>", " "))
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_query_gives_the_article(spark, sf_dir):
    from treesift.llm.queries import queries

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries()["op3_html_extraction"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article_of(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def wanted(page):
    """The text of a labelled page's main runs, and nothing else."""
    items, labels = html_text.parsed(page)
    kept = [i for i, main in zip(items, labels, strict=True) if main]
    return html_text.text_of(kept, [False] * len(kept))


def test_held_out_layouts():
    rng, model = random.Random(77), html_text.model()
    pages = [html_text.labelled_page(rng) for _ in range(300)]
    right = sum(html_text.main_text("".join(p for p, _ in page), model) == wanted(page) for page in pages)
    assert right >= 0.94 * len(pages)


def test_the_scan_and_its_weights_decide():
    """Without the scan, or with weights that say nothing, far fewer pages come out right."""
    rng, model = random.Random(79), html_text.model()
    plain = dataclasses.replace(model, tags=dict.fromkeys(model.tags, -0.01), unknown=-0.01)
    pages = [html_text.labelled_page(rng) for _ in range(300)]
    unnamed = [p for p in pages if not re.search(r"<nav|nav|menu|topbar", p[0][0])]
    differ = {"without scan": 0, "plain weights": 0}
    for page in unnamed:
        source = "".join(p for p, _ in page)
        got = html_text.main_text(source, model)
        items = html_text.pieces(source)
        differ["without scan"] += html_text.text_of(items, html_text.box_marks(items, model)) != got
        differ["plain weights"] += html_text.main_text(source, plain) != got
    assert len(unnamed) > 50 and min(differ.values()) >= 0.8 * len(unnamed), (differ, len(unnamed))


PARAGRAPHS = ["It was late in the year when the first of them came down from the hills.", "Nobody had seen the river so low, and the mill had stood still for weeks, as old people said it had once before.", "They stayed."]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = "The dry year\n" + "\n".join(PARAGRAPHS)
MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "World", "Sport", "Weather", "Letters", "About us"))
#: Pages as sites write them, none by the generator that the model learns from.
LAYOUTS = {
    "news": f'<header id="site-header"><div class="logo">The Paper</div><nav><ul>{MENU}</ul></nav></header><main><article class="story"><header><h1>The dry year</h1></header>{BODY}</article><aside class="related-stories"><h3>More</h3><ul>{MENU}</ul></aside></main><footer><p>Copyright The Paper</p></footer>',
    "sidebar first": f'<div id="wrapper" class="has-sidebar"><ul class="main-menu">{MENU}</ul><div class="sidebar"><h4>Archive</h4><ul>{MENU}</ul><p>Sign up for our letter and get it every week in the morning.</p></div><div class="post-content"><h1>The dry year</h1>{BODY}</div></div><div class="site-footer">All rights reserved by us</div>',
    "one form": f'<form id="aspnetForm" action="page.aspx" method="post"><input type="hidden" name="v" value="x"><div id="menu"><ul>{MENU}</ul></div><div id="content"><h1>The dry year</h1>{BODY}</div><div id="footer">Terms and conditions apply</div></form>',
    "tables": f'<center><table width="100%"><tr><td bgcolor="#eee"><a href="1">Home</a><br><a href="2">News</a><br><a href="3">Links</a><br></td><td><h1>The dry year</h1>{BODY}</td></tr></table></center>',
    "hashed names": f'<div class="x1a2b3"><div class="q9z8"><a href="/">Paper</a><a href="/w">World</a><a href="/s">Sport</a><a href="/l">Letters</a></div><div class="k3j4"><div class="m5n6"><h1>The dry year</h1>{BODY}</div></div><div class="p7q8"><a href="/t">Terms</a><a href="/c">Contact</a></div></div>',
    "readers": f'<nav><ul>{MENU}</ul></nav><div class="entry-content"><h1>The dry year</h1>{BODY}</div><ol class="comment-list">' + "".join(f"<li><article><p>I remember that year well, number {i}, and so does my brother.</p></article></li>" for i in range(40)) + "</ol>",
    "advert inside": f'<ul class="nav">{MENU}</ul><div class="article-body"><h1>The dry year</h1><p>{PARAGRAPHS[0]}</p><div class="ad-container">Buy a new mill today, cheap</div><p>{PARAGRAPHS[1]}</p><script>ad()</script><p>{PARAGRAPHS[2]}</p></div>',
    "print area": f'<div class="topbar"><a href="/">Home</a> <a href="/a">All</a></div><div id="print-area"><article><h1>The dry year</h1>{BODY}</article></div><div class="cookie-notice">We use cookies on this site. <button>Fine</button></div>',
    "post more": f'<div class="navbar"><ul>{MENU}</ul></div><div class="post-more"><div class="post"><h1>The dry year</h1>{BODY}</div></div>',
    "camel case": f'<div class="mainNav"><ul>{MENU}</ul></div><div class="contentWithSidebar"><div class="storyBody"><h1>The dry year</h1>{BODY}</div><div class="rightSidebar"><h4>Most read</h4><ul>{MENU}</ul></div></div>',
}


def test_layouts_that_the_generator_does_not_write():
    model = html_text.model()
    got = {k: html_text.main_text(f"<html><head><title>t</title></head><body>{v}</body></html>", model) for k, v in LAYOUTS.items()}
    wrong = {k: v for k, v in got.items() if v != TEXT}
    assert not wrong, wrong


def test_large_and_deep_pages_take_linear_time():
    model = html_text.model()
    for part in ("<nav><article>", '<div class="ad">', "<b>", "<p>a</b>", '<div class="ad has-ad x"><p>w</p>', "</div>", "<p>word", '<a href="', "<!--", "&amp;", "< ", "<h1>a</h1>"):
        took = []
        for size in (500_000, 2_000_000):
            began = time.process_time()
            html_text.main_text((part * (size // len(part) + 1))[:size], model)
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 1, (part, took)


def test_boxes_inside_an_article():
    page = """<body><nav><a>Menu</a></nav><article><h1>Head &amp; more</h1><p>First <b>para</b>graph
    here with words.</p><div class="ad">Buy now</div><form><input>Sign up</form><p>Second&nbsp;one&lt;2.</p><aside>Side</aside>
    <div id="comments"><p>Reader says</p></div></article><footer>End</footer>"""
    assert html_text.main_text(page, html_text.model()) == "Head & more\nFirst paragraph here with words.\nSecond one<2."


def test_wrappers_with_names_of_boxes():
    rng, model = random.Random(78), html_text.model()
    opened = ('<div class="layout has-sidebar">', '<div id="print-area">', '<div class="post comment-open">', '<div class="more-content">', '<form method="post" action="x.aspx">')
    right = dict.fromkeys(opened, 0)
    for wrapper in opened:
        for _ in range(60):
            page = html_text.labelled_page(rng)
            source = "".join(p for p, _ in page)
            source = source.replace("<body>", "<body>" + wrapper).replace("</body>", "</form></body>" if "form" in wrapper else "</div></body>")
            right[wrapper] += html_text.main_text(source, model) == wanted(page)
    assert min(right.values()) >= 54, right
    text = " ".join(f"word{i}" for i in range(60))
    page = f'<body><nav><a>Menu</a></nav><div class="post"><header><h1>The title of it</h1></header><p>{text}</p><div class="site-footer">end</div></div></body>'
    assert html_text.main_text(page, model) == f"The title of it\n{text}"


def test_long_comments_stay_out():
    page = "<body><article><h1>Head</h1><p>Some words of a text.</p></article><ol class='comment-list'>" + "<li><article><p>a reader says much</p></article></li>" * 60 + "</ol></body>"
    assert html_text.main_text(page, html_text.model()) == "Head\nSome words of a text."
    plain = page.replace("<article><h1>Head</h1>", "<div class='post'>", 1).replace("</article>", "</div>", 1)
    assert html_text.main_text(plain, html_text.model()) == "Some words of a text."


def test_short_article_beside_long_menus():
    page = "<body><nav>" + "<a>many menu words here</a>" * 60 + "</nav><article><p>Short.</p></article><footer>" + "foot words " * 80 + "</footer>"
    assert html_text.main_text(page, html_text.model()) == "Short."


def test_broken_markup_ends():
    model = html_text.model()
    for page in (None, "", "plain words", "<p>open <b>never closed", "<!-- open", "<a href='x", "<script>var a='</p>';", "<" * 5000, "<p " + 'a="' * 3000, "&am", "<nav>" * 300, "</article>", "<p>\x00</p>"):
        html_text.main_text(page, model)
    assert html_text.main_text("<p>one<br>two</p>", model) == "one two"


def test_awkward_tables(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (None, "u", "<p>a b c</p>", "x")], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.page_report(pages).collect()))
    assert got == [(0, "a b c", 5), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert html_text.page_report(pages.limit(0)).count() == 0


WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def around(*parts, after=""):
    menu = "<nav><ul>" + "".join(f'<li><a href="/">{w}</a></li>' for w in WORDS[:8]) + "</ul></nav>"
    return f"<html><body>{menu}<article><h1>The title here</h1>{''.join(parts)}</article>{after}<footer>&copy; some site 2024</footer></body></html>"


def whole(*parts):
    items = html_text.pieces("<h1>The title here</h1>" + "".join(parts))
    return html_text.text_of(items, [False] * len(items))


def test_long_tables_lists_and_formulas_stay():
    rows = lambda n: "<table>" + "".join(f"<tr><td>k{i}</td><td>v{i}</td></tr>" for i in range(n)) + "</table>"
    entries = lambda n: "<ul>" + "".join(f"<li>e{i}</li>" for i in range(n)) + "</ul>"
    terms = lambda n: "<dl>" + "".join(f"<dt>t{i}</dt><dd>d{i}</dd>" for i in range(n)) + "</dl>"
    one, two = f"<p>{prose(40, 1)}</p>", f"<p>{prose(40, 2)}</p>"
    cases = [
        (one, rows(20), two, one), (one, rows(20), two, one, two, one), (one, entries(5), "<p>End text</p>"), (one, two, rows(60)), (one, two, entries(60)), (one, two, terms(40)),
        ("<p>We have <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p>", one),
    ]
    for parts in cases:
        assert html_text.main_text(around(*parts), html_text.model()) == whole(*parts)


def test_sections_of_prose_stay_whatever_their_names():
    for name in "more related share notice alert toc side bottom form search popular tags print follow".split():
        parts = (f"<p>{prose(60, 3)}</p>", f"<p>{prose(50, 4)}</p>", f'<section class="{name}"><h2>A part</h2><p>{prose(50, 5)}</p><p>{prose(45, 6)}</p></section>')
        assert html_text.main_text(around(*parts), html_text.model()) == whole(*parts), name


def test_comments_under_any_name_stay_out():
    parts = (f"<p>{prose(40, 7)}</p>", f"<p>{prose(40, 8)}</p>")
    for name in ("feedback-thread", "c81ab3", "voices"):
        comments = f'<div class="{name}">' + "".join(f'<div class="item"><p>{prose(12, i)}</p></div>' for i in range(6)) + "</div>"
        assert html_text.main_text(around(*parts, after=comments), html_text.model()) == whole(*parts)
