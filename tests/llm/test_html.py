import random
import re
import time

import pytest

from shutterlake.llm import html as module
from shutterlake.llm.common import table
from shutterlake.llm.html import extract, is_unwanted, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="ad">Buy &amp; win</div>
<article><h1>Head&nbsp;line</h1><p>First <b>bold
text</b> here &amp; there &eacute;.<p>Second paragraph without an end, long enough to count as content.</p><p>No.</p>
<form><input><label>Mail</label></form><script>x</script><div class="comments"><p>I agree</p></div></article>
<aside><p>Side bar</p></aside><footer>&copy; x</footer></body>"""


def test_page():
    assert main_text(PAGE) == "Head line\nFirst bold text here & there é.\nSecond paragraph without an end, long enough to count as content.\nNo."


def test_without_article():
    text = "long words of a real paragraph " * 5
    page = f"<body><nav><a>a</a><a>b</a></nav><div id=wrap><div class=sidebar>x</div><div id=c><h2>Title</h2><p>{text}</p><p>Short.</p><p>{text}</p></div></div><footer>f</footer></body>"
    assert main_text(page) == "\n".join(["Title", text.strip(), "Short.", text.strip()])


def test_awkward():
    assert [main_text(x) for x in ("", " ", "<", "<p", "plain &lt;text&gt;", "<p></p>")] == ["", "", "<", "<p", "plain <text>", ""]
    assert main_text("<div>" * 3000 + "deep text") == "deep text"


def test_table_and_nulls(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    want = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract(pages).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", want[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", __import__("html").unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:h1|p)>|<br>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>a</p>", 2), (1, "u", "<p>a</p>", 2)], "page_id long, url string, html string, text int")
    assert sorted(r["text"] for r in extract(odd).collect()) == ["", "a", "a"]
    assert extract(odd.where("false")).collect() == []


PROSE = "A long sentence of plain words that a reader would want to keep, with commas and all. " * 3
SHAPES = {
    "divs": ("<body><div><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></div><div><h2>Title</h2><p>{0}</p><p>Short.</p><p>{0}</p></div><div><a href=/x>Imprint</a></div></body>", "Title\n{0}\nShort.\n{0}"),
    "table": ("<table><tr><td><a href=a>A</a><br><a href=b>B</a></td><td><p>{0}</p><p>{0}</p></td></tr></table>", "{0}\n{0}"),
    "form": ("<form id=aspnetForm><div id=top><a href=x>x</a><a href=y>y</a></div><div><p>{0}</p><p>{0}</p><form><p>Your name</p></form></div></form>", "{0}\n{0}"),
    "main": ("<main><section><h1>T</h1><p>{0}</p></section><section class='comments'><p>Nice</p></section></main><aside>{0}</aside>", "T\n{0}"),
    "sections": ("<section><ul><li><a href=1>first link</a><li><a href=2>second link</a><li><a href=3>third link</a></ul></section><section><p>{0}<p>{0}<p>End.</section>", "{0}\n{0}\nEnd."),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    page, want = (x.format(PROSE.strip()) for x in SHAPES[name])
    assert main_text(page) == want


def test_the_ratio_decides_without_article(monkeypatch):
    """A list of links with more text than the article: only the smoothed ratios tell them apart."""
    links = "".join(f"<li><a href=/{k}><b>Another</b> <i>story</i> number {k} of the whole archive</a></li>" for k in range(60))
    page = f"<body><div><ul>{links}</ul></div><div><p>{PROSE}</p><p>{PROSE}</p></div></body>"
    assert main_text(page) == f"{PROSE.strip()}\n{PROSE.strip()}"
    monkeypatch.setattr(module, "content_lines", lambda lines: module.np.ones(len(lines), bool))
    assert "Another story" in main_text(page)


def test_names_are_matched_as_whole_tokens():
    assert [x for x in ("sidebar-left", "ad", "siteFooter", "cookie_notice box", "comments-area", "social-theory", "notice-board", "address", "shadow", "menuetto", "main-content") if is_unwanted(x)] == ["sidebar-left", "ad", "siteFooter", "cookie_notice box", "comments-area"]
    page = "<article><div class=social-theory><p>One</p></div><p class='notice-board'>Two</p><math><mi>x</mi></math><p class=notice>gone</p></article>"
    assert main_text(page) == "One\nTwo\nx"


def test_malformed_markup():
    assert main_text("<![foo[x]]>a") == "a" and main_text("<![if !IE]>a<![endif]>") == "a" and main_text("<![CDATA[x") == ""
    assert main_text("<p>a</p><!-- never ends <p>b</p>") == "a"
    assert main_text('<!DOCTYPE html [<!ENTITY x "y>">]><p>a') == "a"
    rng = random.Random(1)
    bits = ["<", ">", "<!", "<![", "]]>", "<!--", "-->", "<?", "<p>", "</p>", "<b", "</", "<div class=", "'", '"', "=", "&#", "&amp", ";", "<form>", "<li>", "<ul>", "</ul>", "<script>", "</script>", "<!DOCTYPE", "[", "]", "x", " ", "\0", "<article>", "</article>", "<a href=x>", "</a>", "<br/>", "<title>"]
    for _ in range(20_000):
        main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 14))))


def test_deep_and_crossed_elements_take_linear_time():
    took = []
    for n in (4_000, 16_000):
        began = time.time()
        main_text("<b>" + "<div><span></b>" * n)
        main_text("<div><p>x" * n)
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 1


LONG = "A sentence of the text that is long enough to be told from a menu by its ratio of words to tags. " * 3
MENU = "<ul>" + "".join(f'<li><a href="/{i}">link {i}</a></li>' for i in range(8)) + "</ul>"
LAYOUTS = {
    "sibling articles are all kept": (f"<body><article><p>one short</p></article><article><p>{LONG}</p></article><article><p>{LONG}</p></article></body>", ["one short", LONG, LONG]),
    "an article inside one is a reader's": (f"<article><p>{LONG}</p><p>more</p><article><p>nice read</p></article><article><p>I agree</p></article></article>", [LONG, "more"]),
    "an inner article with most of the text is the text": (f"<article><p>lead</p><article><p>{LONG}</p></article></article>", [LONG]),
    "reply blocks by their names": (f'<article><p>{LONG}</p><div class="replies"><p>{LONG}</p></div><div class="feedback-thread"><p>no</p></div></article>', [LONG]),
    "a list of links inside": (f"<main><p>{LONG}</p>{MENU}<p>end</p></main>", [LONG, "end"]),
    "a list with words stays": (f"<main><p>{LONG}</p><ul><li>first of the list</li><li>second of the list</li></ul></main>", [LONG, "first of the list", "second of the list"]),
    "main around articles": (f"<main><article><p>{LONG}</p></article><article><p>short</p></article></main>", [LONG, "short"]),
    "links inside sentences stay": (f'<article><p>{LONG}<a href="/x">more of it</a></p><p>see <a href="/y">this</a> for what follows there</p></article>', [f"{LONG.strip()} more of it", "see this for what follows there"]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_page_shapes(name):
    page, want = LAYOUTS[name]
    assert main_text(page).replace(LONG.strip() + "more", LONG.strip() + " more") == "\n".join(w.strip() for w in want)


def test_ratio_decides_what_no_name_marks(monkeypatch):
    page, want = LAYOUTS["a list of links inside"]
    assert main_text(page) == "\n".join(w.strip() for w in want)
    monkeypatch.setattr(module, "content_lines", lambda lines: module.np.ones(len(lines), bool))
    assert "link 3" in main_text(page)
