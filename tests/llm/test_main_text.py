import re
from html import unescape

from peakflow.llm import main_text as m


def article(html):
    """The article of the test pages, whose layout is known."""
    body = html.split("<article>", 1)[1].split("</article>", 1)[0]
    body = re.sub(r"<br>", " ", body)
    body = re.sub(r"</?(h1|p)>", "\0", body)
    body = unescape(re.sub(r"<[^>]*(>|$)", "", body))
    return "\n\n".join(x for b in body.split("\0") if (x := " ".join(b.split())))


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in m.extract(pages).collect():
        assert r.text == article(html[r.page_id]), r.page_id
        assert r.n_chars == len(r.text)


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body>
<header><h1>Site</h1><p>We are the site that has all the news of the world for you.</p></header>
<div class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></div>
<div id="cookie-notice"><p>We use cookies and you have to accept them, or so it says on this long line of text.</p></div>
{body}
<div class="sidebar"><p>Read this also, it is a very long teaser that has nothing to do with the article at all.</p></div>
<form><label>Mail</label><input type="text"><p>Subscribe to our letter and never miss a thing that we write.</p></form>
<section id="comments"><p>First! I think that this is a really long comment by a reader with much to say.</p></section>
<footer><p>&copy; 2020 the site, all rights are reserved by us and by nobody else.</p></footer></body></html>"""


def test_layouts():
    body = "<h2>A &amp; B</h2><p>One  long\n paragraph with a <a href='x'>link</a>, and <b>bold</b> text that goes on for a while.</p><p>Short.</p><p>1 &lt; 2 &eacute;&#233;&nbsp;x</p><ul><li>item</li></ul>"
    want = "A & B\n\nOne long paragraph with a link, and bold text that goes on for a while.\n\nShort.\n\n1 < 2 éé x\n\nitem"
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div><div><section>{}</section></div></div>", "<main><article>{}<div class='share'>Share this with all of your friends and with theirs</div></article></main>"):
        assert m.main_text(PAGE.format(body=wrap.format(body))) == want, wrap
    assert m.main_text(PAGE.format(body=f"<main><h1>Top</h1><article>{body}</article></main>")) == f"Top\n\n{want}"
    assert m.main_text(PAGE.format(body=f"<article><section><p>In a section.</p></section><ul><li>x</li></ul>{body}<ol class=commentlist><li>A comment that is long enough to matter to anybody.</ol></article>")) == f"In a section.\n\nx\n\n{want}"
    assert m.main_text(f"<body><div class='page sidebar-right'><div>{body}</div></div>") == want


def test_forms_around_content():
    body = "<h2>Title</h2><p>" + "A long paragraph of text. " * 10 + "</p><p>" + "And one more of them here. " * 10 + "</p>"
    want = "Title\n\n" + ("A long paragraph of text. " * 10).strip() + "\n\n" + ("And one more of them here. " * 10).strip()
    controls = "<input type=hidden value=x><label>Name</label><button>Send</button><select><option>No</select>"
    search = "<form role=search><p>Search all of the pages of this site for words.</p></form>"
    for page in ("<form id=aspnetForm>{}{}</form>", "<form role=form>{}{}</form>", "<form><fieldset>{}{}</fieldset></form>", "<form>{}<article>{}</article></form>", "<article><form>{}{}</form></article>"):
        assert m.main_text(f"<body>{search}{page.format(controls, body)}<footer>Ours</footer></body>") == want, page
    assert m.main_text(PAGE.format(body=f"<main>{body}<form><p>Write to us and tell us what you think of it.</p></form></main>")) == want


def test_lists_of_links_in_an_article():
    text = ("A long paragraph of text. " * 10).strip()
    refs = [f"Reference {i} to a book" for i in range(8)]
    page = f"<article><p>{text}</p><ul>{''.join(f'<li><a href=x>{r}</a></li>' for r in refs)}</ul><p>The end.</p></article>"
    assert m.main_text(PAGE.format(body=page)) == "\n\n".join([text, *refs, "The end."])
    teasers = "".join(f"<article><a href=x>{r}</a></article>" for r in refs)
    assert m.main_text(f"<body><div><p>{text}</p></div>{teasers}</body>") == text  # articles of links only are lists of links


def test_odd_pages(spark):
    assert m.main_text(None) == m.main_text("") == m.main_text(" <p> </p><!-- x") == ""
    assert m.main_text("just text & more") == "just text & more"
    assert m.main_text("<p>a<br>b<p>c &amp") == "a b\n\nc &"
    assert m.main_text("<p>a</p><p class=ad>spam<p>b") == "a\n\nb"
    assert m.main_text("<article><p>a<p>b</article><script>x='<p>no</p>'") == "a\n\nb"
    assert m.main_text("<p title='a>b'>x") == "x" and m.main_text("<p>x<div") == "x" and m.main_text("<p>1 < 2</p>") == "1 < 2"
    big = "<p>" + "word " * 200000 + "</p>"
    assert len(m.main_text(big)) == 999999
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>")], "page_id long, url string, html string")
    assert sorted(map(str, (tuple(r) for r in m.extract(df).collect()))) == sorted(map(str, [(1, None, "", 0), (None, "u", "x", 1)]))
    assert m.extract(df.limit(0)).count() == 0


def test_surge_and_dive():
    assert m.regions([]) == [] and m.regions([0, 0]) == []
    assert m.regions([200, 1, 200]) == [(0, 3)]
    assert m.regions([5, 0, 0, 0, 0, 300, 10, 0, 0, 0]) == [(3, 7)]


LONG = [f"Paragraph {i} of the text, which is long enough to be one, and says what there is to say about {i} things in all." for i in range(6)]
HTML = "".join(f"<p>{x}</p>" for x in LONG)
WANT = "\n\n".join(LONG)


def test_table_without_marks():
    """Pages whose article, menu, advert and footer are plain containers without names."""
    import pyarrow.parquet as pq

    short = 0
    for r in pq.read_table("/root/testdata/sf0.1/pages.parquet").to_pylist():
        html, want = r["html"], article(r["html"])
        bare = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", html).replace(' class="ad"', "")
        got = m.main_text(bare)
        paragraphs = want.split("\n\n")
        if sum(map(len, paragraphs)) >= 600 and max(sum(map(len, paragraphs[i : i + 3])) for i in range(len(paragraphs))) >= 500:
            assert got == want, r["page_id"]
        else:  # so short that an advert of a line is as much as the article
            short += 1
    assert short < 400


def test_names_weigh_only():
    for wrap in (
        '<div class="elementor-widget widget">{}</div><div>Another short block.</div>',
        '<div id="content" class="content with-sidebar">{}</div>',
        '<div id="content" class="content sidebar">{}<div class="sidebar"><p>Read also this one here.</p></div></div>',
        '<div class="share"><article>{}</article></div>',
        '<section id="comments-page" class="comment"><div>{}</div></section>',
    ):
        assert m.main_text(f"<body>{wrap.format(HTML)}<footer>Ours</footer></body>") == WANT, wrap
    inner = '<article>{}<div class="share-price-analysis"><p>The price of a share rose.</p></div><h2 id="related-work">Related work</h2><p>Some.</p></article>'
    assert m.main_text(PAGE.format(body=inner.format(HTML))) == f"{WANT}\n\nThe price of a share rose.\n\nRelated work\n\nSome."


def test_short_ends_without_marks():
    end = "<section><div><p>Short last words.</p></div></section>"
    want = f"{WANT}\n\nShort last words."
    for wrap in ("<div>{}{}</div>", "<div><div>{}</div>{}</div>", "<div>{}</div>{}", "<div class=text><div><div>{}</div></div><div>{}</div></div>"):
        got = m.main_text(PAGE.format(body=wrap.format(HTML, end)))
        assert got == want, wrap
    parts = "".join(f"<div><p>{x}</p></div>" for x in LONG) + "<div><p>End.</p></div>"
    assert m.main_text(PAGE.format(body=f"<div id=x>{parts}</div>")) == f"{WANT}\n\nEnd."


def test_unnamed_comments():
    comments = "".join(f"<div><b>Reader {i}</b><p>I have read all of this and think {i} times that it is a very long text indeed.</p></div>" for i in range(5))
    for wrap in ("<div>{}<section><h3>Comments</h3>{}</section></div>", "<div>{}</div><div><h3>5 Comments</h3>{}</div>", "<article>{}<div><h4>Leave a comment</h4>{}</div></article>", "<div>{}<h3>Kommentare (5)</h3><div>{}</div></div>"):
        assert m.main_text(f"<body>{wrap.format(HTML, comments)}</body>") == WANT, wrap
    assert m.main_text(f"<article><h2>Comments</h2><p>On style.</p>{HTML}</article>").endswith(WANT)  # a chapter of the article


def test_menus_and_teasers_without_names():
    menu = "<div><ul>" + "".join(f"<li><a href=x>Part {i} of the site</a></li>" for i in range(9)) + "</ul></div>"
    teaser = "<div><p>Read this too.</p></div>"
    page = f"<body><div id=a>{menu}{teaser}<div><h1>Title</h1>{HTML}<p>End.</p></div>{teaser}{menu}<div>All rights reserved.</div></div></body>"
    assert m.main_text(page) == f"Title\n\n{WANT}\n\nEnd."


def brute_regions(counts):
    """Maximal runs of lines at which a window with text begins, from the definition."""
    at = lambda i: sum(counts[i + d] for d in range(m.WINDOW) if i + d < len(counts))
    top = max((at(i) for i in range(len(counts))), default=0)
    out = []
    for a in range(len(counts)):
        for b in range(a + 1, len(counts) + 1):
            whole = all(at(i) > 0 for i in range(a, b)) and (a == 0 or not at(a - 1)) and (b == len(counts) or not at(b))
            if whole and max(at(i) for i in range(a, b)) >= m.SHARE * top:
                out.append((a, b))
    return out


def test_regions_equal_definition():
    import random

    rnd = random.Random(3)
    for _ in range(400):
        counts = [rnd.choice([0, 0, 0, 1, 5, 40, 300]) for _ in range(rnd.randint(0, 18))]
        assert m.regions(counts) == brute_regions(counts), counts


def test_large_pages_in_linear_time():
    import time

    pages = ["<div>" * 60_000 + "".join(f"<p>x<b>y</b></i>{i}" for i in range(30_000)), "<div><p>a</p>" * 60_000 + "<h3>5 Comments</h3>" + "</b>" * 60_000, "<div class=ad>" * 50_000 + HTML, "<nav>" * 50_000 + "<li>" * 50_000, "<" * 300_000, "<a " * 200_000, "&lt" * 200_000]
    for page in pages:
        t = time.time()
        m.main_text(page)
        assert time.time() - t < 10
