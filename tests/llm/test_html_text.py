import re
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq

from tablesmith.llm import html_text

TREE = html_text.train()


class Article(HTMLParser):
    """The text of the article element, block by block, by the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in html_text.INLINE:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag not in html_text.INLINE:
            self.blocks.append("")
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def article(page):
    p = Article()
    p.feed(page)
    p.close()
    return " ".join(" ".join(b.split()) for b in p.blocks if b.split())


def test_given_pages():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    assert html_text.main_texts(pages, TREE) == [article(p) for p in pages]


def one(page):
    return html_text.main_texts([page], TREE)[0]


LONG = "The quick brown fox jumps over the lazy dog and then runs on through the dark forest until the morning comes. " * 3


def test_furniture_goes():
    body = f"<article><header><h1>Title &amp; more</h1></header><p>{LONG}<p>Short.<ul><li>one<li>two</ul>"
    page = (f"<html><head><title>T</title><style>p{{}}</style></head><body class='has-sidebar'><header><p>{LONG}</p></header>"
            f"<nav><a href='/'>Home</a></nav><div class='cookie-notice'>{LONG}</div><form><label>Name</label></form>"
            f"{body}<script>var x='</p>' + \"<p>no</p>\";</script><!-- <p>not this</p> --><div class=\"ad\">{LONG}</div>"
            f"<section id='comments'><article class='comment'><p>{LONG}</p></article></section></article>"
            f"<aside>{LONG}</aside><footer>&copy; us</footer></body></html>")
    assert one(page) == f"Title & more {LONG.strip()} Short. one two"


def test_inline_and_references():
    assert one("<article><p>a<b>b</b>c &lt;p&gt; x&nbsp;&#233;&eacute;<br>d \n\t e 1 < 2</article>") == "abc <p> x éé d e 1 < 2"
    assert one("<ARTICLE><P TITLE='a > b'>x</P><p title=\"open>y</p></ARTICLE>").startswith("x")


def test_pages_without_an_article():
    menu = "".join(f"<li><a href='/{i}'>item {i}</a></li>" for i in range(5))
    page = f"<body><ul>{menu}</ul><h2>Heading</h2><p>{LONG}</p><p>Short one.</p><p>{LONG}</p><p><a href='x'>more</a></p></body>"
    assert one(page) == f"Heading {LONG.strip()} Short one. {LONG.strip()}"
    assert one(f"<main><p>In main.</p></main><p>{LONG}</p>") == "In main."
    assert one(f"<article><p>In.</p><ol class='commentlist'><li>{LONG}</li></ol><p class=disclaimer>x</p></article>") == "In."
    assert one(f"<div id='content'><p>In.</p><div class='sidebar'>{LONG}</div></div><p>{LONG}</p>") == "In."


def test_one_paragraph_after_links():
    menu = "<ul><li><a href='/'>Home</a><li><a href='/n'>News and more</a></ul>"
    crumbs = "<p><a href='/'>Home</a> <a href='/a'>All parts of it</a></p>"
    for before in ("", menu, crumbs):
        for after in ("", "<p><a href='/'>more</a></p>", crumbs):
            for text in (LONG, LONG * 6):
                assert one(f"<body>{before}<p>{text}</p>{after}</body>") == text.strip()
    links = "".join(f"<a href='/{k}'>item {k}</a> " for k in range(12))
    assert one(f"<body><h2>Heading</h2><p>{LONG}</p><p>{links}</p><p>Made by us</p></body>") == f"Heading {LONG.strip()}"


def test_short_paragraphs_alone():
    texts = [f"This is the short paragraph with number {k} of the page." for k in range(5)]
    assert one("<body>" + "".join(f"<p>{t}</p>" for t in texts) + "</body>") == " ".join(texts)


def test_elements_without_end_tags():
    for before in ("<datalist><option value='a'><option value='b'></datalist>", "<svg class='icon'/>", "<math/>", "<option>x<b></b>",
                   "<select><option>a<option>b</select>", "<svg><title>t</title><path d=''/></svg>", "<svg>", "<video src=x>",
                   "<canvas><canvas>", "<object data=x>", "<button>"):
        assert one(f"{before}<article><p>In {before}it.</p></article>") == "In it.", before
    assert one("<article><p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <button>press</button> <object>or</object> b</p>"
               "</article>") == "a x=1 press or b"


def test_names_of_layout_and_headings():
    text = LONG.strip()
    for a, b in (("<div class='page has-sidebar'><article>", "</article></div>"), ("<div id='content' class='no-comments'>", "</div>"),
                 ("<section class='post share-enabled'>", "</section>"), ("<article><section id='header-files'>", "</section></article>"),
                 ("<article><div class='commentary'>", "</div></article>"), ("<div class='sidebar layout'><article>", "</article></div>"),
                 ("<form id=all><div class='widget'><main>", "</main></div></form>")):
        assert one(f"<body><nav>Menu</nav>{a}<p>{LONG}</p>{b}<p class='legal'>x</p></body>") == text, a
    assert one(f"<article><h2 id='related-work'>Related work</h2><p>{LONG}</p><h3 id=search>Search</h3></article>") == (
        f"Related work {text} Search")
    more = f"<section id='comments'><article><p>{LONG}</p></article></section><div id='related-posts'><p>{LONG}</p></div>"
    assert one(f"<div class='sidebar layout'><article><p>In.</p></article>{more}</div>") == "In."
    assert one(f"<article><p>In.</p></article>{more}") == one(f"<article><p>In.</p>{more}</article>") == "In."
    assert one(f"<p>{LONG}</p><p>{LONG}</p><aside><div class='content'>Widget.</div></aside>") == f"{text} {text}"
    assert one(f"<div hidden><article><p>{LONG}</p></article></div>") == ""


def test_broken_markup():
    assert one("") == "" and one("   ") == "" and one("<") == one("<p") == ""
    assert one("<article><p>x<script>never closed <p>y") == "x"
    assert one("<article><p>x<!-- never closed <p>y") == "x"
    assert one("<article><p>x</b></i></div>y<p cla") == "x y"
    assert one("<article>" + "<div><p>w" * 3000) == " ".join("w" * 3000)
    assert one("<article><p>" + "x" * 200_000 + "<p a='" + "y" * 200_000) == "x" * 200_000


def test_tree_learns_its_table():
    table = np.array([line.split() for line in html_text.LABELLED.split("\n") if line], float)
    assert (html_text.judge(TREE, table[:, :-1]) == table[:, -1]).all() and len(table) < 200


def test_rows(spark):
    rows = [(1, "u", None, "t", 5), (1, "u", None, "t", 5), (None, None, "<article>é</article>", None, None)]
    out = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, rows int"))
    assert out.columns == ["page_id", "url", "rows", "text", "n_chars"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(
        ["(1, 'u', 5, '', 0)", "(1, 'u', 5, '', 0)", "(None, None, None, 'é', 1)"])
    assert html_text.extracted(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_no_markup_left():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    assert not any(re.search(r"</?(p|b|div|article|h1)>", t) for t in html_text.main_texts(pages, TREE))


def test_names_that_only_partly_are_of_furniture():
    text = LONG.strip()
    for name in ("share-price-report", "letter-reply", "skip-bin-hire", "legal-text", "social-studies", "ad-hoc"):
        for tag in ("div", "section", "p"):
            assert one(f"<body><nav>Menu</nav><{tag} class='{name}'>{LONG}</{tag}></body>") == text, name
        assert one(f"<body><div class='{name}'><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div></body>") == f"Title {text} {text}"
    assert one(f"<body><div role=alert><p>{LONG}</p></div></body>") == text
    assert one(f"<body><main><div class='social-history'><p>{LONG}</p></div></main></body>") == text
    assert one(f"<body><p>{LONG}</p><p>{LONG}</p><div class='share-buttons'><p>{LONG}</p></div><div class='cookie-notice'>{LONG}</div>"
               f"<div class='comments-area'><p>{LONG}</p></div></body>") == f"{text} {text}"


def test_pages_of_a_few_words():
    assert one("<p>Short note.</p>") == "Short note." and one("plain text") == "plain text"
    assert one("<p>Hi there.</p><p>Ok.</p>") == "Hi there. Ok."
    assert one("<body><nav><a href='/'>Home</a></nav><p>Hi there.</p></body>") == "Hi there."
    assert one("<nav><a href='/'>Home</a></nav><footer>us</footer>") == ""


def test_teasers_and_comments_that_are_articles():
    text = LONG.strip()
    teasers = "".join(f"<article><h2><a href='/{k}'>Title of story {k}</a></h2><p>{LONG}</p></article>" for k in range(4))
    assert one(f"<body><nav><a href='/'>Home</a></nav>{teasers}</body>") == " ".join(f"Title of story {k} {text}" for k in range(4))
    short = "".join(f"<article><h2><a href='/{k}'>Story {k}</a></h2><p>What it is about in ten words or so, in short.</p></article>" for k in range(3))
    assert one(short) == " ".join(f"Story {k} What it is about in ten words or so, in short." for k in range(3))
    comment = f"<article><p>I liked it a lot. {LONG}</p></article>"
    assert one(f"<article><h1>T</h1><p>{LONG}</p>{comment}{comment}</article>") == f"T {text}"
    assert one(f"<article><h1>T</h1><article><p>{LONG}</p></article></article>") == f"T {text}"  # a wrapper is no article
