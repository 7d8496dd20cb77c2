import html
import re
import time
from collections import Counter

from yieldlens.llm import html_text
from yieldlens.llm.html_text import main_text

SF = "/root/testdata/sf0.001"


def test_pages_against_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: " ".join(html.unescape(re.sub("<[^>]*>", " ", re.search("<article>(.*?)</article>", r.html, re.S)[1]))
                                .split()) for r in pages.collect()}
    got = html_text.extract_main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_hand_made_pages():
    page = ("<html><head><title>T</title><script>if (a<b) {x('<p>no</p>')}</script></head><body>"
            "<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
            "<div id=content><h1>A &amp; B</h1><p>First   para&shy;graph<br>goes\non <a href=x>here</a>.<p>Second &lt;one&gt;."
            "<div class=ad>Buy</div><p>Third.</div><aside>More</aside><form><p>Mail</p></form>"
            "<div class=comments><p>A reader wrote at length about all of this and that</p></div>"
            "<footer>&copy; us</footer></body></html>")
    assert main_text(page) == "A & B First para\xadgraph goes on here. Second <one>. Third."
    assert main_text(None) == main_text("") == main_text("<p></p><script>x") == ""
    assert main_text("plain &amp;lt; text <b>bold") == "plain &lt; text bold"
    assert main_text("<main><p>a</p></main><p>" + "outside " * 50 + "</p>") == "a"
    assert main_text("<p>" + "x " * 200000) == " ".join("x" * 200000)


def test_stretches():
    assert html_text.stretches([0, 0, 5, 0, 7, 0, 0, 0, 2, 0]) == [(2, 4), (8, 8)]
    assert html_text.stretches([]) == []


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, None, None, "x"), (None, "u", "<p>a</p>", None), (1, None, None, "x")]
    got = html_text.extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "", 0), ("1", "", 0), ("None", "a", 1)]
    assert html_text.extract_main_text(spark.createDataFrame([], schema)).collect() == []


def test_unmarked_article_interrupted_by_a_box():
    box = "<div class=ad>" + "<p>Buy this now</p>" * 4 + "</div>"
    links = "<ul>" + "<li><a href=x>Another page of ours</a></li>" * 4 + "</ul>"
    for cut in (box, links):
        for first, last in (("<p>First part.</p><p>More of it.</p>", "<p>Last part.</p>"),
                            ("<div>First part.</div>", "<div>Last.</div>"), ("<p>First part.", "<p>Last.")):
            page = f"<body><div id=top><p>Tag line</p></div>{links}<div id=content>{first}{cut}{last}</div></body>"
            assert main_text(page) == " ".join(re.sub("<[^>]*>", " ", first + last).split())
    a, b = "a long paragraph " * 20, "another paragraph " * 9
    page = f"<div class=row><div class=col><p>{a}<p>{a}</div></div>{box}<div class=row><div class=col><p>{b}</div></div>"
    assert main_text(page) == (a + a + b).strip()
    assert main_text(f"{a}{box}{b}") == (a + b).strip()


def test_wrappers_named_after_the_layout():
    text = "<h1>Title</h1><p>The first paragraph.</p><div class=ad>Buy</div><p>The second.</p>"
    want = "Title The first paragraph. The second."
    side = "<div class=sidebar><p>Some other box</p></div>"
    opens = [f"<div class='{c}'>" for c in ("row has-sidebar", "no-sidebar", "content-sidebar-wrap", "sidebar", "widget menu",
                                            "legal", "banner", "page-header-content")] + ["<form>", "<form><div class='nav-left'>"]
    for start in opens:
        end = "</div></form>" if "<form>" in start else "</div>"
        for a, b in (("<article>", "</article>"), ("<main>", "</main>"), ("", "")):
            page = f"<body><nav><a href=/>Home</a></nav>{start}{a}{text}{b}{side}{end}<footer>(c) us</footer></body>"
            assert main_text(page) == want, page
            assert main_text(f"<main>{start}{a}{text}{b}{side}{end}</main>") == want
    for box in ("<div class=sidebar>", "<aside>", "<div class=related>", "<div hidden>"):
        page = f"<article>{text}</article>{box}<article><p>A teaser</p></article></div></aside>"
        assert main_text(page) == want
    assert main_text(f"<div hidden><article>{text}</article></div>") == ""
    talk = "<p>A reader wrote at length. </p>" * 20
    assert main_text(f"<div id=content>{text}</div><div class=comments>{talk}</div>") == want
    assert main_text(f"<nav>Menu</nav><footer>{talk}</footer>") == ""


def words(text):
    return Counter(text.split())


def test_time_follows_the_length():
    """1 MB of tags that never end, 50,000 open elements, quotes that do not pair off, ... in a few seconds each."""
    pages = ["<div class=comment>x " * 50_000, "<a " * 350_000, "<![CDATA[" * 110_000, '<a "' * 250_000, "<div>x" * 150_000,
             '<a "<b>" x' * 100_001, "<!x" * 300_000, "</p>" * 250_000, "<b>" * 100_000 + "x</div>" * 50_000, "<" * 1_000_000,
             "<span class=ad><i>a</b>" * 50_000, "<article><form>x" * 50_000, "<a '\"<b>" * 110_001, "<script>" * 120_000]
    for page in pages:
        start = time.time()
        main_text(page)
        assert time.time() - start < 20, page[:40]


def test_broken_markup_keeps_its_text():
    assert main_text("one <b two") == "one <b two"
    assert main_text("<p title=\"it's\">a</p><p class='x\">b</p>") == "a b"
    assert main_text("a <![CDATA[b & <i>]]> c <![CDATA[ d") == "a b & <i> c <![CDATA[ d"
    assert main_text("<p>a<!-- <p>b") == "a"


def test_windows_decide():
    """The surge threshold chooses the lines, in marked pages as in others."""
    box = "<div class=ad>Buy</div>" * 3
    page = f"<article><p>tiny</p><p>all of it</p>{box}<p>" + "a long paragraph " * 9 + "</p></article>"
    assert main_text(page).startswith("tiny all of it a long")
    for html_ in (page, page.replace("article", "div")):
        kept = [len(main_text(html_, surge=s)) for s in (1, 80, 2000, 10 ** 6)]
        assert kept == sorted(kept, reverse=True) and kept[-1] == 0 and len(set(kept)) > 2


def test_pages_without_marks_tags_and_names(spark):
    """Layout tags and the names of classes taken away, the windows alone find the article: all of it, and little else."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = wanted = both = 0
    for r in pages:
        want = words(main_text(r.html))
        bare = re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", r.html)
        bare = re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|form|section)\b", r"<\1div", bare)
        got = words(main_text(bare))
        found, wanted, both = found + got.total(), wanted + want.total(), both + (got & want).total()
    assert both / wanted >= 0.99 and both / found >= 0.9
