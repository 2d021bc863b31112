"""Main text of pages, and WARC archives."""

from __future__ import annotations

import base64
import hashlib
import time

from splitlane.llm.common import fresh_path
from splitlane.llm.html_tree import hashed, main_text, parse
from splitlane.llm.site_templates import extracted
from splitlane.llm.warc import archive_rows, archived, read_archive, write_archive

SCHEMA = "page_id long, url string, html string, text string, salt string"


def text_of(html: str) -> str:
    return main_text(parse(html), set())


def test_furniture_goes_and_blocks_stay():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav><header>top</header>"
        "<div class='Ad-box ad'>buy</div><article><h1>A &amp; B</h1><p><b>one<br>two<p>three\n  four<script>var t='</p>';</script>"
        "<div class=comments><p>first!</p></div><form>mail</form><ul><li>x<li>y</ul></article><footer>end</footer>"
    )
    assert text_of(page) == "A & B\n\none two\n\nthree four\n\nx\n\ny"
    assert text_of("") == "" and text_of("a < b <p>c") == "a < b\n\nc"
    assert text_of("<body><div>plain</div><aside>no</aside></body>") == "plain"


def test_text_outside_teasers_and_in_ambiguous_classes_stays():
    body = "".join(f"<p>long text of the page {k}</p>" for k in range(20))
    cards = "".join(f"<article class=card><p>teaser {k}</p></article>" for k in range(3))
    for part in ("main", "div"):
        got = text_of(f"<body><nav>menu</nav><{part}>{body}</{part}>{cards}</body>")
        assert all(f"long text of the page {k}" in got for k in range(20)) and "menu" not in got
    for words in ("related-work", "social-science", "menu-of-the-day", "notice"):
        assert text_of(f"<article><p>one</p><section class={words}><p>two</p></section></article>") == "one\n\ntwo"
    root = parse("<article><p>one</p><div class=share><b>Share this page</b><i>x</i></div><div class=share><p>own words</p></div></article>")
    hashed(root)
    share = root.children[0].children[1].children[0]
    assert main_text(root, {int.from_bytes(share.digest, "little", signed=True)}) == "one\n\nown words"


def test_class_words_in_other_company_and_data_attributes_keep_text():
    for words in ("comment-on-method", "promo-results", "has-sidebar", "comments-open", "banner-of-the-day"):
        assert text_of(f"<article><p>one</p><section class={words}><p>two</p></section></article>") == "one\n\ntwo"
        assert text_of(f"<body><article class='post {words}'><p>one</p></article></body>") == "one"
    for words in ("ad", "ad-slot-3", "site-footer", "comment-list", "cookie-banner", "x sidebar_left", "promo"):
        assert text_of(f"<article><p>one</p><div class='{words}'><p>two</p></div></article>") == "one"
    assert text_of("<p data-hidden x>seen") == "seen" and text_of("<p aria-hidden=false>seen") == "seen"
    assert text_of("<p hidden>no</p><p x hidden y>no</p><p hidden=''>no</p><p>yes") == "yes"
    root = parse("<article><p>one</p><div class=comment-on-method><b>Rate this</b></div></article>")
    hashed(root)
    recurring = root.children[0].children[1].children[0]
    assert main_text(root, {int.from_bytes(recurring.digest, "little", signed=True)}) == "one"


def test_broken_pages_take_linear_time():
    pages = [
        lambda n: "<b>" * n + "</i>" * n, lambda n: "<b>" * n + "<hr>" * n, lambda n: "<ul>" + "<b>" * n + "<li></li>" * n,
        lambda n: "<p>" + "<b>" * n + "</p><p>" * n, lambda n: "<title>" + "</title" * n, lambda n: "<div class=menu>" * n + "x",
        lambda n: "<ul><li><ul>" + "<b>" * n + "<li></li>" * n, lambda n: "<a href='" * n, lambda n: "<!--" * n,
    ]
    for page in pages:
        start = time.perf_counter()
        root = parse(page(30_000))
        hashed(root)
        main_text(root, {0})
        assert time.perf_counter() - start < 6


def test_what_a_site_repeats_goes_but_copied_articles_stay(spark):
    note = "<p>Join our club today</p>"
    rows = [(k, f"http://a.example.com/{k}", f"<article><h1>T{k}</h1><p>Body {k}</p>{note}<p>More {k}</p></article>", "x", "y") for k in range(20)]
    rows += [(100 + k, f"http://b.example.com/{k}", f"<article><h1>Same</h1><p>Copy</p>{note}<p>End</p></article>", "x", "y") for k in range(20)]
    rows += [(200, None, None, None, None), (201, "not a url", "", "x", "y"), (201, "not a url", "", "x", "y"), (None, "http://a.example.com/n", "<p>lone", None, None)]
    got = [(r.page_id, r.text) for r in extracted(spark.createDataFrame(rows, SCHEMA)).select("row.page_id", "out.text").collect()]
    assert len(got) == len(rows)
    texts = dict(got)
    assert texts[3] == "T3\n\nBody 3\n\nMore 3"
    assert texts[103] == "Same\n\nCopy\n\nJoin our club today\n\nEnd"
    assert texts[200] == texts[201] == "" and texts[None] == "lone"
    assert extracted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_of_template_blocks_and_section_notices_go(spark):
    page = "<body><div>banner</div><div>notice</div><div>mid</div><div>BODY {}</div><div>links</div><div><b>legal</b></div></body>"
    rows = [(k, f"http://c.example.com/{k}", page.format(k), "x", "y") for k in range(60)]
    rows += [(100 + k, f"http://d.example.com/{'news' if k < 20 else 'shop'}/{k}", f"<div>Item {k}</div>{'<div>Of the news desk</div>' * (k < 20)}<div>More {k}</div>", "x", "y") for k in range(60)]
    rows += [(200 + k, f"http://e.example.com/{k}", f"<article><p>Same</p><p>copy</p></article><div>Side {k}</div>", "x", "y") for k in range(20)]
    texts = dict(extracted(spark.createDataFrame(rows, SCHEMA)).select("row.page_id", "out.text").collect())
    for k in range(60):
        assert texts[k] == f"BODY {k}"
        assert texts[100 + k] == f"Item {k}\n\nMore {k}"
    assert "Same\n\ncopy" in texts[203]


def test_archives_round_trip(spark):
    rows = [
        (5, "http://x/\r\ny", "<p>é</p>", None, None), (2, None, "<p>é</p>", None, None), (7, "u", None, None, None),
        (8, "u", "", None, None), (2, None, "<p>é</p>", None, None), (None, "n", "<p>é</p>", None, None), (9, "v", "z" * 200_000, "a", "b"),
    ]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = sorted(archived(pages).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html[r.page_id]).digest()).decode()
    assert [(r.page_id, r.warc_type, r.refers_to) for r in got] == [
        (2, "response", None), (2, "response", None), (5, "revisit", 2), (7, "response", None), (8, "revisit", 7),
        (9, "response", None), (None, "revisit", 2),
    ]
    assert archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filters_reach_the_reader(spark):
    pages = spark.createDataFrame([(k, f"u{k % 3}", f"<p>{k % 4}", None, None) for k in range(12)], SCHEMA)
    path = fresh_path(spark, "warc-test")
    write_archive(archive_rows(pages, "page_id", "url", "html", least_bytes=0), path)
    only = read_archive(spark, path, payload=False).where("warc_type = 'revisit' and url = 'u1'")
    assert sorted(r.page_id for r in only.collect()) == [4, 7, 10]
    assert all(r.payload is None for r in only.collect())
    full = read_archive(spark, path).where("warc_type = 'response'").collect()
    assert {bytes(r.payload) for r in full} == {b"<p>0", b"<p>1", b"<p>2", b"<p>3"}
    loose = archive_rows(pages, "page_id", "url", "html", least_bytes=100)
    assert loose.where("warc_type = 'revisit'").count() == 0
