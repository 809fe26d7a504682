"""Main text of pages."""

from shelfspark.llm.page_text import Page, extract

SCHEMA = "page_id long, url string, html string"


def texts(spark, pages):
    return {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(pages, SCHEMA)).collect()}


def test_regions_that_are_not_main_text():
    page = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar">
    <header><h1>Site</h1><form><input></form></header><div class="cookieNotice"><p>We use cookies.</p></div>
    <div id="main-content"><article><h1>A &lt;title&gt;</h1><p>First   <b>part</b>\n of it.<br>More<p>Second
    &eacute;&#233;&nbsp;x<script>var a="</p>";</script><!-- not this --></article>
    <div class="ad-slot">Buy</div><section id="comments"><p>So good!</p></section></div>
    <aside>Other</aside><nav><a href=/>Home</a></nav><div style="display:none">x</div><footer>(c)</footer>"""
    assert Page(page).main_text(None) == "A <title>\n\nFirst part of it. More\n\nSecond éé x"


def test_broken_pages():
    for page, want in {"": "", "plain": "plain", "<p>a<p>b</foo": "a\n\nb", "<script>x": "", "a<!-- b": "a",
                       "<ul><li>a<li>b</ul>": "a\n\nb", "</div></p>x": "x", "<": "<", "a < b": "a < b"}.items():
        assert Page(page).main_text(None) == want


def test_hosts_agree_on_a_path(spark):
    page = '<div class="page"><div class="teaser-{0}"><b>{1}</b></div><div class="text-{0}"><p>{2}</p></div></div>'
    rows = [(k, f"https://www.a.example/{k}", page.format(k, "short teaser", "body " * 40)) for k in range(5)]
    # Here the teaser is far longer than the text; alone, the page would choose it.
    rows += [(8, "http://A.example:80/x", page.format(9, "teaser " * 50, "body " * 75)),
             (9, "http://other.example/x", page.format(9, "teaser " * 60, "body " * 3)),
             (10, None, "<p>no host</p>"), (11, "not a url", None), (8, "http://a.example", "")]
    found = extract(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {}
    for r in found:
        assert r["n_chars"] == len(r["text"])
        got.setdefault(r["page_id"], set()).add(r["text"])
    assert got[0] == {("body " * 40).strip()}
    assert got[8] == {("body " * 75).strip(), ""}
    assert got[10] == {"no host"} and got[11] == {""}
    assert len(found) == len(rows)


def test_articles_of_the_table(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split("</?(?:p|h1)>", inner)]
        assert found[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_no_pages(spark):
    assert texts(spark, []) == {}


def test_all_main_text_beside_an_inner_region_stays():
    body = "entry words " * 60
    page = (f"<body><div class=post><div class=entry><p>{body}</p></div><blockquote>A quotation of some"
            "</blockquote><ul><li>first thing<li>second thing</ul><h3>A heading</h3><table><tr><td>a cell"
            "<td>b</table><pre>code</pre></div><nav><a href=/>Home</a></nav></body>")
    assert Page(page).main_text(None).split("\n\n") == [
        body.strip(), "A quotation of some", "first thing", "second thing", "A heading", "a cell", "b", "code"]


def test_a_class_that_only_sounds_like_a_notice():
    body = "the court decided " * 40
    page = f'<body><div class="post legal-news"><p>{body}</p></div><div class=sidebar><p>Short other text</p></div>'
    assert Page(page).main_text(None) == body.strip()
    page = (f"<article><p>{body}</p><div class='related-work'><p>Others have done this before.</p></div>"
            "<div class=related-posts><a href=/1>One more post</a> <a href=/2>Another post</a></div></article>")
    assert Page(page).main_text(None) == f"{body.strip()}\n\nOthers have done this before."


def test_winning_path_does_not_drop_the_rest(spark):
    page = "<body><div class=wrap><div class=one><p>{0}</p></div><div class=two><p>{1}</p></div></div></body>"
    rows = [(k, f"http://h.example/{k}", page.format("first part " * 40, "x")) for k in range(6)]
    rows.append((9, "http://h.example/9", page.format("first part " * 40, "second part " * 35)))
    found = texts(spark, rows)
    assert found[9] == ("first part " * 40).strip() + "\n\n" + ("second part " * 35).strip()


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    for page in ("<div><p>" * 50_000 + "text", "<ul>" + "<div>" * 20_000 + "<li>x</li>" * 20_000,
                 "<div><section>" * 30_000 + "</article>" * 30_000, "<p>word " * 100_000):
        start = time.perf_counter()
        kept = Page(page)
        assert kept.main_text(kept.path(kept.candidate())) is not None
        assert time.perf_counter() - start < 4


def test_further_columns(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "http://a.example", "<p>one</p>")], SCHEMA)
    for name in ("host", "winner", "text", "n_chars", "path"):
        rows = rows.withColumn(name, F.lit("mine"))
    assert [tuple(r) for r in extract(rows).collect()] == [(1, "http://a.example", "one", 3)]
