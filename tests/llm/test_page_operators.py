"""Main text and web archives."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from molsift.llm import warc
from molsift.llm.html_text import extract, extract_main_text
from molsift.session import ensure_checkpoint_dir
from tests.llm.fixtures import same_rows

PARAGRAPH = "One sentence of the story that is long enough to weigh, and another that follows it closely. " * 2
P = " ".join(PARAGRAPH.split())


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""),
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href='/'>x</a></li></ul></nav><article><h1>Head</h1><p>a &amp; b &lt;c&gt;\n  d<p><b>e</b>f</article><footer>&copy; z</footer></body></html>",
     "Head\na & b <c> d\nef"),
    ("<body><div class='ad'>buy</div><article><p>text<script>var t='</p>'</script> more</p><aside>side</aside><div class='share-buttons'>x</div><p>&#233;&nbsp;x</p></article><section id=comments><p>" + P + "</p></section>",
     "text more\né x"),
    ("<body><div class=menu><a>one</a><a>two</a></div><div><p>" + P + "</p><p>short</p><p>" + P + "</p></div><div class='sidebar'>" + P + "</div>", f"{P}\nshort\n{P}"),
    ("<article><p>cut off in a ta</p><p>and then <b", "cut off in a ta\nand then"),
    ("<article><p>lone &am", "lone &am"),
    ("<article><!-- <p>no</p> --><p>1 < 2</p><table><tr><td>a</td><td>b</td></tr></table></article>", "1 < 2\na b"),
    ("plain text without any markup", "plain text without any markup"),
    ("<div class='layout with-sidebar'><div class=main-nav><a>m</a></div><article><header><h1>T</h1></header><p>body</p></article><div class=related><article><p>other</p></article></div></div>", "T\nbody"),
    ("<header class=site-header><h1>Site</h1></header><div class='cookie-notice'><p>" + P + "</p></div><main><div class=article-header><h1>T</h1></div><p>x</p><form><input><p>f</p></form></main><div id=disqus_thread>" + P + "</div>", "T\nx"),
])
def test_extract(page, want):
    assert extract(page) == want


@pytest.mark.parametrize("page,want", [
    ("<body><p class=notice>cookies<p>" + P + "<p>" + P + "</body>", f"{P}\n{P}"),
    ("<body><article><p class=notice>cookies<p>a<p>b</article></body>", "a\nb"),
    ("<body><article><div><p>a</p><ul><li class=share>share</ul></div><p>b</p></article></body>", "a\nb"),
    ("<article><ul><li class=share>share<li>one<li>two</ul><p>b</article>", "one\ntwo\nb"),
    ("<article><div><p class=notice>cookies</div>a<p>b</article>", "a\nb"),
    ("<article><dl><dt class=ad>ad<dd>a</dl><table><tr><td class=ad>ad<td>a<tr><td>b</table><p>c</article>", "a\na\nb\nc"),
    ("<body><article><div class=sidebar><div>x</div><p>y<p>z</div><p>a</article>", "a"),
    ("<body><form action=/><div class=menu><a>m</a></div><article><p>a<p>b</article><input></form></body>", "a\nb"),
    ("<body><form><div><p>" + P + "</p><select><option>x<option>y</select><p>" + P + "</p></div></form></body>", f"{P}\n{P}"),
    ("<body><div>" + P + "</div><form><label>name</label><p>short hint</p></form></body>", P),
])
def test_ends_of_skipped_elements(page, want):
    assert extract(page) == want


@pytest.mark.parametrize("page,want", [
    ("<article><p class=it's>one</p><p>it's two</p></article>", "one\nit's two"),
    ("<article><p>see <a href=\"x\"\">here</a> now</p></article>", "see here now"),
    ("<article><p title='a > b' data-x=\"c > d\">text</p></article>", "text"),
    ("<article><p title=\"never closed>one</p><p>two</p></article>", "one\ntwo"),
    ("<article><p a=b/c = 'd' e>text</p><br/><hr / >end</article>", "text\nend"),
    ("<article><img alt='a>b' src=x/><p>=</p></article>", "="),
    (f"<div class='post-content with-sidebar'><p>{P}</p><p>{P}</p></div>", f"{P}\n{P}"),
    (f"<div class='container sidebar-right'><div class=sidebar>{P}</div><p>{P}</p><p>{P}</p></div>", f"{P}\n{P}"),
    (f"<article><h1>Drug</h1><section class=side-effects><p>{P}</p></section></article>", f"Drug\n{P}"),
    (f"<body><div>{P}{P}{P}</div><div class='sidebar-left'><p>menu of things to see</p></div></body>", P * 3 if P.endswith(' ') else " ".join((P + P + P).split())),
    ("<p " + "a" * 20000 + "='" + "b" * 20000 + "'>x</p>", "x"),
    ("<p " + "a " * 20000 + "<p>x</p>", "x"),
])
def test_attributes_and_weak_names(page, want):
    assert extract(page) == want


CARD = "<div class=cards><article><h3><a href=/2>Another story</a></h3></article></div>"
TEASER = "<article><h3><a href=/2>Another story</a></h3><p>in short</p></article>"


@pytest.mark.parametrize("page,want", [
    (f"<body><div><div>{P}</div><p>short</p><div>{P}</div></div>{CARD}</body>", f"{P}\nshort\n{P}"),
    (f"<body>{CARD}<div><h1>Head</h1><p>{P}</p><p><a>link</a></p><p>{P}</p></div></body>", f"Head\n{P}\nlink\n{P}"),
    (f"<body>{TEASER}<div><p>{P}</p></div></body>", f"Another story\nin short\n{P}"),
    (f"<body><p>by someone</p>{CARD}<p>a crumb</p></body>", "Another story"),
    (f"<body><p>a crumb</p><article><ul><li><a>one</a><li><a>two</a></ul><p>{P}</p><p>x</p><p><a>source</a></p></article><p>a crumb</p><ul><li><a>{P}</a></ul></body>", f"one\ntwo\n{P}\nx\nsource"),
])
def test_windows_decide_beside_articles(page, want):
    assert extract(page) == want


def test_extract_table(spark):
    rows = [(1, "u", "<article>x</article>", "clash"), (None, None, None, "clash"), (1, "u", "<article>x</article>", "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert same_rows(extract_main_text(df).collect(), [(1, "u", "x", 1), (None, None, "", 0), (1, "u", "x", 1)])
    assert extract_main_text(df.limit(0)).collect() == []


def test_articles_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()}
    import html as H
    import re
    for r in pages.collect():
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r["html"])[1]
        blocks = [" ".join(H.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


BIG = "<p>" + "payload " * 40 + "</p>"
PAGES = [(5, "http://a.example.com/x?y=1#f", BIG, "z"), (2, "http://b.example.org/", BIG, "z"), (9, "http://a.example.com/x?y=1", BIG, "z"),
         (1, None, "small", "z"), (3, "not a url \n", "small", "z"), (4, "http://[bad/", None, "z"), (6, "http://a.example.com:8080/é ü", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 5, "z"),
         (7, "http://c.example.com/", "", "z"), (None, "http://d.example.com/", "n", "z"), (2, "http://b.example.org/", BIG, "z"), (8, "http://a.example.com/x?y=1#f", "漢字" * 90, "z")]


def pages_of(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string, data string").repartition(3)


@pytest.mark.parametrize("block_rows,file_bytes", [(512, 1 << 20), (2, 600)])
def test_warc_round_trip(spark, block_rows, file_bytes):
    got = warc.archive_and_read(pages_of(spark), block_rows=block_rows, file_bytes=file_bytes).collect()
    want = []
    for k, _, body, _ in PAGES:
        raw = (body or "").encode()
        revisit = body == BIG and k != 2
        want.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert same_rows(got, want)


def test_empty_pages(spark):
    assert warc.archive_and_read(pages_of(spark).limit(0)).collect() == []


def test_look_up_by_search(spark):
    path = f"{ensure_checkpoint_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    rows = [(i, f"http://h{i % 7}.example.com/p{i}", f"page {i}", "") for i in range(60)]
    warc.write_archives(pages_of(spark, rows), f"{path}/a", file_bytes=2000)
    warc.write_index(warc.scan_archives(spark, f"{path}/a"), f"{path}/i", block_rows=4)
    keys = [r[0] for r in spark.read.parquet(f"{path}/i/directory").orderBy("block").select("first_key").collect()]
    assert keys == sorted(keys) and len(keys) >= 15
    some = spark.createDataFrame([(r[1], str(r[0])) for r in rows[::3]] + [("http://no.example.com/", "1"), (rows[1][1], "77")], "uri string, page_id string")
    for segments in (3, 4096):
        found = warc.read_ranges(spark, f"{path}/a", warc.look_up(spark, f"{path}/i", some, segments))
        assert sorted(int(r[0]) for r in found.select("page_id").collect()) == [r[0] for r in rows[::3]]


def test_sort_keys():
    assert warc.surt("http://www.b.example.com:80/a?x=1#f") == "com,example,b,www:80)/a?x=1"
    assert warc.surt("") == ")" and warc.surt("http://[bad") == ")http://[bad"
    assert F is not None
