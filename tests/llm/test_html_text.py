import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from originlake.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="<p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div>
{open}<h1>A &amp; B</h1><p>First&nbsp;line<br>goes   on<p>Second <b>bold</b> &lt;i&gt; line<!-- <p>x</p> --><ul><li>one<li>two</ul>
<div class="ad">Buy</div><form><p>Name</p></form><div id="comments"><p>Nice!</p></div><p>Last</p>{close}
<aside><p>Side</p></aside><footer>&copy;</footer></body></html>"""
WANT = "A & B\nFirst line goes on\nSecond bold <i> line\none\ntwo\nLast"


def test_parts_beside_the_article_go():
    assert h.main_text(PAGE.format(open="<article>", close="</article>")) == WANT
    assert h.main_text(PAGE.format(open='<div role="main">', close="</div>")) == WANT
    assert h.main_text(PAGE.format(open='<div class="text">', close="</div>")) == WANT
    assert h.main_text(None) == h.main_text("") == h.main_text("<p") == ""
    assert h.main_text("<article><p>cut &am") == "cut &am"
    assert h.main_text('a < b <a title="x>y">c</a> <br/> d') == "a < b c d"


def test_odd_pages():
    deep = "<div>" * 5000 + "in<script>no</script>" + "</div>" * 5000 + "<nav>" * 3000
    assert h.main_text(f"<article><p>a</p>{deep}</article>") == "a\nin"
    # a letter whose lower case is longer, before raw text
    assert h.main_text("<article><p>" + "\u0130" * 40 + "</p><SCRIPT>x</scripted></Script ><p>b</p></article>") == "\u0130" * 40 + "\nb"


def test_marks_check_the_wrapper():
    page = '<html><body><div><p>beside</p></div><main><h1>t</h1><section><p>one</p></section><section><p>two and more</p></section></main></body></html>'
    assert h.main_text(page, "#root/html/body/main!/section") == "t\none\ntwo and more"
    assert h.main_text(page, "#root/html/body/div") == "t\none\ntwo and more"
    assert h.main_text(page, "#root/html/body/table") == "t\none\ntwo and more"
    plain = page.replace("main>", "div>")
    assert h.main_text(plain, "#root/html/body/div/section") == "two and more"


def test_wrappers_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("host", h.host_of(F.col("url"))).withColumn("salt", F.xxhash64("url"))
    got = h.induce(pages).collect()
    several = pages.groupBy("host").agg(F.count_distinct("html").alias("n")).where("n > 1").count()
    assert len(got) == several and {r["wrapper"] for r in got} == {"#root/html/body/article!"}


def test_tree_matching():
    a = ["r", 0, 0, [["x", 1, 5, [], [1]], ["y", 2, 5, [["z", 3, 5, [], [3]]], []]], []]
    b = ["r", 0, 0, [["w", 9, 5, [], [9]], ["x", 1, 5, [], [1]], ["y", 7, 5, [["z", 8, 6, [], [8]]], []]], []]
    size, pairs = h.match(a, b)
    assert size == 4 and len(pairs) == 4
    assert h.slots(a, b) == {"r": 10, "r/y": 11} and h.constants(a, pairs) == {("r/x", 1)}


def test_long_lists_are_paired_in_order():
    r = random.Random(1)
    for _ in range(30):
        x = [["abc"[r.randrange(3)], r.randrange(30), 5, [], []] for _ in range(r.randint(0, 25))]
        y = [k if r.random() < 0.7 else ["abc"[r.randrange(3)], 99, 5, [], []] for k in x if r.random() < 0.8]
        ids = lambda t: [id(k) for k in t]
        pairs = h._paired(x, [list(k) for k in y])
        assert all(p[0] == q[0] for p, q in pairs)
        assert sorted(ids(x).index(id(p)) for p, _ in pairs) == [ids(x).index(id(p)) for p, _ in pairs]
    a = ["r", 0, 0, [["t", k, 5, [["u", k, 3, [], []]], []] for k in range(20_000)], []]
    b = ["r", 0, 0, [["t", k + 7, 5, [["u", k + 7, 3, [], []]], []] for k in range(20_000)], []]
    began = time.perf_counter()
    assert h.match(a, b)[0] == 2 * (20_000 - 7) + 1 and time.perf_counter() - began < 10


def test_wrapper_of_a_host(spark):
    long = "Boilerplate that is the same on each page and longer than what any article says. " * 4
    page = '<html><body><div class="top"><p>{b}</p></div><div class="story"><p>{x} one</p><p>{x} two</p></div></body></html>'
    rows = [(i, "http://h.example/%d" % i, page.format(b=long, x="w%d " % i * 3)) for i in range(9)] + [(99, None, None), (100, "x", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'a' text", "1 host", "2 wrapper")
    got = {r["page_id"]: r for r in h.extract(df).collect()}
    for i in range(9):
        x = " ".join(["w%d" % i] * 3)
        assert got[i]["text"] == f"{x} one\n{x} two"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[99]["text"] == "" and got[99]["url"] is None and got[100]["n_chars"] == 0
    assert h.extract(df.limit(0)).count() == 0


def test_articles_in_several_sections(spark):
    page = '<html><body><div class="top"><p>same on all</p></div><div class="content"><h2>{t}</h2>{s}</div></body></html>'
    sec = '<h3>h{i}.{j}</h3><section class="part"><p>{i} {j} {w}</p><p>more {i} {j}</p></section>'
    word = lambda i, j: " ".join(f"w{i}" for _ in range(3 + 4 * (i * j % 5)))
    rows, want = [], {}
    for i in range(8):
        n = 1 + i % 4
        s = "".join(sec.format(i=i, j=j, w=word(i, j)) for j in range(n))
        rows.append((i, f"http://s.example/{i}", page.format(t=f"title {i}", s=s)))
        want[i] = "\n".join([f"title {i}"] + [x for j in range(n) for x in (f"h{i}.{j}", f"{i} {j} {word(i, j)}", f"more {i} {j}")])
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in h.extract(df).collect()} == want


def test_query_against_marked_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in h.extract(pages).collect()}
    for r in pages.collect():
        a = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", a))
        assert got[r["page_id"]]["text"] == "\n".join(x for x in parts if x)


def test_names_that_only_look_like_parts_beside():
    kept = ['<section id="related-work"><p>a</p></section>', '<h2 id="search">b</h2>', '<p class="notice">c</p>', '<div class="no-sidebar"><p>d</p></div>',
            '<div class="entry-header"><p>e</p></div>', '<h2 class="ad-hoc">f</h2>', '<ul class="social-facts"><li>g</li></ul>', '<p class="share-price">h</p>']
    assert h.main_text(f"<article>{''.join(kept)}</article>") == "a\nb\nc\nd\ne\nf\ng\nh"
    gone = ['<div class="x related"><p>a</p></div>', '<section id="comments"><p>b</p></section>', '<p class="ad">c</p>', '<ul class="share-buttons"><li>d</li></ul>', '<div class="cookie-banner">e</div>']
    assert h.main_text(f"<article>{''.join(gone)}<p>z</p></article>") == "z"


@pytest.mark.parametrize("mark", ["article", "div"])
def test_text_that_is_the_same_on_all_pages_goes(spark, mark):
    page = "<html><body><p>top</p><{m}><h1>t{x}</h1><p>one {x}</p><p>Subscribe to our weekly letter and win prizes</p><p>two {x} of it</p></{m}></body></html>"
    rows = [(i, f"http://c.example/{i}", page.format(m=mark, x=i)) for i in range(6)] + [(9, "http://d.example/1", page.format(m=mark, x=9))]
    rows += [(20 + i, f"http://e.example/{i}", page.format(m=mark, x=i)) for i in range(3)]  # too few to tell
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in h.extract(df).collect()}
    assert all(got[i] == f"t{i}\none {i}\ntwo {i} of it" for i in range(6))
    assert "Subscribe" in got[9] and all("Subscribe" in got[20 + i] for i in range(3))


def test_deep_and_broken_pages_take_linear_time():
    deep = "<div>" * 300 + "<p>one</p><p>two</p>three<b>!</b><div>four</div>" + "</div>" * 300
    assert h.main_text(f"<article>{deep}</article>") == "one\ntwo\nthree!\nfour"
    began = time.perf_counter()
    assert h.main_text("<article>" + "<i>" * 20_000 + "x" + "</u>" * 40_000 + "<p>y" * 20_000 + "</article>").startswith("x\ny\ny")
    assert time.perf_counter() - began < 8
