import pytest

from passagekit.functions.uris import path_to_uri, tag_of, uri_anchor
from passagekit.operators.sections import extract_sections, page_text, resolve_uris
from pyspark.sql import functions as F

PATH = "data/docs.ray.io/en/latest/serve/index.html"
URI = "https://docs.ray.io/en/latest/serve/index.html"

GOLDEN = [
    ('<section id="a"><h1>Title</h1> intro <section id="b"><p>Inner</p></section><p>tail</p></section><section><p>no id</p></section>',
     [("a", "Title\nintro\ntail"), ("b", "Inner")]),
    ('<section id="a">x<br>y</section>', [("a", "x\n\ny")]),
    ('<section id="o"><div>pre<section id="i">in</section></div></section>', [("o", "prein"), ("i", "in")]),
    ('<section id="">z</section>', []),
    ('<section id="e"></section>', [("e", "")]),
    ('<section id="s"><div>u<script>var q;</script>v &foo; &amp; &#150; &copy;</div></section>', [("s", "uv &foo & – ©")]),
    ('<section id="c"><!-- note --><p>a<!-- inner -->b</p></section>', [("c", "note\nab")]),
    ('<section id="w"><div><p>a</p>\n   <p>b</p></div><pre>  x\n\n y </pre></section>', [("w", "a\nb\nx\n\n y")]),
    ('<section id="p"><p><b>one<br><p>two</p></section><section id="q">three</section>', [("p", "onetwo"), ("q", "three")]),
    ('<section id="n">a</div></section>', [("n", "a")]),
]


@pytest.mark.parametrize("html,expected", GOLDEN)
def test_golden(spark, html, expected):
    pages = spark.createDataFrame([(1, PATH, html)], "page_id long, url string, html string")
    rows = extract_sections(pages).orderBy("section_pos").collect()
    assert [(r["source"], r["text"]) for r in rows] == [(f"{URI}#{i}", t) for i, t in expected]


def test_options(spark):
    pages = spark.createDataFrame([(1, "u", "<article><!--c-->x</article>"), (2, "v", None)], "page_id long, url string, html string")
    rows = extract_sections(pages, "article", False, domain=None, keep_direct_comments=False).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "u", "x")]


def test_deep_nesting_is_no_problem(spark):
    pages = spark.createDataFrame([(1, "u", "<p>" * 20000 + "x")], "page_id long, url string, html string")
    assert page_text(pages).first()["text"] == "x"


def test_resolve_uris(spark):
    pages = spark.createDataFrame([("u", '<p id="a">one</p><p>two</p>')], "url string, html string")
    uris = spark.createDataFrame([("u#a",), ("u",), ("u#none",), ("u#a",), ("w#a",)], "uri string")
    rows = sorted(map(tuple, resolve_uris(uris, pages).collect()))
    assert rows == [("u", "onetwo"), ("u#a", "one"), ("u#a", "one"), ("u#none", "onetwo"), ("w#a", None)]


def test_uris_and_tags(spark):
    row = spark.range(1).select(
        path_to_uri(F.lit("/x/y.html")).alias("absent"), path_to_uri(F.lit("a/docs.ray.io/b/docs.ray.io/c")).alias("last"),
        tag_of(F.lit("https://docs.ray.io/en/latest/serve/x.html#a")).alias("folder"),
        tag_of(F.lit("https://docs.ray.io/en/latest/index.html#a")).alias("file"),
        tag_of(F.lit("https://docs.ray.io/en/master/x")).alias("none"), uri_anchor(F.lit("u#b")).alias("anchor")).first()
    assert tuple(row) == ("https://docs.ray.io/x/y.html", "https://docs.ray.io/c", "serve", "index.html", None, "b")


def test_hot_uri_and_hot_page(spark):
    """A third of the requests is one URI, another third points into one page: every row comes back with its text."""
    body = "".join(f'<p id="a{i}">t{i}</p>' for i in range(200))
    pages = spark.createDataFrame([("hot", body)] + [(f"u{i}", f"<p>x{i}</p>") for i in range(20)], "url string, html string")
    asked = ["hot#a1"] * 60 + [f"hot#a{i}" for i in range(200)] + [f"u{i % 20}" for i in range(60)]
    rows = resolve_uris(spark.createDataFrame([(u,) for u in asked], "uri string").repartition(5), pages).collect()
    expected = [(u, "t" + u.split("#a")[1] if "#" in u else "x" + u[1:]) for u in asked]
    assert sorted(map(tuple, rows)) == sorted(expected)


def test_bad_markup_is_read_and_loses_no_page(spark):
    bad = ["<![foo]>", "<![ >", "&#" + "5" * 5000 + ";", "&#xD800;"]
    html = [f"<section id='a'>one {x}</section><section id='b'>two</section>" for x in bad] + ["<section id='a'>good</section>"]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    rows = extract_sections(pages, domain=None).collect()
    assert {r["page_id"] for r in rows} == set(range(5))
    assert [r["text"] for r in rows if r["page_id"] in (2, 3) and r["section_pos"] == 0] == ["one \N{REPLACEMENT CHARACTER}"] * 2
