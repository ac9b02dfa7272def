"""Extraction: held-out accuracy, a rule-based check on the table, lenient parsing."""

import html
import itertools
import re

import numpy as np
import pytest

from errata.llm import html_extract as hx

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sources():
    import duckdb
    return [h for (h,) in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet' ORDER BY page_id").fetchall()]


@pytest.fixture(scope="module")
def model(sources):
    return hx.train(sources[:100])


def test_held_out_accuracy(model, sources):
    texts = [" ".join(t.split()) for h in sources[150:] for t in hx.Page(h).text if len(t) > 30]
    made = [hx.Composer(texts, k).page() for k in range(100, 250)]
    forest = hx.Forest(made)
    keep = forest.decode(model(forest.x))
    truth = np.array([t for p in made for t in p.truth], dtype=bool)
    size = np.array([len(t) for p in made for t in p.text])
    assert size[keep == truth].sum() >= 0.96 * size.sum()


def test_table_by_its_article_elements(model, sources):
    """The given pages mark their article; take its text by a plain rule."""
    for h, got in zip(sources, hx.extract(model, sources)):
        article = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert got == "\n".join(b for b in blocks if b)


def test_decoding_is_the_best_consistent_choice():
    page = hx.Page("<div><p>a<b>b</b></p><p>c</p></div><p>d</p>")
    forest = hx.Forest([page])
    n = len(page.parent)
    rng = np.random.default_rng(5)
    for _ in range(30):
        p = rng.uniform(0.05, 0.95, n)
        best = max((keep for keep in itertools.product([0, 1], repeat=n)
                    if all(not keep[k] or page.parent[k] < 0 or keep[page.parent[k]] for k in range(n))),
                   key=lambda keep: sum(np.log(p[k] if keep[k] else 1 - p[k]) for k in range(n)))
        assert forest.decode(p).astype(int).tolist() == list(best)


@pytest.mark.parametrize("source,blocks", [
    ("<p>a  b\n c</p>d<br>e", ["a b c", "d e"]),
    ("x &amp; y &eacute;&#x41;&lt;p&gt;&copy &amp", ["x & y éA<p>© &"]),
    ("<p>one<p>two<b>bold<p>three", ["one", "twobold", "three"]),
    ("<script>if (a<b) x='</p>'</script>t<style>p{}</style>u", ["tu"]),
    ("a<!-- <p>no</p> -->b<!unclosed", ["ab"]),
    ("<ul><li>1<li>2<ul><li>3</ul></ul>", ["1", "2", "3"]),
    ("<td>a<td>b</div></p>c", ["a", "b", "c"]),
    ("<p title='a>b' class=x>t</p>1 < 2", ["t", "1 < 2"]),
    ("<p class=\"unclosed>text</p>more", ["text", "more"]),
    ("", []),
])
def test_lenient_parsing(source, blocks):
    page = hx.Page(source)
    assert page.main_text(np.ones(len(page.text), dtype=bool)) == "\n".join(blocks)


def test_deep_and_long_pages_are_linear(model):
    hx.extract(model, ["<div>" * 3000 + "text", "<b>" * 3000, "<" * 20000, "<p " * 5000, "<p \"" * 5000, "word " * 200_000])


def test_edge_rows(spark):
    page = "<html><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A heading of words</h1><p>Some text, with a sentence that is long enough to teach.</p></article></html>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "", ""), (3, "v", "<nav><a href='/'>x</a></nav>")]
    df = spark.createDataFrame([(p, u, h, "t", 1) for p, u, h in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in hx.main_texts(df).collect()), key=repr)
    main = "A heading of words\nSome text, with a sentence that is long enough to teach."
    assert got == sorted([(1, "u", main, len(main))] * 2 + [(None, None, "", 0), (2, "", "", 0), (3, "v", "", 0)], key=repr)
    assert hx.main_texts(df.limit(0)).count() == 0
