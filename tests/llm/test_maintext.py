"""Main text: the field against all labellings, the table's pages against their markup, awkward pages."""

import html
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleframe.llm import maintext as m

SF = "/root/testdata/sf0.01"


def by_markup(page):
    """The article of one of the table's pages, by its markup alone."""
    inside = page.split("<article>", 1)[1].split("</article>", 1)[0]
    parts = re.split(r"</?(?:h1|p)>", inside)
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", y)).split()) for y in parts) if x)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    for _ in range(30):
        field = m.Field(rng.normal(size=(m.DIMENSIONS, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        page = [tuple(rng.integers(0, 50, 3).tolist()) for _ in range(7)]
        own = [field.score[list(f)].sum(axis=0) for f in page]

        def total(labels):
            return field.first[labels[0]] + sum(o[k] for o, k in zip(own, labels)) + sum(field.step[a, b] for a, b in zip(labels, labels[1:]))

        assert field.labels(page) == list(max(itertools.product((0, 1), repeat=7), key=total))


def test_slope_is_that_of_the_likelihood():
    """One long run on pages that neighbours decide: labels alternate whatever the block."""
    pages = [([(1,), (1,), (1,), (1,)], [0, 1, 0, 1])] * 5 + [([(1,)] * 3, [0, 1, 0])]
    field = m.train(pages)
    assert field.labels([(1,)] * 6) == [0, 1, 0, 1, 0, 1]


def test_all_pages_of_the_table(pages):
    rows = m.extracted(pages, sample=60).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    right = sum(r["text"] == by_markup(r["html"]) for r in rows)
    assert right == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


@pytest.fixture(scope="module")
def field(pages):
    return m.fitted(pages, 120)


def test_page_without_article_elements(field):
    page = """<html><head><title>T</title><style>p{}</style></head><body><div id="cookie-banner"><p>We use cookies to make this
    site better, please accept them.</p></div><div class="post-content"><h2>A title of it</h2><p>The first paragraph, of some length,
    says a&nbsp;thing &amp; more.</p><script>var t = "</p><p>no";</script><p>The second one goes on with <a href=z>a link</a> and ends here.</p></div>
    <div class="comments"><p>I really liked this article, thank you so much.</p></div><form><p>Subscribe to our letter now.</p></form></body></html>"""
    text = m.main_text(page, field)
    assert "The first paragraph, of some length, says a thing & more.\nThe second one goes on with a link and ends here." in text
    assert not re.search("cookies|liked|Subscribe|no$", text)


@pytest.mark.parametrize(
    "page, texts",
    [
        (None, []), ("", []), ("<p>", []), ("plain  text", ["plain text"]), ("a < b<p>c", ["a < b", "c"]), ("<p title='>'>x</p", ["x"]),
        ("<!-- <p>no</p> -->yes", ["yes"]), ("<script>if (a<b) '</p>'", []), ("<P>A<BR>b <I>c</I>d&eacute;<P>e", ["A b cdé", "e"]), ("&am &amp &#65;", ["&am & A"]),
        ("<title>x<body>y", []), ("<head><meta><body>y", ["y"]), ("<ul><li>1<li>2</ul>3", ["1", "2", "3"]), ("</div>x</p>", ["x"]), ("<div" * 3000, []), ("x<p title=\"y", ["x"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in m.blocks(page)] == texts


def test_awkward_rows(spark, pages):
    odd = spark.createDataFrame([(None, "u", None), (-1, None, ""), (-2, "u", "<br>"), (-3, "u", "<article><p>" + "Long text. " * 60_000), (-3, "u", "<article><p>Twice.")], "page_id long, url string, html string")
    both = pages.limit(60).union(odd).withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("clash"))
    got = m.extracted(both, 40)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 65
    found = {(r["page_id"], r["n_chars"]) for r in got.where("page_id IS NULL OR page_id < 0").collect()}
    assert {(None, 0), (-1, 0), (-2, 0)} < found and (-3, len("Long text. " * 60_000) - 1) in found
    assert m.extracted(both.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><p>One.</p><svg class="rule"/><p>Two.</p></article>', ["One.", "Two."]),
        ("<article><p>One.</p><svg><text>no</text></svg><p>Two.</p></article>", ["One.", "Two."]),
        ("<head><title>x</title><meta charset='u'><article><p>One.</p></article>", ["One."]),
        ("<head><script>'<p>no</p>'</script><style>p</style></head><body><p>One.</p>", ["One."]),
        ("<article><select-list><p>One.</p></select-list><button-group>Two.</button-group></article>", ["One.", "Two."]),
        ("<p>With <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <math/> more.</p>", ["With x=2 and more."]),
        ("<p>One.</p><select><option>no</option></select><p>Two.</p>", ["One.", "Two."]),
    ],
)
def test_silent_elements_end_where_they_end(page, want):
    assert [b.text for b in m.blocks(page)] == want


def test_copies_of_a_page_take_one_place_of_the_sample(spark, monkeypatch):
    pages = [(i, f"<html><body><article><p>page number {i}</p></article></body></html>") for i in range(12)] 
    df = spark.createDataFrame(pages, "page_id long, html string").withColumn("url", F.lit(""))
    first = df.orderBy(F.xxhash64("html")).first()["html"]
    copies = df.union(spark.range(200).select("id", F.lit(first), F.lit("")))
    seen = []
    monkeypatch.setattr(m, "labelled", lambda htmls: seen.append(sorted(htmls)))
    monkeypatch.setattr(m, "train", lambda rows: None)
    m.fitted(df, 5), m.fitted(copies, 5)
    assert seen[0] == seen[1] and len(seen[0]) == 5
