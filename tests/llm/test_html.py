"""Main text: nothing of an article is lost to other elements, and the driver's pages against a plain extractor."""

import collections
import os
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from cognate_spark.llm import html_extract

from .foreign_pages import page

PAGES = "/root/testdata/sf0.001"


class Article(HTMLParser):
    """Blocks of text inside article elements, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.parts, self.found = 0, 0, [], []

    def cut(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.found.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "br":
            self.handle_data(" ")
        if tag in html_extract.BLOCK:
            self.cut()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip -= 1
        if tag in html_extract.BLOCK:
            self.cut()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.parts.append(data)


def plain(html):
    p = Article()
    p.feed(html or "")
    p.close()
    p.cut()
    return "\n\n".join(p.found)


@pytest.fixture
def model(labeller):
    return labeller


def test_blocks_keep_what_other_elements_hold():
    texts = lambda h: [b.text for b in html_extract.blocks(h)]
    assert texts("<article><p>Before</p><svg-icon name='x'></svg-icon><p>After the icon.</p></article>") == ["Before", "After the icon."]
    assert texts("<article><p>Before</p><svg width=1 /><p>After.</p></article>") == ["Before", "After."]
    assert texts("<p>See <math><mi>x</mi></math> here <object>in <b>it</b></object><template-card>and this</template-card><p>End</p>") == ["See x here", "in it", "and this", "End"]
    assert texts("<noscript><p>No script.</p></noscript><scripted>kept</scripted><script>gone</script ><style>gone</style>") == ["No script.", "kept"]
    assert [b.path[-1] for b in html_extract.blocks("<article><svg/><p>x</p></article>")] == ["p"]


def test_driver_pages_against_a_plain_extractor(spark):
    if not os.path.isdir(PAGES):
        pytest.skip("the driver's tables are not here")
    pages = spark.read.parquet(f"{PAGES}/pages.parquet")
    out = html_extract.extracted(pages, html_extract.fitted(pages, invented_pages=500)).collect()
    right = sum(r.main_text == plain(r.html) for r in out)
    assert right >= 0.99 * len(out), (right, len(out))


def test_unseen_pages_of_the_generator(model):
    r = random.Random(77)
    right = all_ = 0
    for _ in range(120):
        page, y = html_extract._invented_page(html_extract.invented(r))
        right, all_ = right + int((model.labels([html_extract.vectors(page, model.known)])[0] == (y > 0)).sum()), all_ + len(y)
    assert right > 0.97 * all_


def test_whole_pages_of_foreign_templates(model):
    r = random.Random(99)
    made = [page(r) for _ in range(200)]
    got = html_extract.main_texts([html for html, _, _ in made], model)
    right = sum(g == want for g, (_, want, _) in zip(got, made, strict=True))
    assert right >= 190, (right, collections.Counter(name for g, (_, want, name) in zip(got, made, strict=True) if g != want))


def test_pages_without_any_wrapper(model):
    said = "A sentence of some length, which is all that this page has to say."
    pages = {
        f"<body><p>{said}</p></body>": said,
        f"<table><tr><td>{said}</td></tr></table>": said,
        f"<div class='wrap'><div class='col-8'><h1>Heading</h1><p>{said}</p><p>{said}</p></div></div>": f"Heading\n\n{said}\n\n{said}",
        f"<html><body>{said}</body></html>": said,
        said: said,
    }
    assert html_extract.main_texts(list(pages), model) == list(pages.values())


def test_pages_are_read_by_blocks(model, monkeypatch):
    r = random.Random(3)
    pages = [html_extract.invented(r).replace(html_extract.MARK, "") for _ in range(30)] + ["", "<p>"]
    whole = html_extract.main_texts(pages, model)
    sizes = []
    read = html_extract.Labeller.labelled
    monkeypatch.setattr(html_extract.Labeller, "labelled", lambda self, held, *a: sizes.append(sum(len(x) for x, _ in held)) or read(self, held, *a))
    monkeypatch.setattr(html_extract, "HELD_BLOCKS", 60)
    assert html_extract.main_texts(pages, model) == whole and len(sizes) > 5
    assert max(sizes) <= max(60, *(len(html_extract.blocks(p)) for p in pages))


def test_long_and_empty_pages(spark, model):
    body = "".join(f"<p>Sentence number {i} of a very long article, with a few more words.</p>" for i in range(60_000))
    long = f"<html><body><nav><a href=x>Menu</a></nav><article>{body}</article><footer>&copy; me</footer></body></html>"
    (text,) = html_extract.main_texts([long], model)
    assert text.count("\n\n") >= 59_000
    rows = [(1, long[:2000], "old"), (2, None, None), (3, "", "old"), (3, "", "old")]
    pages = spark.createDataFrame(rows, "page_id long, html string, main_text string")
    out = html_extract.extracted(pages, model)
    assert out.columns == pages.columns and [r.main_text for r in out.orderBy("page_id").collect()][1:] == ["", "", ""]
    none = pages.limit(0)
    assert html_extract.extracted(none, model).count() == 0
    assert html_extract.extracted(none, html_extract.fitted(none, invented_pages=20)).agg(F.count("*")).first()[0] == 0
