"""Pages whose blocks leave doubt: headings with odd names, areas without marks, adverts in text."""

import pytest
from pyspark.sql import functions as F

from recordloom.llm import html_extract as h

KEPT = {
    '<article><h1>T</h1><p>One.</p><h2 class="section-header">Part two</h2><p>Two.</p></article>': "T One. Part two Two.",
    '<article><div class="post-header">Title</div><p>One two.</p></article>': "Title One two.",
    '<article><p>One.</p><section class="related-work"><h2>Related work</h2><p>Others.</p></section></article>': "One. Related work Others.",
    '<article><section class="login"><h2>Log in</h2><p>Press it.</p></section><p>Then go.</p></article>': "Log in Press it. Then go.",
    '<article><p>One.</p><p class="notice-board">Board.</p><p>Two.</p></article>': "One. Board. Two.",
    "<article><p>Sum <math><mi>x</mi></math> and <button>press</button> it.</p></article>": "Sum x and press it.",
    "<body><div id=header>Site</div><div id=content><h1>Short</h1><p>A few words.</p><p>Some more.</p>"
    "<ul><li>one</li><li>two</li></ul></div><div id=footer>(c)</div></body>": "Short A few words. Some more. one two",
    "<body><h1>Title</h1><p>This is a paragraph with several words in it.</p><p>Short one.</p>"
    "<p>Another paragraph with several words in it.</p></body>":
        "Title This is a paragraph with several words in it. Short one. Another paragraph with several words in it.",
}
DROPPED = [
    "<div class=ad>{}</div>",
    '<div class="promo-box">{}</div>',
    '<div class="cookieNotice">{}</div>',
    "<aside><p>{}</p></aside>",
    "<form><p>{}</p></form>",
    '<ul class="related-posts"><li><a href=x>{}</a></li></ul>',
    '<section id="comments"><p>{}</p><p>{}</p></section>',
    '<div class="comment-body"><p>{}</p></div>',
    '<p class="advert">{}</p>',
    "<nav><a href=x>{}</a></nav>",
    "<div hidden>{}</div>",
    "<script>var x = '{}';</script>",
    "<button>{}</button>",
]


@pytest.mark.parametrize("page", KEPT)
def test_doubtful_blocks_stay(page):
    assert h.main_text(page).replace("\n\n", " ") == KEPT[page]


@pytest.mark.parametrize("part", DROPPED)
def test_boilerplate_in_the_middle_of_text_goes(part):
    odd = part.replace("{}", "Words that nobody wants to read in a corpus of text, whatever they say.")
    page = f"<article><h1>T</h1><p>One.</p>{odd}<p>Two.</p></article>"
    assert h.main_text(page) == "T\n\nOne.\n\nTwo."


def test_the_cut_moves_blocks():
    """Blocks that are against their own score, because of their neighbours."""
    moved = 0
    for page in KEPT:
        blocks = h.blocks_of(page)
        score = h.scores(blocks)
        side = h.minimum_cut(score, h.smoothness(blocks))
        moved += sum((s > 0) != c for s, c in zip(score, side, strict=True))
    assert moved > 0


def test_empty_table_and_long_page(spark):
    pages = spark.createDataFrame([], "page_id long, html string")
    assert h.extracted(pages).count() == 0
    long = "<article>" + "<p>word &amp; word.</p>" * 30_000 + "</article>"
    got = spark.createDataFrame([(1, long)], "page_id long, html string").select("page_id", "html")
    assert len(h.extracted(got).first().text) == 30_000 * 12 + 2 * 29_999
    clash = got.withColumn("text", F.lit("x")).withColumn("tag", F.lit("y"))
    assert h.extracted(clash).select("tag").first().tag == "y"
