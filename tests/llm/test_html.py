"""Main-text extraction: generated pages against a plain reading of their article, and hand-written pages."""

import html
import re

import pytest

from graphloom.llm import htmltext


def plain_article(source):
    body = re.search(r"<article>(.*?)(</article>|\Z)", source or "", re.S)
    blocks = re.split(r"</?(?:p|h1|article)>", re.sub(r"</?b>|<br>", " ", body[1])) if body else []
    blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*\Z", "", b))).strip() for b in blocks)
    return "\n".join(b for b in blocks if b)


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r for r in htmltext.extract_pages(pages).collect()}
    for r in pages.collect():
        assert found[r["page_id"]]["text"] == plain_article(r["html"])
        assert found[r["page_id"]]["n_chars"] == len(found[r["page_id"]]["text"])


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (3, "u", "<p"), (None, "u", "plain text only, of some length, that nothing marks as anything but text.")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    found = htmltext.extract_pages(frame).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"] == len(r["text"])) for r in found) == [(0, True), (1, True), (2, True), (3, True), (3, True)]
    assert htmltext.extract_pages(frame.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><a href="/">Home</a> Site name</header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><div class="cookie-notice"><p>We use cookies on this site. Please accept all of them before you go on reading here.</p></div>
<main><h1>A   head&shy;line</h1><p>The first paragraph of the story, which is long enough to be told apart from menus &amp; such.</p>
<aside><p>Related stories that nobody asked for, long enough to look like the text of an article.</p></aside>
<p>The second paragraph goes on with <b>bold</b> words and <a href="x">a link</a>, and ends here.</p><form><label>Your mail</label><input></form>
<div class="ad">Buy this now, it is the best thing that you can buy for money today.</div></main>
<div id="comments"><div class="comment"><p>I do not agree with this article at all, it is quite wrong in my opinion.</p></div></div><footer>&copy; Somebody</footer></body></html>"""


def test_hand_written(spark):
    model = htmltext.fit([r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()])
    expected = "A head­line\nThe first paragraph of the story, which is long enough to be told apart from menus & such.\nThe second paragraph goes on with bold words and a link, and ends here."
    assert htmltext.main_text(PAGE, model) == expected
    assert htmltext.main_text(PAGE.replace("<main>", '<div class="post-content">').replace("</main>", "</div>"), model) == expected
    assert htmltext.main_text("", model) == ""


STORY = "The first paragraph of the story, which is long enough to be told apart from menus and such."
NEXT = "The second paragraph goes on for a while with more words, and it ends here."


@pytest.mark.parametrize(
    ("head", "inside", "foot"),
    [
        ('<svg class="icon" viewBox="0 0 1 1"/>', "", "<svg><path d='M0'/></svg>"),
        ("<math/>", "", "<math><mi>x</mi></math>"),
        ("<button>Menu", "", ""),
        ("<button>Menu", "", "<button>Top</button>"),
        ("<select><option>A<option>B", "", ""),
        ("<svg><path d='M0'>", "", "</svg>"),
        ("<svg><style/><title/></svg>", "", ""),
        ("", "<button>Share", ""),
        ("", "<button>Share</button>", ""),
        ("", "<iframe src='x'>", ""),
        ("", "<template><p>Not shown</p></template>", ""),
        ("", "<svg><text>Axis</text><path d='M0'/></svg>", ""),
    ],
)
def test_embedded(head, inside, foot):
    model = htmltext.fit([])
    page = f"<html><body><header>{head}<a href='/'>Home</a></header><article><p>{STORY}</p>{inside}<p>{NEXT}</p></article><footer>{foot}<p>Rights</p></footer></body></html>"
    found = htmltext.main_text(page, model).split("\n")
    assert STORY in found and NEXT in found
    assert not {"Home", "Menu", "Top", "A", "B", "Axis", "Not shown", "Rights"} & set(found)


def test_within_a_line():
    model = htmltext.fit([])
    formula = "<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation encoding='application/x-tex'>E=m</annotation></semantics></math>"
    page = f"<article><p>The story says that {formula} holds, and that the <svg><path d='M0'/></svg> sign or a <button>Press</button> key tells it.</p></article>"
    assert htmltext.main_text(page, model) == "The story says that E=m holds, and that the sign or a key tells it."


def test_training_reads_whole_pages(spark):
    page = "<nav>" + "<!-- -->" * 30_000 + f"</nav><article><p>{STORY}</p></article>"
    frame = spark.createDataFrame([(k, page) for k in range(40)], "page_id long, html string")
    whole, drawn = htmltext.train_extractor(frame), htmltext.fit([])
    assert whole == htmltext.fit([page] * 40) and whole != drawn


@pytest.mark.parametrize("part", ["<div class='form-of-government'><h2>Offices</h2><p>{}</p></div>", "<p class='text-search-intro'>{}</p>", "<section id='more-history'><h2>Later</h2><p>{}</p></section>", "<div data-id='menu'><p>{}</p></div>"])
def test_subjects_stay(spark, part):
    model = htmltext.train_extractor(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    for outer in ("<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>"):
        page = f"<html><body><nav><a href='/'>Home</a></nav>{outer.format(f'<h1>Head</h1><p>{STORY}</p>' + part.format(NEXT))}<div class='share-buttons'>Share</div><div class='related-articles'><p>{STORY} Elsewhere.</p></div></body></html>"
        found = htmltext.main_text(page, model).split("\n")
        assert STORY in found and NEXT in found and "Share" not in found and f"{STORY} Elsewhere." not in found and "Home" not in found


def test_quotes_in_unquoted_values():
    model = htmltext.fit([])
    page = f"""<article><p>{STORY}</p><p>{NEXT} <a href=x title=it's fine>here</a> and <a title="a > b" href='c>d'>there</a>.</p><p data-x = "1>2" y=" '">{STORY} Again.</p></article>"""
    assert htmltext.main_text(page, model) == f"{STORY}\n{NEXT} here and there.\n{STORY} Again."


@pytest.mark.parametrize("source", ["<div>" * 40_000 + "</p>" * 40_000, "<div>" * 20_000 + "<li>x" * 20_000, "<math><annotation>" * 40_000, "<b>" * 40_000 + "</i>" * 40_000, "<a x='" * 40_000, "<svg>" * 20_000 + "</svg>" * 20_000])
def test_long_markup_takes_linear_time(source):
    import time

    began = time.time()
    htmltext.main_text(source + f"<p>{STORY}</p>", htmltext.fit([]))
    assert time.time() - began < 5


def test_marginals_are_those_of_all_labellings():
    """Messages against the sum over all labellings of a tree of twelve nodes."""
    import itertools
    import math
    import random

    rng = random.Random(2)
    model = ([rng.uniform(-1.5, 1.5) for _ in htmltext.NAMES], [[0.8, 0.2], [0.35, 0.65]])
    for _ in range(5):
        page = htmltext.Page("")
        tags = ["div", "p", "li", "article", "nav", "h2"]
        for i in range(1, 12):
            page._add(rng.randrange(i), rng.choice(tags), rng.choice([frozenset(), frozenset({"main"}), frozenset({"mention"})]))
        own = [sum(model[0][k] for k in htmltext.features_of(page, i)) for i in range(12)]
        total = [[0.0, 0.0] for _ in range(12)]
        for labels in itertools.product((0, 1), repeat=12):
            weight = math.exp(sum(o for o, y in zip(own, labels, strict=True) if y))
            for i in range(1, 12):
                weight *= model[1][labels[page.parent[i]]][labels[i]]
            for i, y in enumerate(labels):
                total[i][y] += weight
        assert htmltext.marginals(page, model) == pytest.approx([math.log(b / a) for a, b in total], abs=1e-9)
