"""Main text: held-out accuracy, Viterbi against all sequences, and odd pages."""

import itertools
import random

import numpy as np
import pytest

from diffspark.llm import main_text as mt
from diffspark.llm.html_blocks import Block, blocks
from diffspark.llm.html_training import labelled_pages


@pytest.fixture(scope="module")
def tagger():
    return mt.default_tagger()


def test_held_out_pages(tagger):
    pages = labelled_pages(300, seed=77)
    right = sum(mt.main_text(html, tagger) == "\n".join(" ".join(t.split()) for t in truth) for html, truth in pages)
    assert right >= 0.98 * len(pages)


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(0)
    names = {f"f{i}": i for i in range(6)}
    for _ in range(60):
        tagger = mt.Tagger(names, rng.normal(size=(6, 2)), rng.normal(size=(2, 2)))
        page = [Block("x", [f"f{i}" for i in rng.choice(7, 3, replace=False)]) for _ in range(rng.integers(1, 7))]
        unary = tagger.scores(page)

        def score(labels, unary=unary, step=tagger.step):
            return sum(unary[i, label] for i, label in enumerate(labels)) + sum(step[a, b] for a, b in itertools.pairwise(labels))

        assert score(tagger.tag(page)) == pytest.approx(max(score(s) for s in itertools.product((0, 1), repeat=len(page))))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>
<article><h1>Title &amp; more</h1><p><b>First   line of&nbsp;text.<br><p>Second &eacute; <i>line</i> goes on.</p>
<div class="ad">Another advert here.</div><form><label>Mail</label><input><button>Go</button></form><p>Last line.</article>
<section class="comments"><p>A reader says something nice.</p></section><footer>&copy; someone</footer></body></html>"""


def test_page_like_the_given_ones(tagger):
    assert mt.main_text(PAGE, tagger) == "Title & more\nFirst line of text.\nSecond é line goes on.\nLast line."


def test_odd_pages(spark, tagger):
    rng = random.Random(3)
    odd = [None, "", "   ", "<", "no markup at all", "<p>open", "</p></div></article>", "<article></article>", "<b><i><p></b>x", "<script>never ends", "&#xD800; &bogus; &lt;p&gt;", PAGE * 40]
    odd += ["".join(rng.choice(["<p>", "<div>", "</div>", "<article>", "</article>", "<li>", "<form>", "a ", "<br/>", "<![CDATA[x]]>", "<?pi?>", "<!x"]) for _ in range(60)) for _ in range(60)]
    odd.append("<div>" * 3000 + "deep" + "</div>" * 3000)
    rows = [(i if i % 7 else None, f"http://u/{i}", h, "clash") for i, h in enumerate(odd + odd[:5])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = mt.extract(pages, tagger=tagger).collect()
    assert len(got) == len(rows) and all(r["text"] is not None for r in got)
    assert {r["text"] for r in got if r["url"] in ("http://u/0", "http://u/1", "http://u/9")} == {""}
    assert mt.extract(pages.limit(0), tagger=tagger).count() == 0


def test_list_items_and_cells_are_blocks():
    page = "<article><ul><li>a<li>b <ul><li>c</li></ul> d</ul><table><tr><td>1<td>2<tr><td>3</table></article>"
    assert [b.text for b in blocks(page)] == ["a", "b", "c", "d", "1", "2", "3"]


WORDS = "the quick brown foxes of this long paragraph jump over lazy dogs while readers go on and on with their reading today"


@pytest.mark.parametrize(
    "frame",
    [
        "<body>{}</body>", "<body><div>{}</div></body>", "<body><div class='col-8'>{}</div></body>", "<body><table><tr><td>{}</td></tr></table></body>",
        "<body><form action='/'><article>{}</article></form></body>", "<body><form action='/'><div>{}</div></form></body>",
    ],
)
def test_articles_without_a_marked_container(tagger, frame):
    paragraphs = [f"{WORDS.capitalize()} number {i}." for i in range(5)]
    inner = "<h1>A title of the page</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    page = frame.replace("<body>", '<body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">More</a></li></ul></nav>').replace("</body>", "<footer>&copy; someone</footer></body>")
    assert mt.main_text(page.format(inner), tagger) == "\n".join(["A title of the page", *paragraphs])


def test_formulas_stay_and_small_forms_go(tagger):
    page = f"<article><p>{WORDS} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><form><p>Sign up here</p><input><button>Go</button></form><p>{WORDS}.</p></article>"
    assert mt.main_text(page, tagger) == f"{WORDS} x=1 holds.\n{WORDS}."
