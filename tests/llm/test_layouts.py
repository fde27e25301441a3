"""HTML in several layouts and forms, and the precision of what the random field finds."""

import random
import re
import time

import pyarrow as pa
import pytest

from weftline.llm import html_consensus, pii

PROSE = "A sentence of the article that goes on for a while, as articles do. "
WORDS = "stone river lamp paper winter market garden letter".split()


def sentence(rng: random.Random) -> str:
    return " ".join(rng.choices(WORDS, k=14)).capitalize() + "."


LAYOUTS = {
    "article": "<html><body><header>Site name</header><nav><a href='/'>Home</a> <a href='/b'>News</a></nav><article class='post'>{0}</article><aside>More of ours</aside><footer>All rights</footer></body></html>",
    "table": "<html><body><table><tr><td class='menu'><a href='/'>Home</a></td><td class='text'>{0}</td><td class='sidebar'><p>Popular now</p></td></tr></table></body></html>",
    "form": "<html><body><form id='aspnetForm' action='/'><div class='navbar'>Home News</div><div id='content'>{0}</div><div class='comments'>{1}</div></form></body></html>",
    "blocks": "<body><div class='page'><div class='cookie'>We use cookies</div><div class='entry-7' data-id='search' data-role='comments'>{0}</div><div class='widget'>Weather: rain</div><div class='related'>{1}</div></div></body>",
}
#: What may stand in an article without being lost or losing what follows.
BETWEEN = ["<svg class='i'/>", "<iframe src='x'/>", "<iframe src='y'>no frames</iframe>", "<form><label>Mail</label><input name='m'></form>", "<script>var a = '<p>no</p>';</script>", "<div class='widget'>Vote!</div>", "<img src='a.png'/>", "<br/>", "<object data='x'/>", "<!-- a note -->"]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(spark, layout):
    """All paragraphs, and nothing else, on every page of a host, whatever stands between them."""
    rng = random.Random(layout)
    pages, want = [], {}
    for i in range(12):
        paragraphs = [sentence(rng) + " " + sentence(rng) for _ in range(rng.randint(3, 9))]
        body = "".join(f"<p>{p}</p>{rng.choice(BETWEEN)}" for p in paragraphs)
        remark = "".join(f"<p>{sentence(rng)}</p>" for _ in range(2))
        pages.append((i, f"http://{layout}.example/{i}", LAYOUTS[layout].format(body, remark)))
        want[i] = "\n".join(paragraphs)
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_consensus.extract(rows).collect()} == want


def extracted(html: str) -> str:
    return html_consensus.text_at(html, html_consensus.best(html_consensus.parse(html).ballots()))


def test_form_around_a_share_of_the_page():
    """A form within an article goes; one that holds most of the page's prose is the page."""
    small = f"<article><p>{PROSE * 4}</p><form><p>Your name</p></form></article>"
    assert "Your name" not in extracted(small)
    large = f"<article><p>{PROSE}</p><div class='form'><p>{PROSE * 5}</p></div></article>"
    assert extracted(large).count("articles do") == 6


@pytest.mark.parametrize("unit", ["</script ", "<svg/>", "<svg>", "<iframe>", "<form>", "<div class='form'>"])
def test_odd_pages_take_linear_time(unit):
    def seconds(n: int) -> float:
        start = time.perf_counter()
        extracted(("<script>" if unit.startswith("</") else "") + unit * n)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(24_000) < 0.5 + 12 * seconds(4_000)


def test_no_names_without_a_cue():
    """Runs of capitalised words and numbers beside them are no names or addresses; with a salutation or a street word
    they are."""
    model = pii.default_model()
    plain = ["Eran. Eran. Eran. Eran. Eran.", "Reelleelle Reelleelle Reelleelle", "In 12 Berlin Moritz said so", "Anna Maria went", "The 42 Elden Rings"]
    cued = [("so Mr. Thompson said", "name", "Thompson"), ("so Herr Moritz, and", "name", "Moritz"), ("at 5 rue Lamartine, and", "address", "5 rue Lamartine")]
    found = [{(k, own[a:b]) for k, a, b in spans} for own, _, spans in pii.spans_of(pa.array([*plain, *(t for t, _, _ in cued)]), model)]
    assert all(not f for f in found[: len(plain)])
    assert all((kind, value) in f for f, (_, kind, value) in zip(found[len(plain) :], cued))


def test_precision_on_held_out_rows():
    model, rows = pii.default_model(), pii.labelled_examples(1500, seed=77)
    right, found, gold = {}, {}, {}
    for (_, spans), (_, _, every) in zip(rows, pii.spans_of(pa.array([t for t, _ in rows]), model)):
        for counts, these in ((right, set(spans) & set(every)), (found, every), (gold, spans)):
            for kind, _, _ in these:
                counts[kind] = counts.get(kind, 0) + 1
    for kind, precision, recall in (("name", 0.8, 0.6), ("address", 0.9, 0.75), ("secret", 0.95, 0.9), ("id", 0.95, 0.9)):
        assert right[kind] / found[kind] >= precision and right[kind] / gold[kind] >= recall, kind


def test_spans_that_overlap_base_spans_fall_away():
    """By bisection, as by comparing all with all, also where base spans overlap each other."""
    model = pii.default_model()
    rng = random.Random(6)
    bits = ["mail a.b@example.org ", "+1 (212) 555-0199 ", "10.0.0.1 ", "4111 1111 1111 1111 ", "token = abcdefabcdefabcdefabcdefabcdefabcdefabcd ", "and so on. ", "212-555-0123 "]
    for _ in range(60):
        (own, base, every), = pii.spans_of(pa.array(["".join(rng.choices(bits, k=20))]), model)
        more = [s for s in every if s not in base]
        assert not any(a < y and x < b for _, a, b in more for _, x, y in base)
        assert re.sub(r"\s", "", own)


def test_many_spans_take_linear_time():
    model = pii.default_model()

    def seconds(n: int) -> float:
        start = time.perf_counter()
        list(pii.spans_of(pa.array(["mail a.b@example.org token = abcdefabcdefabcdefabcdefabcdefabcdefabcd +1 (212) 555-0199 " * n]), model))
        return time.perf_counter() - start

    seconds(50)
    assert seconds(12_000) < 1 + 12 * seconds(2_000)
