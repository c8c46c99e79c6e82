"""What of an article stays: by names, lists of links, repeats and kinds of elements, with and without neighbours."""

from __future__ import annotations

import random
import time

import pytest

from arboris.llm import html_wrapper
from arboris.llm.html_wrapper import extract, infer, judged

SCHEMA = "page_id long, url string, html string"
PAGE = "<html><head><title>{t}</title></head><body><nav><a>n</a></nav><article><h1>{t}</h1><p>First {a}.</p>{x}<p>Then {b}.</p></article><footer>f</footer></body></html>"
STAYS = [
    ("<ul><li><a href=a>Alpha {i}</a></li><li><a href=b>Beta {i}</a></li><li><a href=c>Gamma {i}</a></li></ul>", "Alpha {i}\nBeta {i}\nGamma {i}"),
    ("<p class='related'>Related work {i} is told here.</p>", "Related work {i} is told here."),
    ("<p class='search-algorithm'>The search {i} ends.</p>", "The search {i} ends."),
    ("<div class='ad-hoc-analysis'>An analysis {i}.</div>", "An analysis {i}."),
    ("<section id='comments-on-method'><p>On method {i}.</p></section>", "On method {i}."),
    ("<p>So <math><mi>x{i}</mi><mo>=</mo><mn>2</mn></math> holds.</p>", "So x{i}=2 holds."),
    ("<p>A <a class='related'>linked word {i}</a> amid.</p>", "A linked word {i} amid."),
    ("<blockquote>Said {i} once.</blockquote>", "Said {i} once."),
]
GOES = [
    "<div class='ad'>Buy {i} now</div>", "<div class='ad-slot-3'>Buy {i}</div>", "<aside>Side {i}</aside>", "<div class='newsletter-signup'><form>mail</form>Join {i}</div>",
    "<div class='social-share'><a>f</a> <a>t</a></div>", "<script>x({i})</script>",
]


def page(i, x):
    rng = random.Random(i)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    html = PAGE.format(t=f"T {i}", a=(a := say(30)), b=(b := say(30)), x=x.replace("{i}", str(i)))
    return html, f"T {i}\nFirst {a}.\n", f"Then {b}."


@pytest.mark.parametrize("n", [1, 2, 3, 6])
@pytest.mark.parametrize("block, text", STAYS)
def test_article_text_stays(block, text, n):
    wrapper = judged(infer([page(i, block)[0] for i in range(n)])) if n > 1 else None
    for i in range(n):
        html, before, after = page(i, block)
        assert extract(html, wrapper) == before + text.replace("{i}", str(i)) + "\n" + after


@pytest.mark.parametrize("n", [1, 2, 3, 6])
@pytest.mark.parametrize("block", GOES)
def test_what_is_no_article_goes(block, n):
    wrapper = judged(infer([page(i, block)[0] for i in range(n)])) if n > 1 else None
    for i in range(n):
        html, before, after = page(i, block)
        assert extract(html, wrapper) == before + after


def test_comments_go_by_place_and_name():
    for n in (1, 4):
        pages = [page(i, "")[0].replace("</article>", f"<div class=comments><p>A reader {i} says {'much ' * 40}</p></div></article>") for i in range(n)]
        wrapper = judged(infer(pages)) if n > 1 else None
        assert all(extract(p, wrapper) == "".join(page(i, "")[1:]) for i, p in enumerate(pages))


def test_evidence_for_template_grows_with_titles_and_falls_with_length():
    odds = {}
    for length in (30, 100, 1000):
        text = ("legal " * 400)[:length]
        for n in (2, 3, 4, 5, 9):
            pages = [page(i, f"<div class=q>{text}</div>")[0] for i in range(n)]
            odds[length, n] = text.strip() in extract(pages[0], judged(infer(pages)))
    assert [odds[30, n] for n in (2, 3, 4, 5, 9)] == [False] * 5
    assert [odds[1000, n] for n in (2, 3, 4, 5, 9)] == [True, True, False, False, False]
    for length in (30, 100, 1000):  # never back again with more pages
        seen = [odds[length, n] for n in (2, 3, 4, 5, 9)]
        assert seen == sorted(seen, reverse=True)


def mixed_layouts(n):
    rng = random.Random(3)
    out = []
    for i in range(n):
        blocks = "".join(f"<div class='b{rng.choice('abcdefghij')}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}'><p>text {i} {k} {'word ' * 6}</p></div>" for k in range(30))
        out.append(page(i, blocks)[0])
    return out


def test_mixed_layouts_keep_a_small_wrapper():
    pages = mixed_layouts(400)
    start = time.perf_counter()
    wrapper = judged(infer(pages))
    took = time.perf_counter() - start
    text = html_wrapper.dump(wrapper)
    assert took < 12 and len(text) < 100_000 < sum(map(len, pages))
    for p in pages[::40]:
        assert extract(p, wrapper).count("text ") == 30


def test_a_hot_host_is_many_cells(spark):
    rows = [(i, "http://hot/x", page(i, STAYS[0][0])[0]) for i in range(700)] + [(1000 + i, f"http://h{i % 9}/x", page(i, "")[0]) for i in range(90)] + [(2000, "http://hot/x", None), (2001, None, "<p>a")]
    df = spark.createDataFrame(rows, SCHEMA)
    for bound in (html_wrapper.BROADCAST_BYTES, 0):
        got = {r["page_id"]: r["text"] for r in html_wrapper.main_text(df, broadcast_bytes=bound, cell=64).collect()}
        assert len(got) == len(rows) and got[2000] == "" and got[2001] == "a"
        for i in range(700):
            before, after = page(i, "")[1:]
            assert got[i] == before + STAYS[0][1].replace("{i}", str(i)) + "\n" + after


def rare_boxes(n, every, parts):
    """Pages of ever new classes; each ``every``-th has one of two boxes, and a list of links, that come seldom."""
    rng = random.Random(5)
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    out, want = [], []
    for i in range(n):
        blocks = [(f"<div class='u{letters()}'><p>text {i} {k} {letters()} {'word ' * 6}</p></div>", f"text {i} {k}") for k in range(parts)]
        box = f"<div class='{'zq'[i // every % 2]}box'>Read more on our fine offers</div>" if i % every == 0 else ""
        out.append(page(i, "".join(b for b, _ in blocks) + box)[0])
        want.append([t for _, t in blocks])
    return out, want


def test_parts_that_come_seldom_gather_their_evidence(spark):
    pages, want = rare_boxes(240, 10, 20)
    df = spark.createDataFrame([(i, "http://wide/x", p) for i, p in enumerate(pages)], SCHEMA)
    for cell in (512, 32):
        texts = {r["page_id"]: r["text"] for r in html_wrapper.main_text(df, cell=cell).collect()}
        assert all(t in texts[i] for i, ts in enumerate(want) for t in ts)
        assert not [i for i, t in texts.items() if "fine offers" in t]
    wrapper = judged(infer(pages))
    assert not [p for p in pages if "fine offers" in extract(p, wrapper)]
