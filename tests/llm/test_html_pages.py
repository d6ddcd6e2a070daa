"""Pages beyond the usual: optional tags left out, deep and very long ones, no class names, odd columns; and held-out generated pages."""

import time

import pytest
from pyspark.sql import functions as F

from quarry.llm import html_text


def test_generated_pages_that_the_fit_has_not_seen():
    w, right, wrong = html_text.weights(), 0, 0
    for page in html_text.training_pages(200, seed=99):
        blocks = html_text.blocks_of(page)
        for b, keep in zip(blocks, html_text.label(blocks, w), strict=True):
            want = next(c for c in b.text if c in "bc") == "c"
            right, wrong = right + (keep == want), wrong + (keep != want)
    assert wrong <= 0.01 * right


def test_structure_alone():
    """No class, id, article or main: link lists and short notices around paragraphs."""
    links = "".join(f"<li><a href=/{i}>Topic {i}</a></li>" for i in range(8))
    page = (
        f"<body><div><ul>{links}</ul></div><div><div><h2>How rivers bend</h2><p>A river that meets a harder bank turns away from it, and cuts the softer side instead.</p>"
        f"<p>Over many years the loop grows until the water takes the short way again.</p></div></div><div><ul>{links}</ul></div><div>&copy; 2024 The Site</div></body>"
    )
    assert html_text.main_text(page).split("\n\n") == [
        "How rivers bend", "A river that meets a harder bank turns away from it, and cuts the softer side instead.", "Over many years the loop grows until the water takes the short way again.",
    ]


@pytest.mark.parametrize("head", ["<head><title>t</title>", "<head><meta charset=utf-8><title>t</title><style>p{}</style>", "<title>t</title>"])
@pytest.mark.parametrize("body", ["<body>", ""])
def test_head_without_end(head, body):
    page = f"<html>{head}{body}<article><p>Hello world, this is the text of the page.</p></article>"
    assert html_text.main_text(page) == "Hello world, this is the text of the page."


def test_deep_and_long_pages_take_linear_time():
    def seconds(page):
        best = 9.0
        for _ in range(2):
            began = time.perf_counter()
            html_text.main_text(page)
            best = min(best, time.perf_counter() - began)
        return best

    for form in (lambda n: "<div>" * n + "<p>Some words in a block.</p>" * n + "</div>" * n, lambda n: "<div><p>Some words." * n, lambda n: "<article>" + "<p>Some words in a block.</p>" * n, lambda n: "<article><p>text" + "</b></section></td>" * n):
        assert seconds(form(8000)) < 40 * max(seconds(form(1000)), 0.01)


def test_long_page_whole():
    text = html_text.main_text("<article>" + "".join(f"<p>Paragraph number {i} of a long page.</p>" for i in range(30_000)))
    assert text.count("\n\n") == 29_999 and text.endswith("Paragraph number 29999 of a long page.")


def test_clashing_names_nulls_and_repeated_rows(spark):
    rows = [(1, "u", "<article><p>Good text of a page.</p></article>")] * 2 + [(None, None, None), (2, "v", "plain text without any tag, but long enough to be kept.")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("clash").alias(c) for c in ("text", "n_chars", "node", "page")])
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_text.extract(pages).collect()), key=str)
    assert [g[2] for g in got if g[0] == 1] == ["Good text of a page."] * 2 and (0, None, "", 0) in got and all(g[3] == len(g[2]) for g in got)
