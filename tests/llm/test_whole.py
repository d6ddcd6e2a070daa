"""Whole inputs count: the ends of long texts, wrapped notices, broken pages, pairs of terms, copies among vectors."""

import pytest

from quarry.llm import html_text, quality


def test_letters_of_the_whole_text():
    """The page opens with prose and goes on as numbers."""
    band = lambda share: quality.WORDS + quality.SHAPES + quality._hash(f"letters{int(share * 12)}", quality.BANDS)
    text = "word " * 800 + "12345 " * 8000
    ids = set(quality.Terms()(text)[0].tolist())
    assert band(3200 / len(text)) in ids and band(0.8) not in ids
    assert quality.shape("a" * 64 + "9!") == "a9!"


ARTICLE = "<article><p>This is a long first paragraph of the article, with words.</p><p>And a second one follows here, with more words.</p></article>"


@pytest.mark.parametrize("page", ["<html><head><title>T</title>{}", "<html><head><meta charset=utf-8><body>{}", "<body><svg viewBox='0 0 1 1'/>{}", "<body><svg><title/></svg>{}", "<body><svg xmlns=http://a/><p>no</p></svg>{}"])
def test_optional_end_of_head_and_closed_elements(page):
    assert html_text.main_text(page.replace("{}", ARTICLE)).split("\n\n") == ["This is a long first paragraph of the article, with words.", "And a second one follows here, with more words."]
