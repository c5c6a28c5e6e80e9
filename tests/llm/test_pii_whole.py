"""The field reaches every form that its labelled table holds, and spans across the ends of blocks."""

import pytest

from heddle.llm import pii

FILL = "the morning walk along the harbour was quiet and slow "


def added(text):
    return [text[a:b] for a, _, b in pii.field_spans([text], [pii.base_spans(text)], pii.trained())[0]]


@pytest.mark.parametrize("span", ["foo at bar.com", "foo at barley dot org", "foo (AT) barley.com", "foo [At] barley dot net", "jane at uni dot edu"])
def test_forms_without_digits_are_seeded(span):
    assert span in added(f"{FILL}mail {span} today {FILL}")


def test_a_long_name_is_not_cut():
    name = "k" * 70
    assert added(f"{FILL}mail {name} at barley.com today") == [f"{name} at barley.com"]


def test_spans_across_block_ends():
    # a digit every few words keeps one stretch; numbers stand at every distance from the ends of blocks
    for shift in range(0, 12):
        text = "go " * shift + "".join(f"see 7 and call (415) 555-{1000 + i} now " for i in range(90))
        assert added(text) == [f"(415) 555-{1000 + i}" for i in range(90)]


def test_middles_cover_every_token_once():
    for n in (0, 1, 400, 401, 700, 5000):
        assert [t for _, _, a, b in pii.blocks(n) for t in range(a, b)] == list(range(n))
