"""Personal data and tags longer than any in the test tables."""

import time

from tidemark.llm import html, pii


def test_long_secrets_and_local_parts_are_whole_candidates():
    late = "abcdefghij" * 8 + "1234"
    long_ = "Ab3" * 100
    for run in (late, long_, long_ * 100):
        spans = [(s, k, e) for s, k, e, _ in pii.candidates(f"token {run} end")]
        assert (6, pii.SECRET, 6 + len(run)) in spans
    assert not pii.candidates("token " + "x" * 50_000 + " end")
    for local in ("a" * 65, "first.last" * 20, "x" * 50_000):
        assert [(s, k, e) for s, k, e, _ in pii.candidates(f"to {local} [at] host[dot]com now")] == [(3, pii.EMAIL, 3 + len(local) + len(" [at] host[dot]com"))]
    t = "a(at)b.com_x(at)c.com"
    assert [t[s:e] for s, e in pii.masked_emails(t)] == ["a(at)b.com", "_x(at)c.com"]


def test_long_tags_keep_their_attributes():
    for data in ("A" * 20_000, "A > B " * 5_000, "it's " * 10_000):
        tag = f'<div data-x="{data}" class="sidebar">'
        assert html.tokens(f"{tag}x</div>") == [("open", "div", ' data-x="" class="sidebar"'), ("text", "", "x"), ("close", "div", "")]
        assert html.wanted(f"<p>one</p>{tag}advert text</div><p>two</p>") == html.wanted("<p>one</p><p>two</p>")
        assert ("text", "", "kept") in html.wanted(f'<div data-x="{data} hidden" class="story">kept</div>')
        assert ("text", "", "gone") not in html.wanted(f'<div data-x="{data}" hidden>gone</div>')


def test_open_quotes_are_not_scanned_again_and_again():
    at = time.monotonic()
    for page in ('<a b="' + "<i>x" * 200_000, "<a b='x\">" * 100_000 + '"', "<a " * 200_000):
        html.tokens(page)
    assert time.monotonic() - at < 60
