"""Disguised addresses of few digits, and an at sign between spaces."""

from __future__ import annotations

import pytest

from comeback.llm import personal


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("at one two seven dot zero dot zero dot one here", "ip", "one two seven dot zero dot zero dot one"),
        ("eight dot eight dot eight dot eight", "ip", "eight dot eight dot eight dot eight"),
        ("ping 192 dot 168 dot 1 dot 1, then", "ip", "192 dot 168 dot 1 dot 1"),
        ("192 dot 168.one dot 1", "ip", "192 dot 168.one dot 1"),
        ("acht punkt acht [.] 8 (dot) 4", "ip", "acht punkt acht [.] 8 (dot) 4"),
        ("10-dot-0-dot-0-dot-1 5 hops", "ip", "10-dot-0-dot-0-dot-1"),
        ("mail alice @ example.com today", "email", "alice @ example.com"),
        ("a.b @ mail.ex-ample.org.", "email", "a.b @ mail.ex-ample.org"),
        ("300 dot 168 dot 1 dot 1", None, None),
        ("one dot two dot three dot one two three four", None, None),
        ("version 3 dot 1 dot 4", None, None),
        ("3 @ 5.99 each, look at example.com", None, None),
    ],
)
def test_short_disguises(text, kind, span):
    base, every = personal.find(text)
    added = [(personal.KINDS[k], text[a:b]) for a, k, b in every if (a, k, b) not in base]
    assert added == ([] if kind is None else [(kind, span)])


def test_long_texts_take_linear_time():
    for part in ("a-", "1 dot ", "one ", "one two dot ", "a @ ", "a.", "@ a."):
        personal.find(" @ " + part * 50_000)
