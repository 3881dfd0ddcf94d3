"""Contexts of anchors share no string, so no string is sorted or digested twice."""

from __future__ import annotations

import random

import pytest

from costproof.llm import suffix_dedup


@pytest.mark.parametrize("part_bits", [20, 10])
def test_every_string_lies_in_the_context_of_one_anchor(monkeypatch, part_bits):
    monkeypatch.setattr(suffix_dedup, "PART_BITS", part_bits)
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(n)) for n in (5000, 200, 777)] + [b"z" * 900]
    starts = [(d, at) for d, lo, hi, _, _ in suffix_dedup._contexts(texts, 200) for at in range(lo, hi - 199)]
    assert sorted(starts) == [(d, at) for d, t in enumerate(texts) for at in range(len(t) - 199)]


def test_contexts_of_no_anchor_are_counted_as_none():
    counted, spans = suffix_dedup._counted(iter([]))
    assert spans == [] and all(len(c) == 0 for c in counted)
