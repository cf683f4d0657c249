"""Plain cutting against the general pattern."""

from __future__ import annotations

import public_tokenizers
import regex
from hypothesis import given, settings, strategies as st

from tessella.llm import pretokens

GENERAL = regex.compile(public_tokenizers.PATTERN).findall
CUT = pretokens.cutter(public_tokenizers.PATTERN)


def test_the_fixed_pattern_is_that_of_the_vocabularies():
    assert public_tokenizers.PATTERN == pretokens.BYTE_LEVEL


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("aZé ÿɏ'strevmld09_-.,!\n\t\r  ×÷") | st.characters(max_codepoint=0x2FF), max_size=60))
def test_texts_are_cut_alike(text):
    assert CUT(text) == GENERAL(text)
    assert "".join(CUT(text)) == text


def test_every_character_that_is_cut_plainly_is_of_its_class():
    for c in map(chr, range(0x250)):
        text = f"a{c}b {c}{c} {c}1{c}"
        assert CUT(text) == GENERAL(text)


def test_other_patterns_are_general():
    assert pretokens.cutter(r"\w+")("a b") == ["a", "b"]
