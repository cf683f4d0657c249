"""Cutting texts into pre-tokens."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: Fixed pattern of the public byte-level vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters below U+0250 but for the few signs between them that are none.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_OTHER = re.compile(rf"[^\t\n\r -~{_LETTERS}]")
_PLAIN = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^ \t\n\r{_LETTERS}0-9]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a pattern in a text. For the byte-level pattern, texts of ASCII and Latin letters alone are cut by plain character ranges, which give the same matches."""
    general = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL:
        return general
    plain, other = _PLAIN.findall, _OTHER.search
    return lambda text: general(text) if other(text) else plain(text)
