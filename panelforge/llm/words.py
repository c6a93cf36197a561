"""Words of texts as byte strings: ASCII letters lower-cased, words of ASCII letters, digits and all other characters."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Everything but the ASCII characters that are neither digits nor lower-case letters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
CHUNK = 4 << 20


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time; a cut never falls into a word."""
    data = (text or "").encode().lower()
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > CHUNK:
            cut = _BREAK.search(data, at + CHUNK)
            end = cut.start() if cut else end
        yield WORD.findall(data, at, end)
        at = end
