"""Splitting text into units that a byte-level BPE encodes independently of each other.

The tokenizer's own pre-tokens never span a space that has a character other
than white space on either side, and begin with it. Cutting a text before each
such space gives units whose encodings, in order, are the text's encoding; a
unit is one or a few of the library's pre-tokens (a word with its leading space
and trailing punctuation).
"""

from __future__ import annotations

import re

_SAFE = re.compile(r"(?<=\S)(?= \S)")
#: White space other than the space, as Python's re takes it (a superset of Unicode's White_Space).
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c != " " and c.isspace()]


def units(text: str) -> list[str]:
    """Non-empty units whose concatenation is the text."""
    if not text:
        return []
    if text[0] == " " or text[-1] == " " or "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in _OTHER_SPACES):
        return _SAFE.split(text)
    head, *rest = text.split(" ")
    return [head, *[" " + x for x in rest]]
