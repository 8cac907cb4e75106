"""Cutting texts where no pre-token of the byte-level vocabularies can span the cut."""

from __future__ import annotations

import re

#: Before a single space between two characters that are not white space. The pre-token pattern
#: puts such a space at the start of the next pre-token, so the chunks on both sides are independent.
_CUT = re.compile(r"(?<=\S)(?= \S)")

#: Chunks longer than this many characters are not remembered.
LONGEST_KEPT = 200


def chunks(text: str) -> list[str]:
    """The text cut before such spaces; all chunks but the first begin with one."""
    return _CUT.split(text)
