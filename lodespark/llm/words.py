"""Words as all operators of this subpackage see them."""

from __future__ import annotations

import re

#: A maximal run of letters and digits; the underscore separates.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of the lower-cased text, in order; none for null."""
    return WORD.findall(text.lower()) if text else []
