"""Words for comparison: maximal runs of letters and digits without case, diacritics, compatibility and format forms."""

from __future__ import annotations

import re
import unicodedata

RUN = re.compile(r"[^\W_]+").findall


def plain(text: str) -> str:
    """NFKD without combining marks and format characters (Unicode Cf), case-folded."""
    if text.isascii():
        return text.lower()
    kept = "".join(
        c for c in unicodedata.normalize("NFKD", text) if c.isascii() or unicodedata.category(c) not in ("Mn", "Me", "Cf")
    )
    folded = kept.casefold()
    if folded.isascii():
        return folded
    return "".join(c for c in unicodedata.normalize("NFKD", folded) if unicodedata.category(c) not in ("Mn", "Me"))


def words(text: str | None) -> list[str]:
    """The words of ``text`` in order; none for null."""
    return RUN(plain(text)) if text else []
