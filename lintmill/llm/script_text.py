"""Language of a script from its path."""

from __future__ import annotations

import re

_EXTENSION = re.compile(r"\.([A-Za-z0-9]+)\s*$")


def language_of(path: str | None) -> str:
    """``json``, ``xml`` or ``tsql``; the extension counts in any letter case, no or any other extension means T-SQL."""
    m = _EXTENSION.search(path or "")
    ext = m.group(1).lower() if m else ""
    return ext if ext in ("json", "xml") else "tsql"
