"""Syntax that only later compatibility levels know."""

from __future__ import annotations

#: Least level and words of a construct; ``*`` is any word, ``a|b`` one of two (fixed values).
SINCE: tuple[tuple[int, str], ...] = (
    (110, "IIF ("), (110, "TRY_CONVERT ("), (110, "WITHIN GROUP ("), (110, "OFFSET * ROW|ROWS"), (110, "FETCH NEXT|FIRST * ROW|ROWS ONLY"), (110, "WITH RESULT SETS"),
    (130, "CREATE OR ALTER"), (130, "DROP * IF EXISTS"), (130, "AT TIME ZONE"), (130, "FOR SYSTEM_TIME"),
    (160, "IS DISTINCT FROM"), (160, "IS NOT DISTINCT FROM"), (160, "TRIM ( LEADING|TRAILING|BOTH"), (160, "WINDOW * AS ("),
)
_FORMS = [(level, [None if w == "*" else frozenset(w.split("|")) for w in form.split()]) for level, form in SINCE]
_FIRST: dict[str, list] = {}
for _level, _form in _FORMS:
    for _word in _form[0]:
        _FIRST.setdefault(_word, []).append((_level, _form))
NEWEST = max(level for level, _ in SINCE)


def too_new(tokens: list[str], kinds: list[str], compat: int) -> tuple[int, int] | None:
    """(place, level) of the first construct of a batch that the level doesn't know; None if there is none."""
    if compat >= NEWEST:
        return None
    for i, (t, k) in enumerate(zip(tokens, kinds)):
        if k == "STR" or k == "QID":
            continue
        for level, form in _FIRST.get(t.upper(), ()):
            if compat < level and len(tokens) - i >= len(form):
                if all(f is None or kinds[i + j] not in ("STR", "QID") and tokens[i + j].upper() in f for j, f in enumerate(form)):
                    return i, level
    return None
