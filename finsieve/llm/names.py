"""Column names that do not clash with those of a caller's table."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores before it as it takes to be free; case does not count."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name
