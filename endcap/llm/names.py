"""Column names that no column of a caller's table has."""

from __future__ import annotations

from collections.abc import Iterable


def free(columns: Iterable[str], name: str) -> str:
    """``name`` with as many underscores before it as keep it apart (letter case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
