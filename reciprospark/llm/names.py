"""Names of columns that an operator adds."""

from __future__ import annotations


def free(name: str, *taken: str) -> str:
    """``name``, with underscores behind it while a column of ``taken`` has it already."""
    while name in taken:
        name += "_"
    return name
