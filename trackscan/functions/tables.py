"""Rule tables known only at run time: they become part of the plan, in chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import TypeVar

T = TypeVar("T")

# Rules of one constant expression; more rules are more expressions in the row of the page.
CHUNK_RULES = 500


def chunks(items: Sequence[T], sizes: Sequence[int]) -> Iterator[list[T]]:
    """Items in order, in lists whose sizes add up to CHUNK_RULES at most, or of one item."""
    held: list[T] = []
    total = 0
    for item, size in zip(items, sizes, strict=True):
        if held and total + size > CHUNK_RULES:
            yield held
            held, total = [], 0
        held.append(item)
        total += size
    if held:
        yield held
