"""Recursion as deep as a document nests."""

from __future__ import annotations

from collections.abc import Iterator


def unwind(steps: Iterator) -> None:
    """Runs a recursive generator that yields its calls of itself, on a list instead of the interpreter's stack."""
    stack = [steps]
    while stack:
        below = next(stack[-1], None)
        if below is None:
            stack.pop()
        else:
            stack.append(below)
