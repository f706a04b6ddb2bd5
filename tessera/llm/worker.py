"""What a Python worker keeps between tasks: the state of the operator that ran last, and nothing else.

Workers serve one operator after another. Tables and vocabularies of one that is done would stay
in memory beside those of the next, so there is one place for them all.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")

_held: dict[tuple, object] = {}


def hold(key: tuple, make: Callable[[], T]) -> T:
    """The object of this key, made if it isn't what the worker holds; all others are let go."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]  # type: ignore[return-value]


def release() -> None:
    """Let go of what earlier tasks left."""
    _held.clear()
