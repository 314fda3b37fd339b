"""One operator's word caches at a time in a worker process, as workers are used again for the next operator's tasks."""

from __future__ import annotations

from collections.abc import Callable

_CLEAR: dict[str, list[Callable[[], None]]] = {}
_OWNER: list[str] = []


def register(owner: str, clear: Callable[[], None]) -> None:
    _CLEAR.setdefault(owner, []).append(clear)


def claim(owner: str) -> None:
    """Empty the caches of all other operators."""
    if _OWNER != [owner]:
        _OWNER[:] = [owner]
        for name, clears in _CLEAR.items():
            for clear in clears if name != owner else ():
                clear()
