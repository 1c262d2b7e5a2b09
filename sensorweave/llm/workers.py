"""What a Python worker keeps from task to task: one object, so that operators that follow each other don't add up."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable
from typing import Any

_held: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """This process's object for ``key``; making one lets go of any other's first."""
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]
