"""State that a Python worker keeps from task to task."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable
from types import ModuleType
from typing import Any

KEPT = 3  # objects of a worker


def per_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object ``make`` gives, made once per worker process.

    Code travels to the workers by value and gets new globals with every task, so the objects
    live in a module of their own.  They are caches: a new worker makes them again.
    """
    held = sys.modules.setdefault("prodlake_worker", ModuleType("prodlake_worker")).__dict__.setdefault("held", {})
    if key not in held:
        while len(held) >= KEPT:
            held.pop(next(iter(held)))
        held[key] = make()
    return held[key]
