"""Objects that a Python worker makes once and keeps from task to task."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable

#: The package's functions reach workers by value, with globals of their own for each task, so
#: what is to stay lives in a module of the worker's interpreter.
_HOME = "spark_climbs_kept"


def kept(name: Hashable, make: Callable):
    """The worker's object of that name, made when it is first asked for."""
    found = _objects()
    if name not in found:
        found[name] = make()
    return found[name]


def release() -> None:
    """Let go of all that is kept. Workers go from stage to stage, so an operator that keeps nothing
    calls this first, or its tasks run beside the vocabularies and caches of the one before."""
    _objects().clear()


def _objects() -> dict:
    home = sys.modules.setdefault(_HOME, types.ModuleType(_HOME))
    return home.__dict__.setdefault("objects", {})
