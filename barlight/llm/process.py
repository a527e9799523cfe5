"""What a Python worker keeps between tasks. Functions travel by value, so a module global would be new in each task."""

import sys
from collections.abc import Callable
from types import ModuleType


def kept(key, make: Callable):
    here = sys.modules.setdefault("_barlight_kept", ModuleType("_barlight_kept")).__dict__
    if key not in here:
        here[key] = make()
    return here[key]
