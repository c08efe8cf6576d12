"""Makes functions of this package runnable in Python workers that were started elsewhere."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark import cloudpickle

ROOT = str(Path(__file__).resolve().parents[2])


def shipped(fn: Callable) -> Callable:
    """fn of one argument, for mapInArrow and its like; workers find the package beside the driver's, or where --py-files put it."""
    code, root = cloudpickle.dumps(fn), ROOT

    def call(data):
        import sys

        from pyspark import cloudpickle as pickle

        if root not in sys.path:
            sys.path.append(root)
        return pickle.loads(code)(data)

    return call
