"""Registered sport mappers: Python callables that are asked before the built-in keywords, the last registered first."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.shipping import shipped
from .columns import SPORT_KEYWORDS, SPORT_NUMBERS, SPORTS, infer_sport

Mapper = Callable[[Any], str | None]
_mappers: list[Mapper] = []


def register(mapper: Mapper) -> None:
    _mappers.append(mapper)


def unregister(mapper: Mapper) -> bool:
    """Takes a mapper back; whether it was there."""
    if mapper in _mappers:
        _mappers.remove(mapper)
        return True
    return False


def clear() -> None:
    _mappers.clear()


def infer(value: Any, mappers: list[Mapper] | None = None) -> str | None:
    """Sport of a label, a number 0 to 5, or the first that a nested mapping or list yields; mappers come first."""
    for m in reversed(_mappers if mappers is None else mappers):
        if (found := m(value)) is not None:
            return found
    if isinstance(value, str):
        if value in SPORTS:
            return value
        words = set("".join(c if c.isascii() and c.isalnum() else " " for c in value.lower()).split())
        return next((s for s, keys in SPORT_KEYWORDS if words & set(keys)), None)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return SPORT_NUMBERS[int(value)] if 0 <= int(value) < len(SPORT_NUMBERS) else None
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, (list, tuple)) else ()
    return next((s for v in inner if (s := infer(v, mappers)) is not None), None)


def sport_column(label: Column) -> Column:
    """Sport of a text column: by expression alone without mappers, else by an Arrow-batched function over them."""
    if not _mappers:
        return infer_sport(label)
    mappers = [*_mappers]

    def by_mappers(labels):
        return labels.map(lambda v: infer(v, mappers))

    run = shipped(by_mappers)

    @F.pandas_udf("string")
    def mapped(labels: pd.Series) -> pd.Series:
        return run(labels)

    return mapped(label)
