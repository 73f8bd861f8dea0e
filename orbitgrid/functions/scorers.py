"""Score functions by name: Column functions, or pandas UDFs with the same call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

_SCORERS: dict[str, Callable[..., Column]] = {}


def register(name: str, score: Callable[..., Column]) -> None:
    """Name a function of columns; a later one of the same name replaces it."""
    _SCORERS[name] = score


def registered() -> list[str]:
    return sorted(_SCORERS)


def scored(df: DataFrame, name: str, *inputs: Column, out: str = "score") -> DataFrame:
    """`df` with the named score of the inputs."""
    if name not in _SCORERS:
        raise KeyError(f"no scorer {name!r}; registered: {', '.join(registered())}")
    return df.withColumn(out, _SCORERS[name](*inputs))
