"""Runtimes by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Adapter:
    """How one runtime's files become records, and records become its files."""

    name: str
    to_records: Callable[..., DataFrame]
    to_files: Callable[[DataFrame], DataFrame]
    description: str = ""


_ADAPTERS: dict[str, Adapter] = {}


def register(
    name: str,
    to_records: Callable[..., DataFrame],
    to_files: Callable[[DataFrame], DataFrame],
    description: str = "",
) -> Adapter:
    """Add a runtime, or replace the one of that name."""
    _ADAPTERS[name] = Adapter(name, to_records, to_files, description)
    return _ADAPTERS[name]


def adapter(name: str) -> Adapter:
    if name not in _ADAPTERS:
        raise ValueError(f"unknown runtime {name!r}, known: {', '.join(names())}")
    return _ADAPTERS[name]


def names() -> list[str]:
    return sorted(_ADAPTERS)
