"""Declarations: column families and the entity tables they make up."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from tessella.functions.states import BitmapActivity, Lifetime, PrependList

Strategy = Lifetime | PrependList | BitmapActivity


@dataclass(frozen=True)
class Family:
    """Columns that one source feeds. ``keys`` maps source columns to the table's key columns; ``where`` filters the source."""

    name: str
    columns: Mapping[str, Strategy]
    keys: Mapping[str, str]
    where: str | None = None


@dataclass(frozen=True)
class EntityTable:
    """One row for each key. ``derived`` columns are expressions over the stitched columns; columns in ``zero`` are 0 for keys that
    their family has not seen, all others null."""

    name: str
    primary_key: tuple[str, ...]
    families: tuple[Family, ...]
    derived: Mapping[str, str] = field(default_factory=dict)
    lookback_days: int = 30
    zero: tuple[str, ...] = ()

    def family_of(self, column: str) -> Family:
        return next(f for f in self.families if column in f.columns)
