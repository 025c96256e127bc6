"""Settings of a store, a strategy and the risk gates, with their defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Self

from barline.functions.scalars import CANDLE_BYTES, FALLBACK_L3, MAX_RING, MIN_RING


class Settings:
    """A dataclass that can be made of text settings, named by PREFIX and the field."""

    PREFIX = ""

    @classmethod
    def from_settings(cls, settings: Mapping[str, str], prefix: str | None = None) -> Self:
        """From text settings like SMA_SHORT; those that are missing or no number keep their default."""
        given = {}
        for f in fields(cls):
            try:
                given[f.name] = type(f.default)(settings[(cls.PREFIX if prefix is None else prefix) + f.name.upper()])
            except (KeyError, ValueError):
                pass
        return cls(**given)


@dataclass(frozen=True)
class StoreOptions:
    max_symbols: int = 10
    ring_capacity: int = 10_000
    #: Where past residencies are written; without it they are dropped.
    data_dir: str | None = None

    @classmethod
    def from_hardware(cls, max_symbols: int, l3_bytes: int = FALLBACK_L3, fraction: float = 1 / 3, data_dir: str | None = None) -> StoreOptions:
        """Rings that fit together into a part of a cache; the same rule as `scalars.ring_capacity`."""
        usable = int(l3_bytes * min(max(fraction, 0.05), 1.0))
        each = usable // max(max_symbols, 1) // CANDLE_BYTES
        return cls(max_symbols, min(max(each, MIN_RING), MAX_RING), data_dir)


@dataclass(frozen=True)
class StrategyOptions(Settings):
    PREFIX = "SMA_"

    short: int = 10
    long: int = 20
    qty: float = 0.1
    price: float = 0.0  # a market order
    strategy: int = 1


@dataclass(frozen=True)
class Gates(Settings):
    """What the executor lets through, set by RISK_MAX_QTY, RISK_MAX_POSITION and the like."""

    PREFIX = "RISK_"

    max_qty: float = 10.0
    max_position: float = 100.0
    max_per_bucket: int = 1000
    #: Length of a rate bucket in the unit of ts. A bucket begins with the first attempt after the last one's end.
    bucket: int = 1_000_000
