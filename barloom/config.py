"""Settings as dataclasses, and their YAML or JSON files."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

#: Bar intervals, and how many one-minute bars each holds.
INTERVAL_MINUTES = {"5m": 5, "15m": 15, "1h": 60, "4h": 240, "1d": 1440}
#: The feature layout.
CALENDAR_FIELDS = ("minute_of_day", "hour", "day_of_week", "day_of_month", "month", "quarter", "year", "is_weekend")
FEATURE_ORDER = ("open", "high", "low", "close", "volume", "funding_rate", "open_interest", *CALENDAR_FIELDS)
RETURN_FEATURES = ("log_return", "hl_range", "oc_body", "log_volume", "volume_change", "funding_rate", "open_interest", *CALENDAR_FIELDS)
UNITS = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def frequency_ms(text: str | None) -> int:
    """Milliseconds of a frequency such as 8h, 5m or 30s; 0 if it is none, so that only exact matches are fresh."""
    found = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", text or "")
    return int(found[1]) * UNITS[found[2]] if found else 0


@dataclass(frozen=True)
class AlignmentPolicy:
    """How a sparse modality is joined: its value column, candidate time columns, frequency and policy name."""

    name: str
    frequency: str = "8h"
    policy: str = "forward_fill"
    time_columns: tuple[str, ...] = ("timestamp",)
    value_columns: tuple[str, ...] = ()


#: The columns in which a modality's time and value are looked for, in this order.
FUNDING = AlignmentPolicy("funding_rate", "8h", time_columns=("settlement_time", "timestamp", "calc_time"), value_columns=("funding_rate", "last_funding_rate", "fundingRate"))
OPEN_INTEREST = AlignmentPolicy("open_interest", "5m", time_columns=("timestamp", "create_time", "calc_time", "time", "transact_time"), value_columns=("open_interest", "sum_open_interest", "sumOpenInterest", "sum_open_interest_value", "open_interest_value"))


@dataclass(frozen=True)
class WindowSpec:
    length: int = 512
    stride: int = 16
    max_gap_ms: int = 300_000


@dataclass(frozen=True)
class ValidationRules:
    """Rules by modality; a rule that is absent is on, except that missing funding values are allowed."""

    allow_duplicates: bool = False
    max_gap_seconds: int = 300
    gap_seconds: dict[str, int] = field(default_factory=dict)
    modalities: dict[str, dict[str, bool]] = field(default_factory=lambda: {"funding": {"allow_missing": False}})

    def on(self, modality: str, rule: str, default: bool = True) -> bool:
        return self.modalities.get(modality, {}).get(rule, default)


def load(path: str | Path) -> dict[str, Any]:
    """A YAML or JSON file as a dict. Raises FileNotFoundError."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(path)
    if path.suffix in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(path.read_text()) or {}
    return json.loads(path.read_text())


def active_modalities(registry: dict[str, dict]) -> list[str]:
    """Names whose `enabled` is true. An entry without it is a ValueError, one that is no bool a TypeError."""
    found = []
    for name, entry in registry.items():
        if "enabled" not in entry:
            raise ValueError(f"{name}: no 'enabled'")
        if not isinstance(entry["enabled"], bool):
            raise TypeError(f"{name}: 'enabled' must be true or false")
        if entry["enabled"]:
            found.append(name)
    return found
