"""Tunable thresholds. Every operator takes its ``as_of`` instant separately; nothing reads the clock."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import ClassVar


@dataclass(frozen=True)
class Config:
    currency: str = "kr"
    overpaid_pct: float = 0.15
    overpaid_floor: float = 2.0
    baseline_window: int = 5
    increase_recent_days: int = 30
    increase_prior_days: int = 90
    best_store_days: int = 90
    cooldown_days: int = 7
    restock_confidence: float = 0.75
    evidence_ttl_days: int = 7
    item_marker: str = ""
    item_marker_position: str = "prefix"
    translation_confidence: float = 0.85
    translate_names: bool = False

    # Fixed values: (low, high) of every option that has a valid range.
    RANGES: ClassVar[dict] = {
        "overpaid_pct": (0.01, 1.0),
        "baseline_window": (3, 20),
        "increase_recent_days": (7, 180),
        "increase_prior_days": (14, 365),
        "best_store_days": (30, 365),
        "cooldown_days": (1, 30),
        "restock_confidence": (0.5, 0.99),
        "evidence_ttl_days": (0, 30),
        "translation_confidence": (0.5, 0.99),
    }

    def __post_init__(self) -> None:
        for name, (low, high) in self.RANGES.items():
            value = getattr(self, name)
            if not low <= value <= high:
                raise ValueError(f"{name}={value} is outside [{low}, {high}]")
        if self.item_marker_position not in ("prefix", "suffix"):
            raise ValueError("item_marker_position must be prefix or suffix")

    @classmethod
    def from_options(cls, options: dict) -> "Config":
        known = {f.name for f in fields(cls)}
        unknown = set(options) - known
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return cls(**options)
