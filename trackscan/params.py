"""Scoring weights and thresholds, checked before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class ScoringParams:
    """Points per finding and the score limits of the risk labels."""

    tracking_pixel: float = 5
    external_script: float = 8
    inline_script: float = 3
    high_risk_domain: float = 10
    low: float = 80
    medium: float = 50
    high: float = 0

    def __post_init__(self):
        for field in fields(self):
            value = getattr(self, field.name)
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ValueError(f"{field.name} must be a number")
        for name in ("tracking_pixel", "external_script", "inline_script", "high_risk_domain"):
            if getattr(self, name) < 0:
                raise ValueError(f"weight {name} must not be negative")
        if not self.high <= self.medium <= self.low:
            raise ValueError("thresholds must be ordered: high <= medium <= low")


DEFAULT_PARAMS = ScoringParams()
