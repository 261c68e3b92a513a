"""Thresholds and environment settings in one immutable object."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# They must equal the reference's for equal results.
GOVERNORATES = ("Tunis", "Sfax", "Sousse", "Ariana", "Bizerte", "Gabes", "Kairouan")
PAYMENT_METHODS = ("eDinar", "Flouci", "Konnect", "Carte Bancaire", "Cash on Delivery")
BRANCHES = ("Tunis-GNC", "Sfax-Agency", "Sousse-Agency", "Ariana-Desk", "Bizerte-Unit")
RISK_WEIGHTS = {"velocity_risk": 0.3, "travel_risk": 0.3, "high_value_risk": 0.2, "d17_risk": 0.2}
THRESHOLD_GRID = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95)
ALERT_TYPES = ("high_risk", "random_sample", "uncertainty_sample")
CONFIRMED, FALSE_POSITIVE = "Confirmed Fraud", "False Positive"
FEATURE_LABELS = {
    "v_count": "High velocity (v_count)",
    "g_dist": "Multi-governorate travel (g_dist)",
    "avg_amount": "High value transfer (avg_amount)",
    "is_smurfing": "Structuring pattern (is_smurfing)",
    "high_velocity_flag": "D17 velocity cap (high_velocity_flag)",
    "velocity_risk": "Velocity risk flag",
    "travel_risk": "Travel risk flag",
    "high_value_risk": "High value risk flag",
    "d17_risk": "D17 Flouci risk flag",
    "risk_score": "Composite risk score",
}


def _number(name: str, default: float, low: float | None = None, high: float | None = None) -> float:
    try:
        value = float(os.environ.get(name, default))
    except ValueError:
        value = default
    value = value if low is None else max(low, value)
    return value if high is None else min(high, value)


def _zone(text: str) -> tuple[float, float]:
    """Two comma separated numbers, each brought into [0, 1], the smaller first; empty
    parts count for nothing. (0.4, 0.6) if there are not two or one is unreadable."""
    try:
        low, high = sorted(max(0.0, min(float(x), 1.0)) for x in text.split(",") if x.strip())
    except ValueError:
        return 0.4, 0.6
    return low, high


@dataclass(frozen=True)
class Settings:
    high_risk: float = 0.85
    heuristic_label: float = 0.9
    velocity_limit: int = 3
    velocity_cap: int = 5
    governorate_limit: int = 1
    high_value: float = 5000.0
    d17_amount: float = 2000.0
    d17_boost: float = 0.2
    smurfing: tuple[float, float] = (1400.0, 1500.0)
    window: str = "5 minutes"
    slide: str = "1 minute"
    watermark: str = "10 minutes"
    sample_rate: float = field(default_factory=lambda: _number("RANDOM_SAMPLE_RATE", 0.01, 0, 1))
    sample_max_prob: float = field(default_factory=lambda: _number("RANDOM_SAMPLE_MAX_PROB", 0.1, 0, 1))
    uncertainty: tuple[float, float] = field(default_factory=lambda: _zone(os.environ.get("UNCERTAINTY_ZONE", "0.4,0.6")))
    retrain_feedback: int = field(default_factory=lambda: int(_number("RETRAIN_FEEDBACK_THRESHOLD", 100)))
    retrain_min_feedback: int = field(default_factory=lambda: int(_number("RETRAIN_MIN_FEEDBACK", 100)))
    drift_window_hours: int = field(default_factory=lambda: int(_number("DRIFT_WINDOW_HOURS", 24)))
    drift_threshold: float = 0.1
    ks_alpha: float = 0.05
    promotion_gain: float = field(default_factory=lambda: _number("CHAMPION_PROMOTION_THRESHOLD", 0.02))
    dlq_max_attempts: int = field(default_factory=lambda: int(_number("DLQ_RETRY_MAX_ATTEMPTS", 3)))


DEFAULTS = Settings()
