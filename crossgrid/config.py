"""Settings that queries share. Dates are those of the bundled tables; pass other Splits for other data."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

HORIZONS = (1, 2, 3, 5, 10, 21)
MIN_NAMES = 20
PERIODS_PER_YEAR = 252
QUANTILE = 0.2
COST_BPS = 15.0
EMBARGO = 5


@dataclass(frozen=True)
class Splits:
    """Inclusive date ranges by name; ``a+b`` names a union."""

    ranges: dict[str, tuple[date, date]] = field(
        default_factory=lambda: {
            "warmup": (date(1995, 1, 1), date(1995, 12, 31)),
            "train": (date(1996, 1, 1), date(1997, 12, 31)),
            "val_a": (date(1998, 1, 1), date(1999, 12, 31)),
            "val_b": (date(2000, 1, 1), date(2000, 12, 31)),
            "holdout": (date(2001, 1, 1), date(2001, 12, 31)),
        }
    )

    def parts(self, name: str) -> list[tuple[date, date]]:
        missing = [p for p in name.split("+") if p not in self.ranges]
        if missing:
            raise ValueError(f"unknown split: {missing[0]}")
        return [self.ranges[p] for p in name.split("+")]

    @property
    def holdout_start(self) -> date:
        return self.ranges["holdout"][0]


SPLITS = Splits()
