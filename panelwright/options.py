"""Windows, minimums and horizons, all in one place so that short tables can use smaller ones."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PanelOptions:
    min_origin_year: int = 2000
    lags: tuple[int, ...] = (1, 3, 5)
    rent_lag: int = 3
    horizons: tuple[int, ...] = (1, 2, 3, 5, 10)
    beta_window: int = 10
    beta_min: int = 6
    min_group: int = 10
    focus_group: str | None = None
    publication_lag: int = 2
    vintage_gap: int = 5
    neighbours: int = 10
    macro_window: int = 120
    macro_min: int = 36
    sign_window: int = 3
    sign_min: int = 2
    min_pairs: int = 20

    @property
    def short_lag(self) -> int:
        return min(self.lags)

    @property
    def long_lag(self) -> int:
        return max(self.lags)


@dataclass(frozen=True)
class EvaluationOptions:
    horizons: tuple[int, ...] = (1, 2, 3, 5, 10)
    first_test_year: int = 2010
    min_pairs: int = 20
    min_spread_pairs: int = 50
    draws: int = 2000
    level: float = 0.90
    seed: int = 7
    half_life_years: float = 4.0
    focus_min_rows: int = 500
    bands: int = 20
    importance_repeats: int = 3
