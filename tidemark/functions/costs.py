"""Transaction costs as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostModel:
    commission_bps: float = 1.0
    half_spread_bps: float = 2.0
    slippage_bps: float = 1.0
    borrow_bps_per_year: float = 50.0
    volatility_slippage_multiplier: float = 0.05
    participation_slippage_bps: float = 50.0
    market_impact_multiplier: float = 0.10

    def __post_init__(self) -> None:
        if min(vars(self).values()) < 0:
            raise ValueError("cost parameters must not be negative")

    def columns(self, turnover: Column, volatility: Column, participation: Column, short_exposure: Column, days: Column) -> dict[str, Column]:
        """commission, spread, slippage, market_impact, borrow and total, as returns on equity."""
        traded, vol, part = F.abs(turnover), F.greatest(F.lit(0.0), volatility), F.greatest(F.lit(0.0), participation)
        out = {
            "commission": traded * (self.commission_bps / 1e4),
            "spread": traded * (self.half_spread_bps / 1e4),
            "slippage": traded * (self.slippage_bps + vol * (1e4 * self.volatility_slippage_multiplier) + part * self.participation_slippage_bps) / 1e4,
            "market_impact": traded * vol * F.sqrt(part) * self.market_impact_multiplier,
            "borrow": F.abs(F.least(F.lit(0.0), short_exposure)) * (self.borrow_bps_per_year / 1e4) * F.greatest(F.lit(0.0), days) / 365.0,
        }
        return out | {"total": sum(out.values(), F.lit(0.0))}

    def amount(self, turnover: float, volatility: float = 0.0, participation: float = 0.0, short_exposure: float = 0.0, days: float = 0.0) -> float:
        """The total of ``columns`` for one trade, where an account's state decides the trade."""
        traded, vol, part = abs(turnover), max(0.0, volatility), max(0.0, participation)
        bps = self.commission_bps + self.half_spread_bps + self.slippage_bps + part * self.participation_slippage_bps
        by_risk = vol * (self.volatility_slippage_multiplier + self.market_impact_multiplier * part**0.5)
        return traded * (bps / 1e4 + by_risk) + abs(min(0.0, short_exposure)) * self.borrow_bps_per_year / 1e4 * max(0.0, days) / 365.0
