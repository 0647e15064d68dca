"""Numeric column functions: guarded ratios, costs, sizes and the normal distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximations of the normal distribution and its inverse.
CDF = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
CDF_SCALE = 0.2316419
PPF_TOP = (2.515517, 0.802853, 0.010328)
PPF_BOTTOM = (1.432788, 0.189269, 0.001308)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b); null where b is 0 or the ratio is not positive."""
    return F.log(F.try_divide(a, b))


def norm_cdf(x: Column) -> Column:
    t = 1 / (1 + CDF_SCALE * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(CDF):
        poly = (poly + a) * t
    tail = poly * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def norm_ppf(p: Column) -> Column:
    q = F.when(p < 0.5, p).otherwise(1 - p)
    t = F.sqrt(-2 * F.log(q))
    top = PPF_TOP[0] + t * (PPF_TOP[1] + t * PPF_TOP[2])
    bottom = 1 + t * (PPF_BOTTOM[0] + t * (PPF_BOTTOM[1] + t * PPF_BOTTOM[2]))
    z = t - top / bottom
    return F.when((p <= 0) | (p >= 1), None).when(p < 0.5, -z).otherwise(z)


# Pips of symbols that are not plain pairs.
PIPS = {
    "BTCUSD": 1.0, "AUS200": 1.0, "US30": 1.0, "GER40": 1.0, "UK100": 1.0, "NAS100": 1.0, "EUSTX50": 1.0, "JPN225": 1.0,
    "SPX500": 0.1, "XAUUSD": 0.1, "XTIUSD": 0.01, "XBRUSD": 0.01, "XAGUSD": 0.01,
}


def pip_size(symbol: Column, default: float = 1e-4) -> Column:
    """A symbol's pip: listed, a hundredth for pairs quoted in yen, a ten-thousandth for other pairs of six letters, else the default."""
    listed = F.create_map(*(F.lit(x) for pair in PIPS.items() for x in pair))
    return F.coalesce(F.try_element_at(listed, symbol), F.when(symbol.rlike("^[A-Z]{3}JPY$"), 0.01).when(symbol.rlike("^[A-Z]{6}$"), 1e-4).otherwise(default))


def spread_cost(sp: Column, price: Column, pip: Column) -> Column:
    """A spread as a price: below 50 pips it is one already, otherwise it is points, ten to a pip; never below 0."""
    return F.greatest(F.when(sp < 50 * pip, sp).otherwise(sp * pip / 10), F.lit(0.0))


def liquidity_stress(sp: Column, price: Column, tk: Column) -> Column:
    return F.try_divide(sp, price) + 1 / F.sqrt(tk + 1)


def kelly_fraction(p: Column, payoff: Column, scale: float = 0.5, cap: float = 0.1) -> Column:
    """(b p - q) / b, scaled and clipped to [0, cap]."""
    return clip((payoff * p - (1 - p)) / payoff * scale, 0.0, cap)


def position_size(balance: Column, risk: float, stop_pips: Column, pip_value: Column, low: float = 0.01, high: float = 10.0) -> Column:
    return clip(F.try_divide(balance * risk, stop_pips * pip_value), low, high)


# Where each of seven indicators votes up, and where down.
VOTES = {"rsi": (55.0, 45.0), "macd": (0.0, 0.0), "pct_b": (0.6, 0.4), "stoch_k": (60.0, 40.0), "cci": (50.0, -50.0), "will_r": (-40.0, -60.0), "mom5": (0.3, -0.3)}


def indicator_votes(d: dict[str, Column]) -> Column:
    """Indicators above their upper mark less those below their lower one, -7 to 7; a null indicator has no vote."""
    votes = F.lit(0)
    for name, (up, down) in VOTES.items():
        votes = votes + F.when(d[name] > up, 1).when(d[name] < down, -1).otherwise(0)
    return votes


def vote_direction(votes: Column) -> Column:
    """1 from 3 votes on, -1 from -3, else 0."""
    return F.when(votes >= 3, 1).when(votes <= -3, -1).otherwise(0)


def confidence_proxy(votes: Column, residual: Column, streak: Column) -> Column:
    """0.4 of the votes' share of 7, 0.35 of the residual over 5e-4, 0.25 of a bonus (streak / 5, at most .3, from 3 on); within [0, 1]."""
    bonus = F.when(streak >= 3, F.least(streak / 5.0, F.lit(0.3))).otherwise(0.0)
    return clip(0.4 * F.least(F.abs(votes) / 7.0, F.lit(1.0)) + 0.35 * F.least(F.abs(residual) / 5e-4, F.lit(1.0)) + 0.25 * bonus, 0.0, 1.0)


# What a regime leaves of a signal and of a position; codes 0 LOW_VOL, 1 NORMAL, 2 TRANSITIONAL, 3 HIGH_STRESS, 4 FRAGMENTED.
SIGNAL_SCALE = {"LOW_VOL": 1.0, "NORMAL": 1.0, "TRANSITIONAL": 0.7, "HIGH_STRESS": 0.5, "FRAGMENTED": 0.3}
POSITION_SCALE = ((4.0, 0.35), (3.0, 0.55), (2.0, 0.75))


def regime_scale(regime: Column) -> Column:
    """Multiplier of a signal by the regime's name; 1 for others."""
    out = F.lit(1.0)
    for name, x in SIGNAL_SCALE.items():
        out = F.when(regime == name, x).otherwise(out)
    return out


def regime_scale_of_code(code: Column) -> Column:
    """Multiplier of a position by the regime's code; 1 below 2."""
    out = F.lit(1.0)
    for least, x in reversed(POSITION_SCALE):
        out = F.when(code >= least, x).otherwise(out)
    return out
