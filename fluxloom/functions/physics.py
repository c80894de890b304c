"""Column expressions: respiration, light response, day and night."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the respiration model (degrees Celsius).
T_REF, T_ZERO = 10.0, -46.02
NIGHT_RADIATION = 10.0


def temperature_term(t: Column, t_ref: float = T_REF, t_zero: float = T_ZERO) -> Column:
    """1 / (Tref - T0) - 1 / (T - T0)."""
    return F.lit(1.0 / (t_ref - t_zero)) - F.lit(1.0) / (t - F.lit(t_zero))


def lloyd_taylor(t: Column, rref: Column, e0: Column, t_ref: float = T_REF, t_zero: float = T_ZERO) -> Column:
    return rref * F.exp(e0 * temperature_term(t, t_ref, t_zero))


def light_response(rg: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Rectangular hyperbola plus respiration."""
    return alpha * beta * rg / (alpha * rg + beta) + gamma


def vpd_limited_beta(vpd: Column, beta0: Column, k: Column, vpd0: float = 10.0) -> Column:
    """Exponential limit above ``vpd0``; beta0 else, also where vpd is null."""
    return F.when(vpd > vpd0, beta0 * F.exp(-k * (vpd - vpd0))).otherwise(beta0)


def is_night(rg: Column) -> Column:
    return rg < NIGHT_RADIATION


def is_day(rg: Column) -> Column:
    return rg >= NIGHT_RADIATION


def sign_split(c: Column) -> tuple[Column, Column]:
    """Source (not below zero) and sink (not above zero) parts of a flux."""
    return F.when(c >= 0, c), F.when(c <= 0, c)
