"""Scalar column functions: orbital relations, counts, units and identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (cgs, days); they must equal the published ones for right results.
CADENCE_DAYS = 58.8488 / 60.0 / 60.0 / 24.0 * 30
G = 6.672e-8
RSUN = 6.955e10
REARTH = 6.378e8
MSUN = 1.989e33
AU = 1.496e13
SEC_IN_DAY = 86400.0
STEFAN_BOLTZMANN = 5.6704e-5
TANH_SHARPNESS = 100.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def semi_major_axis(P, mstar=1.0) -> Column:
    """Kepler's third law: period in days to axis in AU."""
    P, mstar = _c(P), _c(mstar)
    seconds = P * SEC_IN_DAY
    return F.pow(mstar * (G * MSUN / (4 * math.pi**2)) * seconds * seconds, F.lit(1.0 / 3.0)) / AU


def transit_duration(a, rstar=1.0, mstar=1.0) -> Column:
    """Central-transit duration in days for axis ``a`` in AU."""
    cm = _c(a) * AU
    days = F.sqrt(cm * cm * cm * (4 * math.pi**2 / (G * MSUN)) / _c(mstar)) / SEC_IN_DAY
    return _c(rstar) * RSUN * days / math.pi / cm


def duration_of_period(P, rstar=1.0, mstar=1.0) -> Column:
    return transit_duration(semi_major_axis(P, mstar), rstar, mstar)


def incident_flux(rstar, teff, a) -> Column:
    r, d, t = _c(rstar) * RSUN, _c(a) * AU, _c(teff)
    return r * r * STEFAN_BOLTZMANN * t * t * t * t / (d * d)


def points_in_transit(P, tdur, tbase, cad) -> Column:
    return _c(tbase) / _c(P) * (_c(tdur) / _c(cad))


def number_of_transits(tbase, P, phase) -> Column:
    """floor(tbase/P), one more where the phase fits in the remainder."""
    tbase, P = _c(tbase), _c(P)
    return F.floor(tbase / P) + (_c(phase) < F.pmod(tbase, P) / P).cast("long")


def season(quarter) -> Column:
    return F.pmod(_c(quarter) + 1, F.lit(4))


def to_ppm(x) -> Column:
    return _c(x) * 1e6


def to_percent(x) -> Column:
    return _c(x) * 100.0


def to_hours(days) -> Column:
    return _c(days) * 24.0


def id_from_name(name, width: int = 9) -> Column:
    """First run of digits in a file name, zero-padded."""
    return F.lpad(F.regexp_extract(_c(name), r"(\d+)", 1), width, "0")
