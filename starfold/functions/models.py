"""Transit shapes as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from starfold.functions.scalars import CADENCE_DAYS, TANH_SHARPNESS, _c

# Fixed value: solar non-linear limb-darkening coefficients.
SOLAR_LIMB = (0.77, -0.67, 1.14, -0.41)


def box(t, P, epoch, depth, tdur, cadence=CADENCE_DAYS) -> Column:
    """Dip of ``depth`` with sides one cadence wide; 0 outside."""
    t, P, epoch, depth, tdur, lc = (_c(v) for v in (t, P, epoch, depth, tdur, cadence))
    away = F.abs(F.pmod(t, P) - F.pmod(epoch, P))
    inner, outer = (tdur - lc) * 0.5, (tdur + lc) * 0.5
    side = -depth * (F.lit(1.0) - (away - inner) / lc)
    return F.when(away < inner, -depth).when((away > inner) & (away < outer), side).otherwise(0.0)


def trapezoid(t, depth, flat, wing) -> Column:
    """Flat bottom of width ``flat`` and sloping sides of width ``wing``, centred on 0."""
    t, depth, flat, wing = (_c(v) for v in (t, depth, flat, wing))
    a = F.abs(t)
    slope = depth / wing * (a - flat / 2) - depth
    return F.when((a > flat / 2) & (a < flat / 2 + wing), slope).when(a < flat / 2, -depth).otherwise(0.0)


def tanh_box(t, P, epoch, depth, tdur, sharp=TANH_SHARPNESS) -> Column:
    """Smooth-edged periodic box."""
    t, P, epoch, depth, tdur = (_c(v) for v in (t, P, epoch, depth, tdur))
    u = P * F.sin((t - epoch) * math.pi / P) / (tdur * math.pi)
    return depth * ((F.lit(2.0) - F.tanh((u + 0.5) * sharp) + F.tanh((u - 0.5) * sharp)) * 0.5 - 1.0)


def tanh_single(t, epoch, depth, tdur, sharp=TANH_SHARPNESS) -> Column:
    """One smooth-edged box; the period is held at 100 days."""
    return tanh_box(t, 100.0, epoch, depth, tdur, sharp)


def legendre(t, tmin, tmax, coefs: Sequence) -> Column:
    """Legendre series on [tmin, tmax]."""
    x = (_c(t) - _c(tmin)) / (_c(tmax) - _c(tmin)) * 2 - 1
    p0, p1 = F.lit(1.0), x
    out = _c(coefs[0])
    for n, c in enumerate(coefs[1:], 1):
        out = out + p1 * _c(c)
        p0, p1 = p1, (x * p1 * (2 * n + 1) - p0 * n) / (n + 1)
    return out


def occult_small(z, p, climb=SOLAR_LIMB) -> Column:
    """Relative flux of a star with a small dark disc of radius ``p`` at distance ``z``, with four
    non-linear limb-darkening coefficients."""
    z, p = _c(z), _c(p)
    c1, c2, c3, c4 = (_c(v) for v in climb)
    one = F.lit(1.0)
    norm = (one - c1 / 5 - c2 / 3 - c3 * 3 / 7 - c4 / 2) * math.pi
    # Guarded inputs: NULL outside the branch that uses them.
    on_edge = (z > one - p) & (z < one + p)
    ze = F.when(on_edge, z)
    x = one - (ze - p) * (ze - p)
    xs = F.greatest(x, F.lit(0.0))
    dark = (
        one - c1 * (one - F.sqrt(F.sqrt(xs)) * 4 / 5) - c2 * (one - F.sqrt(xs) * 2 / 3)
        - c3 * (one - F.pow(xs, F.lit(0.75)) * 4 / 7) - c4 * (one - x * 4 / 8)
    )
    d = ze - 1
    edge = one - dark * (p * p * F.acos(F.greatest(F.least(d / p, one), -one)) - d * F.sqrt(F.greatest(p * p - d * d, F.lit(0.0)))) / norm
    zi = F.when((z < one - p) & (z != 0), z)
    s1 = F.sqrt(F.sqrt(F.greatest(one - (zi - p) * (zi - p), F.lit(0.0))))
    s2 = F.sqrt(F.sqrt(F.greatest(one - (zi + p) * (zi + p), F.lit(0.0))))
    s15, s25 = F.pow(s1, F.lit(5.0)), F.pow(s2, F.lit(5.0))
    s16, s26 = F.pow(s1, F.lit(6.0)), F.pow(s2, F.lit(6.0))
    shade = (
        one - c1 * (one + F.try_divide((s25 - s15) / 5, p * zi)) - c2 * (one + F.try_divide((s26 - s16) / 6, p * zi))
        - c3 * (one + F.try_divide(F.pow(s2, F.lit(7.0)) - F.pow(s1, F.lit(7.0)), p * zi * 7)) - c4 * (p * p + zi * zi)
    )
    inside = one - p * p * shade * math.pi / norm
    centre = one - p * p * math.pi / norm
    return F.when(z == 0, centre).when(on_edge, edge).when(z < one - p, inside).otherwise(1.0)


def bind(values: dict[str, Column], body) -> Column:
    """``body`` over named values that are evaluated once, however often it mentions them."""
    one = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(one, lambda s: body({k: s[k] for k in values})), F.lit(0))


def _along(d: Column, tau: Column) -> Column:
    """``d / tau``; at ``tau`` 0, which a fit's trials may reach, the limit of a crossing that takes no
    time: mid-transit stays where it is, every other moment is out of transit."""
    return F.when(tau == 0, F.when(d == 0, F.lit(0.0)).when(d != 0, F.lit(math.inf))).otherwise(d / tau)


def transit(t, p, tau, b, climb=SOLAR_LIMB, usamp: int = 11, cadence=CADENCE_DAYS) -> Column:
    """``occult_small`` along a straight crossing with time scale ``tau`` and impact ``b``, averaged
    over ``usamp`` moments of the exposure; 0 out of transit."""
    lc = _c(cadence)
    offsets = [0.0] if usamp < 2 else [j / (usamp - 1) - 0.5 for j in range(usamp)]
    given = {"t": _c(t), "p": _c(p), "tau": _c(tau), "b": _c(b)} | {f"c{i}": _c(c) for i, c in enumerate(climb)}

    def body(v):
        limb = tuple(v[f"c{i}"] for i in range(4))
        dist = F.transform(
            F.array(*[_along(v["t"] + lc * o, v["tau"]) for o in offsets]), lambda u: F.sqrt(u * u + v["b"] * v["b"])
        )
        total = F.aggregate(dist, F.lit(0.0), lambda s, z: s + occult_small(z, v["p"], limb))
        return total / len(offsets) - 1.0

    return bind(given, body)


def scaled_axis(P, t14, rp, b, b_squared: bool = False) -> Column:
    """Semi-major axis in stellar radii. The impact parameter enters as it is; ``b_squared`` gives the
    geometric form."""
    P, t14, rp, b = (_c(v) for v in (P, t14, rp, b))
    return P / math.pi / t14 * F.sqrt((rp + 1) * (rp + 1) - (b * b if b_squared else b))


def inclination(P, t14, rp, b, b_squared: bool = False) -> Column:
    return F.degrees(F.acos(_c(b) / scaled_axis(P, t14, rp, b, b_squared)))


def crossing_time(t14, rp, b) -> Column:
    """``tau`` of a transit of duration ``t14`` under ``scaled_axis``."""
    rp = _c(rp)
    return _c(t14) / 2 / F.sqrt((rp + 1) * (rp + 1) - _c(b))


def fold_time(t, P, t0) -> Column:
    """Time from the nearest mid-transit."""
    t, P, t0 = _c(t), _c(P), _c(t0)
    return F.pmod(t - t0 + P / 2, P) - P / 2


def model_duration(p, tau, b, P, phase, climb=SOLAR_LIMB, usamp: int = 11) -> Column:
    """Time from first to last moment below 0 on 200 even times over [-2, 2]."""
    P, phase = _c(P), _c(phase)
    ts = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda j: F.lit(-2.0) + j * (4.0 / 199))
    shift = -phase * P - F.ceil((F.lit(-2.0) - phase * P) / P) * P
    dark = F.filter(ts, lambda t: transit(F.pmod(t + shift + P / 2, P) - P / 2, p, tau, b, climb, usamp) < 0)
    return F.array_max(dark) - F.array_min(dark)
