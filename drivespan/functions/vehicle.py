"""Scalar vehicle formulas as column expressions. Null in, null out."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

G = 9.80665

#: Mean radius of the earth in metres.
EARTH_M = 6371008.8


def bicycle_yaw_rate(v: Column, steer_deg: Column, wheelbase: float, ratio: float, understeer: float, offset_deg: float = 0.0, v_min: float = 3.0) -> Column:
    """Steady single-track yaw rate in deg/s: v * delta / (ratio * (L + K v^2)); null below v_min."""
    delta = F.radians(steer_deg - offset_deg)
    return F.when(v >= v_min, F.degrees(v * delta / (ratio * (wheelbase + understeer * v * v))))


def sideslip_model(v: Column, yaw_dps: Column, ay: Column, l_r: float, k: float, v_min: float = 5.0) -> Column:
    """Model sideslip in degrees: l_r r / v - k a_y; null below v_min."""
    return F.when((v >= v_min) & (v > 0), F.degrees(l_r * F.radians(yaw_dps) / v - k * ay))


def sideslip_expected(v: Column, yaw_expected_dps: Column, l_r: float, k: float, v_min: float = 5.0) -> Column:
    """Sideslip that the steering explains: r_exp * (l_r / v - k v), in degrees."""
    return F.when((v >= v_min) & (v > 0), F.degrees(F.radians(yaw_expected_dps) * (l_r / v - k * v)))


def sideslip_noise(v: Column, yaw_noise_dps: float, ay_noise: float, l_r: float, k: float) -> Column:
    """Standard deviation of the model sideslip from sensor noise, in degrees."""
    return F.when(v > 0, F.degrees(F.hypot(l_r * F.radians(F.lit(yaw_noise_dps)) / v, F.lit(k * ay_noise))))


def counter_steer(yaw_dps: Column, steer_rate_dps: Column, least_yaw: float, least_rate: float) -> Column:
    """1.0 where yaw and steering rate are both large and of opposite sign, else 0.0."""
    hit = (F.abs(yaw_dps) >= least_yaw) & (F.abs(steer_rate_dps) >= least_rate) & (F.signum(yaw_dps) != F.signum(steer_rate_dps))
    return F.coalesce(hit, F.lit(False)).cast("double")


def path_offset(distance: Column, v: Column, yaw_dps: Column, v_min: float) -> Column:
    """Lateral offset of the car's arc at a distance ahead; 0 where speed is low or unknown."""
    return F.coalesce(F.when(v >= v_min, 0.5 * F.radians(yaw_dps) / v * distance * distance), F.lit(0.0))


def time_headway(distance: Column, v: Column, v_min: float) -> Column:
    return F.when(v >= v_min, distance / v)


def time_to_collision(distance: Column, v_rel: Column, least_closing: float) -> Column:
    """distance / closing speed where the gap closes at least that fast; v_rel is negative when closing."""
    return F.when(v_rel <= -least_closing, distance / -v_rel)


def friction_demand(ax: Column, ay: Column) -> Column:
    return F.hypot(ax, ay) / G


def left_wind(speed: Column, direction_deg: Column, heading_deg: Column) -> Column:
    """Wind from the left: -W sin(D - H), D being where it comes from."""
    return -speed * F.sin(F.radians(direction_deg - heading_deg))


def head_wind(speed: Column, direction_deg: Column, heading_deg: Column) -> Column:
    return speed * F.cos(F.radians(direction_deg - heading_deg))


def wrap_degrees(x: Column) -> Column:
    """x in (-180, 180]."""
    return -(F.pmod(F.lit(180.0) - x, F.lit(360.0)) - 180.0)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def unit_scale(value: Column, unit_in: str, unit_out: str) -> Column:
    """value in another unit; an unknown pair is an error when the plan is made."""
    known = {("km/h", "m/s"): 1 / 3.6, ("m/s", "km/h"): 3.6, ("deg", "rad"): 0.017453292519943295, ("rad", "deg"): 57.29577951308232, ("g", "m/s2"): G, ("kph", "m/s"): 1 / 3.6, ("mph", "m/s"): 0.44704, ("MPa", "bar"): 10.0}
    if unit_in == unit_out:
        return value
    if (unit_in, unit_out) not in known:
        raise ValueError(f"no conversion from {unit_in} to {unit_out}")
    return value * known[unit_in, unit_out]


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval for k of n; null for no trials."""
    p = k / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (mid - half) / (1 + z * z / n)), F.when(n > 0, (mid + half) / (1 + z * z / n))


def cohen_kappa(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Cohen's kappa of a 2 x 2 table: both yes, first only, second only, both no."""
    n = a + b + c + d
    po, pe = (a + d) / n, ((a + b) * (a + c) + (c + d) * (b + d)) / (n * n)
    return F.when(pe < 1, (po - pe) / (1 - pe))


def log_binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """-log10 P(X >= k) for X binomial(n, p), summed term by term."""
    term = lambda i: F.exp(F.expr("0.0") + _log_choose(n, i) + i * F.log(p) + (n - i) * F.log(1 - p))
    total = F.aggregate(F.sequence(k, n), F.lit(0.0), lambda acc, i: acc + term(i))
    return F.when(k <= 0, 0.0).otherwise(-F.log10(F.greatest(F.least(total, F.lit(1.0)), F.lit(1e-300))))


def _log_factorial(n: Column) -> Column:
    """Summed up to 15, Stirling's series beyond."""
    x = F.greatest(n.cast("double"), F.lit(1.0))
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n.cast("int"), F.lit(15)), F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.log(i.cast("double")))
    return F.when(n <= 15, small).otherwise(x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x))


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided Fisher p-value of a 2 x 2 table, summed over tables no likelier than the given one."""
    r1, r2, c1 = a + b, c + d, a + c
    log_p = lambda x: _log_choose(r1, x) + _log_choose(r2, c1 - x) - _log_choose(r1 + r2, c1)
    own = log_p(a)
    low, high = F.greatest(F.lit(0), (c1 - r2).cast("int")), F.least(r1, c1).cast("int")
    return F.least(F.aggregate(F.sequence(low, high), F.lit(0.0), lambda acc, x: acc + F.when(log_p(x) <= own + 1e-7, F.exp(log_p(x))).otherwise(0.0)), F.lit(1.0))
