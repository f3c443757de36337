"""Flow paths, time warps, schedules and embeddings as column expressions of time or step."""

from __future__ import annotations

import math
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

# The noise range of the variance-preserving path, and the anchors of the time shift.
BETA_MIN, BETA_MAX = 0.1, 20.0
SHIFT_ANCHORS = ((256.0, 0.5), (4096.0, 1.15))


def _linear(t: Column) -> dict[str, Column]:
    return {"alpha": t, "d_alpha": F.lit(1.0), "sigma": 1 - t, "d_sigma": F.lit(-1.0)}


def _gvp(t: Column) -> dict[str, Column]:
    angle = t * (math.pi / 2)
    return {"alpha": F.sin(angle), "d_alpha": F.cos(angle) * (math.pi / 2), "sigma": F.cos(angle), "d_sigma": F.sin(angle) * (-math.pi / 2)}


def _vp(t: Column) -> dict[str, Column]:
    left = 1 - t
    log_alpha = left * left * (-0.25 * (BETA_MAX - BETA_MIN)) - left * (0.5 * BETA_MIN)
    slope = left * (0.5 * (BETA_MAX - BETA_MIN)) + 0.5 * BETA_MIN
    alpha = F.exp(log_alpha)
    square = F.exp(2 * log_alpha)
    sigma = F.sqrt(1 - square)
    return {"alpha": alpha, "d_alpha": alpha * slope, "sigma": sigma, "d_sigma": square * (2 * slope) / (-2 * sigma)}


#: Paths by name; others can be added.
PATHS: dict[str, Callable[[Column], dict[str, Column]]] = {"linear": _linear, "gvp": _gvp, "vp": _vp}


def coefficients(path: str, t: Column) -> dict[str, Column]:
    """alpha, its derivative, sigma and its derivative at time t."""
    return PATHS[path](t)


def plan(path: str, t: Column, x0: Column, x1: Column) -> tuple[Column, Column]:
    """(x_t, u_t): the point of the path from noise x0 to data x1, and its velocity."""
    c = coefficients(path, t)
    mix = lambda a, b: F.zip_with(x1, x0, lambda one, zero: a * one + b * zero)
    return mix(c["alpha"], c["sigma"]), mix(c["d_alpha"], c["d_sigma"])


def score_from_velocity(path: str, v: Column, x: Column, t: Column) -> Column:
    c = coefficients(path, t)
    ratio = c["alpha"] / c["d_alpha"]
    return (ratio * v - x) / (c["sigma"] * c["sigma"] - ratio * c["d_sigma"] * c["sigma"])


def velocity_from_score(path: str, s: Column, x: Column, t: Column) -> Column:
    c = coefficients(path, t)
    ratio = c["d_alpha"] / c["alpha"]
    var = c["sigma"] * c["sigma"] * ratio - c["d_sigma"] * c["sigma"]
    return var * s + ratio * x


def noise_from_velocity(path: str, v: Column, x: Column, t: Column) -> Column:
    c = coefficients(path, t)
    ratio = c["alpha"] / c["d_alpha"]
    return (ratio * v - x) / (ratio * c["d_sigma"] - c["sigma"])


def drift(path: str, x: Column, t: Column) -> tuple[Column, Column]:
    """(drift, variance) of the path's diffusion at x and t; velocity = variance * score - drift."""
    c = coefficients(path, t)
    ratio = c["d_alpha"] / c["alpha"]
    return -ratio * x, ratio * c["sigma"] * c["sigma"] - c["sigma"] * c["d_sigma"]


#: Forms of the diffusion by name, from (path, t, size); others can be added.
DIFFUSIONS: dict[str, Callable[[str, Column, float], Column]] = {
    "constant": lambda path, t, size: F.lit(size),
    "SBDM": lambda path, t, size: drift(path, F.lit(0.0), t)[1] * size,
    "sigma": lambda path, t, size: coefficients(path, t)["sigma"] * size,
    "linear": lambda path, t, size: (1 - t) * size,
    "decreasing": lambda path, t, size: F.pow(F.cos(t * math.pi) * size + 1, F.lit(2.0)) * 0.25,
    "increasing-decreasing": lambda path, t, size: F.pow(F.sin(t * math.pi), F.lit(2.0)) * size,
}


def diffusion(form: str, path: str, t: Column, size: float = 1.0) -> Column:
    return DIFFUSIONS[form](path, t, size)


def interval(path: str, predicts: str, train_eps: float, sample_eps: float, form: str = "SBDM", stochastic: bool = False, reverse: bool = False, sampling: bool = False, last_step: float = 0.0) -> tuple[float, float]:
    """The times between which a path is trained or sampled, away from ends that its model cannot bear."""
    eps = sample_eps if sampling else train_eps
    begin, end = 0.0, 1.0
    cut = 1 - eps if not stochastic or last_step == 0 else 1 - last_step
    if path == "vp":
        end = cut
    elif path in ("linear", "gvp") and (predicts != "velocity" or stochastic):
        begin = eps if form == "SBDM" and stochastic or predicts != "velocity" else 0.0
        end = cut
    return (1 - begin, 1 - end) if reverse else (begin, end)


def time_shift(t: Column, length: float) -> Column:
    """t warped for a sequence of that length; the ends 0 and 1 stay."""
    (x1, y1), (x2, y2) = SHIFT_ANCHORS
    mu = math.exp(y1 + (length - x1) * (y2 - y1) / (x2 - x1))
    left = 1 - t
    return F.when(left <= 0, F.lit(1.0)).otherwise(1 - mu / (mu + (1 / left - 1)))


def grid_warp(t: Column, factor: float) -> Column:
    return t / (t + factor - factor * t)


def logistic_normal(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def stratified_time(u: Column, index: Column, batch: int) -> Column:
    return F.pmod(u + index / F.lit(float(batch)), F.lit(1 - 1e-5))


def sinusoid(t: Column, dims: int, period: float) -> Column:
    """cos of all frequencies, then sin; an odd size ends with a zero."""
    half = dims // 2
    angle = lambda k: t * F.exp(k * (-math.log(period) / half))
    waves = F.concat(F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda k: F.cos(angle(k))), F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda k: F.sin(angle(k))))
    return F.concat(waves, F.array(F.lit(0.0))) if dims % 2 else waves


def guided(conditional: Column, unconditional: Column, scale: float) -> Column:
    return F.zip_with(conditional, unconditional, lambda c, u: u + scale * (c - u))


def euler(x0: Column, steps: int, drift) -> Column:
    """x after `steps` equal Euler steps from time 0 to 1 of dx = drift(x, t) dt."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), x0, lambda x, k: x + drift(x, k / F.lit(float(steps))) / F.lit(float(steps)))


def euler_maruyama(x0: Column, noise: Column, steps: int, drift_of, diffusion_of, end: float = 1.0) -> Column:
    """x at time end after equal steps of dx = drift dt + sqrt(2 diffusion dt) noise, the noise of each step given in an array."""
    dt = end / steps

    def step(x: Column, k: Column) -> Column:
        t = k * F.lit(dt)
        return x + drift_of(x, t) * F.lit(dt) + F.sqrt(2 * diffusion_of(t)) * F.get(noise, k) * F.lit(math.sqrt(dt))

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), x0, step)


def heun(x0: Column, noise: Column, steps: int, drift_of, diffusion_of, end: float = 1.0) -> Column:
    """As euler_maruyama, the noise first and then the mean of the drifts at both ends of a step."""
    dt = end / steps

    def step(x: Column, k: Column) -> Column:
        t = k * F.lit(dt)
        moved = x + F.sqrt(2 * diffusion_of(t)) * F.get(noise, k) * F.lit(math.sqrt(dt))
        first = drift_of(moved, t)
        return moved + (first + drift_of(moved + first * F.lit(dt), t + F.lit(dt))) * F.lit(0.5 * dt)

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), x0, step)


def reparameterized(mean: Column, log_variance: Column, noise: Column) -> Column:
    """mean + deviation * noise, the log-variance held between -30 and 20."""
    return mean + F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(20.0), log_variance)) * 0.5) * noise


def gate_weights(method: str, u: Column, mean_u: Column, z: Column) -> Column:
    """An initial weight from a uniform draw u, the mean of all such draws, and a normal draw z."""
    rules = {"rand": u, "rand_mean0": u - mean_u, "normal_002": z * 0.02, "normal_028": z * 0.2886751345948129, "rand_002": (u - mean_u) * 0.02 * math.sqrt(12)}
    return rules[method]


def _constant(step, r):
    return F.lit(1.0)


def _constant_with_warmup(step, r):
    return F.when(step < r.warmup, r.raised).otherwise(F.lit(1.0))


def _linear_decay(step, r):
    return F.when(step < r.warmup, r.ramp).otherwise(F.greatest(F.lit(0.0), 1 - r.progress))


def _cosine(step, r):
    return F.when(step < r.warmup, r.raised).otherwise(F.greatest(F.lit(r.floor), (F.cos(r.progress * (math.pi * 2 * r.cycles)) + 1) * 0.5))


def _cosine_with_restarts(step, r):
    wave = (F.cos(F.pmod(r.progress * r.cycles, F.lit(1.0)) * math.pi) + 1) * 0.5
    return F.when(step < r.warmup, r.ramp).when(r.progress >= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), wave))


def _polynomial(step, r):
    decayed = (F.pow(1 - r.progress, F.lit(r.power)) * (r.start - r.end) + r.end) / r.start
    return F.when(step < r.warmup, r.ramp).when(step > r.total, F.lit(r.end / r.start)).otherwise(decayed)


#: Schedules by name, from a step and the rates' settings; others can be added.
SCHEDULES: dict[str, Callable] = {"constant": _constant, "constant_with_warmup": _constant_with_warmup, "linear": _linear_decay, "cosine": _cosine, "cosine_with_restarts": _cosine_with_restarts, "polynomial": _polynomial}


def learning_rate(kind: str, step: Column, warmup: int, total: int, floor: float = 0.1, cycles: float = 0.5, power: float = 1.0, end: float = 1e-7, start: float = 1e-3) -> Column:
    """The factor of the base rate at a step."""
    ramp = step / F.lit(float(max(1, warmup)))
    settings = SimpleNamespace(warmup=warmup, total=total, floor=floor, cycles=cycles, power=power, end=end, start=start, ramp=ramp, raised=floor + ramp * (1.0 - floor), progress=(step - warmup) / F.lit(float(max(1, total - warmup))))
    return SCHEDULES[kind](step, settings)
