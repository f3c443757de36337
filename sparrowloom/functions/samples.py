"""Column expressions of single samples: image modes, latents, draws and instructions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as V

# What is done with an image of each mode; other modes are rejected.
MODE_ACTIONS = {"RGBA": "flatten", "P": "flatten", "RGB": "keep", "L": "repeat"}


def mode_action(mode: Column, actions: Mapping[str, str] = MODE_ACTIONS) -> Column:
    """What is done with an image of this mode; null for a mode without an action."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in actions.items() for x in pair]), mode)


def large_enough(height: Column, width: Column, least_height: int, least_width: int) -> Column:
    """Whether both sides reach their least; false where one is null."""
    return F.coalesce((height >= least_height) & (width >= least_width), F.lit(False))


def dropped_condition(prompt: Column, u: Column, rate: float, empty: str = "") -> Column:
    """The prompt, or the empty one where the draw u is below rate; null stays null unless drawn."""
    return F.when(u < rate, F.lit(empty)).otherwise(prompt)


def late_instruction(index: Column, n: Column, least: Column, u: Column, before: str, after: str) -> Column:
    """The instruction `after` beyond the row `least`, with a chance that grows as index / n; `before` otherwise."""
    return F.when((index > least) & (u < index / n), F.lit(after)).otherwise(F.lit(before))


def multinomial(probabilities: Column, u: Column) -> Column:
    """The first index whose cumulative probability reaches u; the last one where rounding leaves the sum below u."""
    state = lambda cum, token: F.struct(cum.alias("cum"), token.alias("token"))
    step = lambda a, p: state(a["cum"] + p, F.when(a["cum"] + p < u, a["token"] + 1).otherwise(a["token"]))
    return F.aggregate(probabilities, state(F.lit(0.0), F.lit(0)), step, lambda a: F.least(a["token"], F.size(probabilities) - 1))


def noisy(values: Column, noise: Column, t: Column, zeroed: tuple[int, ...] = ()) -> Column:
    """noise * t + values * (1 - t) by dimension; the dimensions in zeroed (grippers) are zero."""
    blended = F.zip_with(values, noise, lambda a, z: z * t + a * (1 - t))
    return F.transform(blended, lambda x, i: F.when(i.isin(list(zeroed)), F.lit(0.0)).otherwise(x)) if zeroed else blended


def rms_modulated(values: Column, scale: float, shift: float, epsilon: float = 1e-6) -> Column:
    """values by their root mean square, times 1 + scale, plus shift."""
    rms = F.sqrt(V.dot(values, values) / F.size(values) + epsilon)
    return F.zip_with(values, F.array_repeat(rms, F.size(values)), lambda x, r: x / r * (1 + scale) + shift)


def standardised(values: Column, mean: Column, deviation: Column) -> Column:
    """(values - mean) / deviation by channel; mean and deviation are arrays of the same length."""
    return F.zip_with(F.zip_with(values, mean, lambda x, m: x - m), deviation, lambda x, s: x / s)


def initial_latents(clean: Column, noise: Column, observed: int) -> Column:
    """(latent, time) by position: the first `observed` are kept at time 1, the others start from noise at time 0."""
    joined = F.arrays_zip(clean.alias("x"), noise.alias("z"))
    pick = lambda s, i: F.struct(F.when(i < observed, s["x"]).otherwise(s["z"]).alias("latent"), F.when(i < observed, 1.0).otherwise(0.0).alias("time"))
    return F.transform(joined, pick)


def sampled_at(values: Column, at: Column) -> Column:
    """The value at a place between two elements (from 0), by straight lines; null outside."""
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(values, low), F.get(values, high)
    return a + (b - a) * (at - low)


def cyclic_state(episode: Column, states: int) -> Column:
    """The start state of an episode, in turn."""
    return F.pmod(episode, F.lit(states)).cast("int")


def last_of_halves(index: Column, n: Column) -> Column:
    """1 for the last row of either half (the first half has the odd row), else 0."""
    half = F.floor((n + 1) / 2)
    return F.when((index % half == half - 1) | (index == n - 1), 1.0).otherwise(0.0)


def chunk_of(index: Column, size: int) -> Column:
    """Row 0 is a chunk of its own, then `size` rows make one."""
    return F.when(index == 0, F.lit(0)).otherwise(1 + F.floor((index - 1) / size)).cast("bigint")


def carried(index: Column, n: Column, size: int, kept: int = 2) -> Column:
    """Whether a row is among the last `kept` of its chunk or of the series, which the next chunk is given."""
    return (index >= F.floor(index / size) * size + (size - kept)) | (index >= n - kept)
