"""Noise on a grid, drawn by comparing whole numbers only.

Noise computed in floating point reaches only some doubles, and which ones depends on the value it is added to; that can give
the value away. Here a value is first rounded to a grid of step 2^n, the noise is a whole number of steps, and both are
added as BIGINT; the product with the step is exact. So every value reaches the same results. No logarithm or exponential is taken of a draw:
draws are keyed bits, compared with thresholds that the driver computes with 60 digits.

Laplace: the binary digits of a geometric number are independent, digit j being 1 with probability 1 / (1 + e^(a 2^j)); the
difference of two geometric numbers is the discrete Laplace distribution, P(k) ~ e^(-a |k|).
Gaussian: P(k) ~ e^(-k² / 2σ²), by search of a draw in the table of cumulated probabilities; the step is chosen so that σ
is 32 to 64 steps, so the table has some thousand entries at any σ.

Each comparison is off by less than 2^-60 in probability. Rounding to the grid can move two neighbouring values one step further
apart, so the noise is scaled for one step more, unless the values are whole and the step is 1.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.noise import gaussian_sigma, whole
from veilframe.functions.rng import KeyedNoise

#: Bits of a draw.
BITS = 60
#: Steps in the scale of Laplace noise, at least; σ of Gaussian noise has half as many steps as SIGMA_STEPS at least, and at most so many.
SCALE_STEPS, SIGMA_STEPS = 1024, 64
#: Noise beyond so many σ is less likely than one in 2^60.
FAR = 9.2


def step_of(sensitivity: float, epsilon: float, integral: bool) -> float:
    """The step of the grid for Laplace noise: a power of two, 1 for whole values."""
    if not epsilon > 0 or not sensitivity > 0:
        raise ValueError(f"epsilon and sensitivity must be positive, got {epsilon} and {sensitivity}")
    return 1.0 if integral else 2.0 ** math.floor(math.log2(sensitivity / epsilon / SCALE_STEPS))


def units_of(sensitivity: float, step: float, integral: bool) -> int:
    """How many steps two neighbouring values are apart at most."""
    return math.ceil(sensitivity / step) + (not (integral and step == 1.0))


@lru_cache(64)
def digit_thresholds(epsilon: float, units: int) -> tuple[int, ...]:
    """Per binary digit of a geometric number with P(k) ~ e^(-k ε / units): a draw below it makes the digit 1."""
    with localcontext() as c:
        c.prec = 60
        a, out = Decimal(epsilon) / units, []
        while not out or out[-1]:
            out.append(int(Decimal(2) ** BITS / (1 + (a * 2 ** len(out)).exp())))
        return tuple(out[:-1])


def laplace_units(noise: KeyedNoise, column: str, epsilon: float, units: int) -> Column:
    """Discrete Laplace noise in steps, a BIGINT."""
    total = F.lit(0).cast("bigint")
    for j, t in enumerate(digit_thresholds(epsilon, units)):
        up, down = noise.bits(column, j)
        total = total + ((up < F.lit(t)).cast("bigint") - (down < F.lit(t)).cast("bigint")) * F.lit(1 << j)
    return total


def gaussian_grid(sensitivity: float, epsilon: float, delta: float, integral: bool) -> tuple[float, float]:
    """Step and σ in steps, for values of the given sensitivity."""
    sigma = gaussian_sigma(sensitivity, epsilon, delta)
    if not sigma > 0:
        raise ValueError(f"sensitivity must be positive, got {sensitivity}")
    step = 2.0 ** math.ceil(math.log2(sigma / SIGMA_STEPS))
    if integral and step < 1:
        step = 1.0
    return step, gaussian_sigma(float(units_of(sensitivity, step, integral)), epsilon, delta)


@lru_cache(64)
def gaussian_thresholds(sigma: float) -> tuple[int, ...]:
    """A draw stands for the k-th noise from below if so many thresholds are not above it; the middle is no noise."""
    far = math.ceil(FAR * sigma)
    with localcontext() as c:
        c.prec = 60
        twice = 2 * Decimal(sigma) ** 2
        half = [(-Decimal(k * k) / twice).exp() for k in range(far + 1)]
        weights = [*half[:0:-1], *half]
        total, upto, out = sum(weights), Decimal(0), []
        for w in weights[:-1]:
            upto += w
            out.append(int(Decimal(2) ** BITS * upto / total))
    return tuple(out)


def gaussian_units(draw: Column, sigma: float) -> Column:
    """Discrete Gaussian noise in steps, a BIGINT, by binary search of a draw of BITS bits."""
    table = gaussian_thresholds(sigma)
    size = 1 << len(table).bit_length()
    padded = F.array(*[F.lit(t).cast("bigint") for t in [*table, *[1 << BITS] * (size - len(table))]])
    jumps = F.array(*[F.lit(size >> k) for k in range(1, size.bit_length())])
    found = F.aggregate(jumps, F.lit(0), lambda at, jump: at + F.when(F.get(padded, at + jump - 1) <= draw, jump).otherwise(0))
    return F.when(draw.isNotNull(), (found - len(table) // 2).cast("bigint"))


def on_grid(value: Column, units: Column, step: float, integral: bool = False) -> Column:
    """The value rounded to the grid plus noise in steps: a BIGINT for whole values and step 1, else a DOUBLE. NULL and NaN give NULL."""
    if integral and step == 1.0:
        return F.try_add(value.cast("bigint"), units)
    cells = whole(value.cast("double") / F.lit(step))
    return F.try_add(cells, units).cast("double") * F.lit(step)


def laplace(value: Column, noise: KeyedNoise, column: str, sensitivity: float, epsilon: float, integral: bool = False) -> Column:
    step = step_of(sensitivity, epsilon, integral)
    return on_grid(value, laplace_units(noise, column, epsilon, units_of(sensitivity, step, integral)), step, integral)


def gaussian(value: Column, noise: KeyedNoise, column: str, sensitivity: float, epsilon: float, delta: float, integral: bool = False) -> Column:
    step, sigma = gaussian_grid(sensitivity, epsilon, delta, integral)
    return on_grid(value, gaussian_units(noise.bits(column, 0)[0], sigma), step, integral)
