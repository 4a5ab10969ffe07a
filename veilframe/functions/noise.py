"""Additive noise as column expressions. NULL stays NULL in every one of them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _check(sensitivity: float, epsilon: float) -> None:
    if not epsilon > 0:
        raise ValueError(f"epsilon must be positive, got {epsilon}")
    if sensitivity < 0:
        raise ValueError(f"sensitivity must not be negative, got {sensitivity}")


def clamp(noisy: Column, lower: float | None, upper: float | None, present: Column | None = None) -> Column:
    """Limit a value. greatest/least skip NULLs, so a missing value needs a guard: `present`
    is the input of the mechanism, which is cheaper to test than its noisy output."""
    out = noisy
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    if lower is None and upper is None:
        return noisy
    return F.when((noisy if present is None else present).isNotNull(), out)


def laplace_sample(u: Column, scale: float | Column) -> Column:
    """Laplace(0, scale) by inverting the distribution function at a uniform draw."""
    centred = u - F.lit(0.5)
    b = F.lit(float(scale)) if isinstance(scale, (int, float)) else scale
    return -b * F.signum(centred) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(centred))


def laplace(value: Column, u: Column, sensitivity: float, epsilon: float) -> Column:
    _check(sensitivity, epsilon)
    return value.cast("double") + laplace_sample(u, sensitivity / epsilon)


def bounded_laplace(
    value: Column, u: Column, sensitivity: float, epsilon: float, lower: float, upper: float
) -> Column:
    return clamp(laplace(value, u, sensitivity, epsilon), lower, upper, value)


#: Doubles beyond this cannot be told from the ends of BIGINT.
_WHOLE = float(2**63 - 1024)


def whole(number: Column) -> Column:
    """A double as BIGINT, rounded to the even neighbour and limited to what BIGINT holds. NULL and NaN give NULL."""
    limited = F.greatest(F.lit(-_WHOLE), F.least(F.lit(_WHOLE), F.rint(number)))
    return F.when(number.isNotNull() & ~F.isnan(number), limited).cast("bigint")


def discrete_laplace(
    value: Column, u: Column, sensitivity: float, epsilon: float, integral: bool = False,
    lower: float | None = None, upper: float | None = None,
) -> Column:
    """A BIGINT: value plus noise, rounded to the even neighbour and limited to the whole numbers within the bounds.

    `integral` says that `value` is of a whole type. Then only the noise is rounded, so that values above 2^53 keep
    all their digits; a sum beyond BIGINT ends at its limit.
    """
    _check(sensitivity, epsilon)
    rounded = whole(laplace(value, u, sensitivity, epsilon))
    if integral:
        exact = value.cast("bigint")
        rounded = F.coalesce(F.try_add(exact, whole(laplace_sample(u, sensitivity / epsilon))), rounded)
        rounded = F.when(value.isNotNull(), rounded)
    out = rounded
    if lower is not None:
        out = F.greatest(out, F.lit(math.ceil(lower)).cast("bigint"))
    if upper is not None:
        out = F.least(out, F.lit(math.floor(upper)).cast("bigint"))
    return out if lower is None and upper is None else F.when(rounded.isNotNull(), out)


def scaled_laplace(
    value: Column, u: Column, sensitivity: float, epsilon: float, factor: float = 1.0
) -> Column:
    """The factor applies to value and noise alike."""
    noisy = laplace(value, u, sensitivity, epsilon)
    return noisy if factor == 1.0 else noisy * F.lit(float(factor))


def gaussian_sigma(sensitivity: float, epsilon: float, delta: float) -> float:
    _check(sensitivity, epsilon)
    if not 0 < delta < 1:
        raise ValueError(f"delta must lie in (0, 1), got {delta}")
    return sensitivity * math.sqrt(2.0 * math.log(1.25 / delta)) / epsilon


def gaussian_sample(u0: Column, u1: Column, sigma: float) -> Column:
    """Normal(0, sigma) from two uniforms (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(u0))
    return F.lit(float(sigma)) * radius * F.cos(F.lit(2.0 * math.pi) * u1)


def gaussian(
    value: Column, u0: Column, u1: Column, sensitivity: float, epsilon: float, delta: float
) -> Column:
    sigma = gaussian_sigma(sensitivity, epsilon, delta)
    return value.cast("double") + gaussian_sample(u0, u1, sigma)


def bounded_gaussian(
    value: Column,
    u0: Column,
    u1: Column,
    sensitivity: float,
    epsilon: float,
    delta: float,
    lower: float,
    upper: float,
) -> Column:
    return clamp(gaussian(value, u0, u1, sensitivity, epsilon, delta), lower, upper, value)
