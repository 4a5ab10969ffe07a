"""Randomised response, masking and hashing for booleans, categories and text."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIGITS = 12
FULL_MASK = "*" * 8


def keep_probability(epsilon: float, categories: int = 2) -> float:
    """Chance of reporting the true one of `categories` values."""
    if not epsilon > 0:
        raise ValueError(f"epsilon must be positive, got {epsilon}")
    weight = math.exp(epsilon)
    return weight / (weight + categories - 1)


def boolean_response(value: Column, u: Column, epsilon: float) -> Column:
    return F.when(u < F.lit(keep_probability(epsilon)), value).otherwise(~value)


def categorical_response(
    value: Column, u_keep: Column, u_pick: Column, categories: Sequence[str], epsilon: float
) -> Column:
    """Keep the value, or report one of the other categories with equal chance.

    A value outside `categories` draws from all of them.
    """
    cats = sorted(set(categories))
    if len(cats) < 2:
        return value
    others = F.array_remove(F.array(*[F.lit(c) for c in cats]), value)
    pick = F.floor(u_pick * F.size(others)).cast("int") + F.lit(1)
    kept = u_keep < F.lit(keep_probability(epsilon, len(cats)))
    return F.when(value.isNull() | kept, value).otherwise(F.element_at(others, pick))


def mask_partial(value: Column) -> Column:
    """Two characters at each end stay; short text disappears wholly."""
    size = F.char_length(value)
    inner = F.repeat(F.lit("*"), size - F.lit(4))
    return F.when(size <= 4, F.repeat(F.lit("*"), size)).otherwise(
        F.concat(F.substring(value, 1, 2), inner, F.right(value, F.lit(2)))
    )


def mask_full(value: Column) -> Column:
    return F.when(value == "", value).when(value.isNotNull(), F.lit(FULL_MASK))


def mask_hash(value: Column, salt: str | None = None) -> Column:
    """Short digest. Without a salt it can be reversed by hashing guesses; with one it is
    the full SHA-256 of salt and value."""
    if salt is None:
        digest = F.substring(F.md5(value), 1, HASH_DIGITS)
    else:
        digest = F.sha2(F.concat(F.lit(salt), value), 256)
    return F.when(value == "", value).otherwise(digest)


def mask(value: Column, kind: str, salt: str | None = None) -> Column:
    text = value.cast("string")
    if kind == "partial":
        return mask_partial(text)
    if kind == "full":
        return mask_full(text)
    if kind == "hash":
        return mask_hash(text, salt)
    raise ValueError(f"unknown mask type {kind!r}")
