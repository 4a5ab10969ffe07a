"""The mechanism of one column, chosen by its semantic type or by the method a policy names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import discrete as D
from veilframe.functions import exact as E
from veilframe.functions import noise as N
from veilframe.functions import values as V
from veilframe.functions.rng import KeyedNoise, TaskNoise

# What a mechanism assumes where the policy is silent.
DEFAULT_EPSILON = {
    "age": 0.2, "year": 0.2, "numeric": 0.3, "monetary": 0.3, "count": 1.0, "boolean": 0.5, "string": 0.5,
}
DEFAULT_BOUNDS = {"age": (0.0, 120.0), "year": (1900.0, 2050.0)}
DEFAULT_SENSITIVITY = {"numeric": 1.0, "monetary": 1000.0}
TYPE_METHODS = {
    "age": "bounded_laplace",
    "year": "bounded_laplace",
    "monetary": "scaled_laplace",
    "numeric": "laplace",
    "count": "discrete_laplace",
    "boolean": "randomized_response",
}
NUMERIC_METHODS = [
    "laplace", "bounded_laplace", "discrete_laplace", "scaled_laplace", "gaussian", "bounded_gaussian", "exact_laplace", "exact_gaussian",
]
DEFAULT_DELTA = 1e-5


@dataclass(frozen=True)
class Mechanism:
    """What is done to one column: plain parameters, no data.

    `method` is one of NUMERIC_METHODS, `randomized_response`, `categorical_response`,
    `mask`, or `none` for a column that stays as it is.
    """

    column: str
    semantic_type: str
    method: str
    epsilon: float | None = None
    sensitivity: float = 1.0
    lower: float | None = None
    upper: float | None = None
    delta: float = DEFAULT_DELTA
    mask_type: str = "partial"
    salt: str | None = None
    categories: tuple[str, ...] = field(default=())
    formal: bool = False

    @property
    def streams(self) -> int:
        """Uniform draws per row."""
        if self.method in ("gaussian", "bounded_gaussian", "categorical_response"):
            return 2
        return 0 if self.method in ("mask", "none") else 1

    @property
    def exact(self) -> bool:
        """Whether its noise is a whole number of steps, drawn from keyed bits."""
        return self.method.startswith("exact_")

    @property
    def private(self) -> bool:
        """Whether it spends epsilon."""
        return self.method in NUMERIC_METHODS or self.method.endswith("_response")


def choose(
    column: str,
    semantic_type: str,
    method: str | None = None,
    epsilon: float | None = None,
    minimum: float | None = None,
    maximum: float | None = None,
    sensitivity: float | None = None,
    mask_type: str | None = None,
    num_range: float | None = None,
    non_negative: bool | None = None,
    categories: Sequence[str] = (),
    max_categories: int = 15,
    delta: float = DEFAULT_DELTA,
    salt: str | None = None,
) -> Mechanism:
    """Settle the parameters from the policy's settings and the column's profile."""
    if semantic_type == "id":
        return Mechanism(column, semantic_type, "mask", mask_type="hash", salt=salt)
    if semantic_type == "string":
        if 1 < len(categories) <= max_categories:
            eps = DEFAULT_EPSILON["string"] if epsilon is None else epsilon
            return Mechanism(column, semantic_type, "categorical_response", eps, categories=tuple(categories))
        return Mechanism(column, semantic_type, "mask", mask_type=mask_type or "partial", salt=salt)
    if semantic_type not in TYPE_METHODS:
        raise ValueError(f"column {column}: unknown semantic type {semantic_type!r}")
    method = method or TYPE_METHODS[semantic_type]
    eps = DEFAULT_EPSILON[semantic_type] if epsilon is None else epsilon
    if semantic_type == "boolean":
        if method != "randomized_response":
            raise ValueError(f"column {column}: a boolean column cannot use {method}")
        return Mechanism(column, semantic_type, method, eps, formal=True)
    if method not in NUMERIC_METHODS:
        raise ValueError(f"column {column}: a {semantic_type} column cannot use {method}")
    if method.startswith("exact_") and sensitivity is None and semantic_type in DEFAULT_SENSITIVITY:
        num_range = None  # the step of the grid may not depend on the data

    lower, upper = minimum, maximum
    bounded = method.startswith("bounded_")
    if bounded:
        default = DEFAULT_BOUNDS.get(semantic_type, (None, None))
        lower = default[0] if lower is None else lower
        upper = default[1] if upper is None else upper
        if lower is None or upper is None or upper <= lower:
            raise ValueError(f"column {column}: {method} needs min < max")
    if semantic_type in DEFAULT_SENSITIVITY:
        sens = DEFAULT_SENSITIVITY[semantic_type] if sensitivity is None else sensitivity
        # never more than the spread of the column, which is read from the data
        if num_range is not None and num_range > 0:
            sens = min(sens, num_range)
    else:
        sens = 1.0 if sensitivity is None else sensitivity
    if not bounded and lower is None:
        if semantic_type == "count" and non_negative is not False:
            lower = 0.0
        elif semantic_type in ("numeric", "monetary") and non_negative:
            lower = 0.0
    formal = None not in (sensitivity, minimum, maximum)
    return Mechanism(column, semantic_type, method, eps, sens, lower, upper, delta, formal=formal)


def draw(m: Mechanism, noise: KeyedNoise | TaskNoise, name: str, stream: int, dtype: T.DataType) -> Column:
    """One of the `m.streams` draws of a row: a uniform, or the noise itself in steps of the grid."""
    if not m.exact:
        return noise.uniform(name, stream)
    if not isinstance(noise, KeyedNoise):
        raise ValueError(f"column {m.column}: {m.method} needs keyed noise, so a secret")
    integral = isinstance(dtype, T.IntegralType)
    if m.method == "exact_laplace":
        step = E.step_of(m.sensitivity, m.epsilon, integral)
        return E.laplace_units(noise, name, m.epsilon, E.units_of(m.sensitivity, step, integral))
    return E.gaussian_units(noise.bits(name, stream)[0], E.gaussian_grid(m.sensitivity, m.epsilon, m.delta, integral)[1])


def apply(m: Mechanism, value: Column, dtype: T.DataType, draws: Sequence[Column]) -> Column:
    """The released column. `draws` are as many draws as `m.streams`."""
    if m.method == "none":
        return value
    if m.method == "mask":
        return D.mask(value, m.mask_type, m.salt)
    if m.method == "categorical_response":
        return D.categorical_response(value.cast("string"), draws[0], draws[1], m.categories, m.epsilon)
    if m.method == "randomized_response":
        return D.boolean_response(V.to_boolean(value, dtype), draws[0], m.epsilon)
    if m.method == "discrete_laplace":
        integral = isinstance(dtype, T.IntegralType)
        number = value if integral else V.to_number(value, dtype)
        return N.discrete_laplace(number, draws[0], m.sensitivity, m.epsilon, integral, m.lower, m.upper)
    number = V.to_number(value, dtype)
    if m.exact:
        integral = isinstance(dtype, T.IntegralType)
        step = E.step_of(m.sensitivity, m.epsilon, integral) if m.method == "exact_laplace" else E.gaussian_grid(m.sensitivity, m.epsilon, m.delta, integral)[0]
        noisy = E.on_grid(value if integral else number, draws[0], step, integral).cast("double")
    elif m.method.endswith("gaussian"):
        noisy = N.gaussian(number, draws[0], draws[1], m.sensitivity, m.epsilon, m.delta)
    elif m.method in NUMERIC_METHODS:
        noisy = N.laplace(number, draws[0], m.sensitivity, m.epsilon)
    else:
        raise ValueError(f"column {m.column}: unknown method {m.method!r}")
    return N.clamp(noisy, m.lower, m.upper, number)
