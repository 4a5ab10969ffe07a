"""Uniform draws for the noise mechanisms.

`KeyedNoise` derives every draw from a secret, the column name, a stream number and
the row key. The draw is a pure function of the row, so it does not change with the
number of partitions, a task retry or a recomputed stage, and an audit that recomputes
the noisy column sees the values that were released.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits are 52 bits: k + 0.5 is then exact in a double, and u is never 0, 1/2 or 1.
_HEX_DIGITS = 13
_CELLS = float(2**52)


def row_key(columns: Sequence[str]) -> Column:
    """One string per row. Each of several fields is led by its length, so that no two rows of different fields share a key."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat_ws("|", *[F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def hashed_row_key(columns: Sequence[str]) -> Column:
    """Digest of several columns, for tables whose only key is the whole row."""
    return F.md5(row_key(columns))


class KeyedNoise:
    """Repeatable draws. The secret must stay private: with it the noise can be subtracted."""

    def __init__(self, secret: str, key: Column | str, digest: str = "md5"):
        if not secret:
            raise ValueError("secret must not be empty")
        if digest not in ("md5", "sha256"):
            raise ValueError(f"unknown digest {digest!r}")
        self.secret = secret
        self.key = F.col(key) if isinstance(key, str) else key
        self.digest = digest

    def uniform(self, column: str, stream: int | str = 0) -> Column:
        """Uniform in (0, 1) for this row and column; streams are independent of each other.

        One digest holds two draws, so streams 0 and 1 of a column share its cost.
        """
        block, half = divmod(stream, 2) if isinstance(stream, int) else (stream, 0)
        text = F.concat(F.lit(f"{self.secret}|{column}|{block}|"), self.key.cast("string"))
        digest = F.md5(text) if self.digest == "md5" else F.sha2(text, 256)
        cell = F.conv(F.substring(digest, 1 + half * _HEX_DIGITS, _HEX_DIGITS), 16, 10).cast("double")
        return (cell + F.lit(0.5)) / F.lit(_CELLS)

    def bits(self, column: str, stream: int) -> tuple[Column, Column]:
        """Two independent whole numbers of 60 bits for this row and column, from one digest."""
        text = F.concat(F.lit(f"{self.secret}|{column}|e{stream}|"), self.key.cast("string"))
        digest = F.md5(text) if self.digest == "md5" else F.sha2(text, 256)
        return tuple(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("bigint") for k in (0, 1))

    def dataset_level(self) -> "KeyedNoise":
        """Draws for values that belong to the whole table, such as an imputed mean."""
        return KeyedNoise(self.secret, F.lit("*"), self.digest)


class TaskNoise:
    """Draws from `rand()`. They differ when a stage is recomputed, so write the result
    once and audit the written table."""

    def __init__(self, seed: int | None = None):
        self.seed = seed

    def uniform(self, column: str, stream: int | str = 0) -> Column:
        u = F.rand() if self.seed is None else F.rand(self.seed + _stable_offset(f"{column}|{stream}"))
        # rand() can return 0, for which the logarithms below have no value
        return (F.floor(u * F.lit(_CELLS)) + F.lit(0.5)) / F.lit(_CELLS)

    def dataset_level(self) -> "TaskNoise":
        return self


def _stable_offset(text: str) -> int:
    return sum((i + 1) * ord(ch) for i, ch in enumerate(text))
