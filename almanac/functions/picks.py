"""Repeatable integer picks for resampling.

A pick depends only on its inputs, so recomputation after a lost executor gives the same draw, and plain SQL can
state it too. Two rounds of a quadratic map modulo a prime break the pattern of the linear combination; all of it is
integer arithmetic inside generated code.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

PRIME = 2147483647
MULTIPLIERS = (48271, 69621, 1299709, 104729, 7919)
ROUNDS = ((31, 12345), (17, 6789))


def _weighted(parts: Sequence) -> list[tuple]:
    if len(parts) > len(MULTIPLIERS):
        raise ValueError(f"at most {len(MULTIPLIERS)} parts, not {len(parts)}")
    return list(zip(MULTIPLIERS, parts, strict=False))


def mixed(parts: Sequence[Column | str], seed: int) -> Column:
    """A number in [0, PRIME) from up to five integer columns; more are an error."""
    return finished(F.lit(seed).cast("bigint") + linear(parts))


def linear(parts: Sequence[Column | str], after: int = 0) -> Column:
    """The linear part of :func:`mixed` for parts that follow ``after`` others: what repeats on many rows is formed once."""
    total = F.lit(0).cast("bigint")
    for multiplier, part in _weighted([0] * after + list(parts))[after:]:
        column = F.col(part) if isinstance(part, str) else part
        total = total + (column.cast("bigint") % PRIME) * F.lit(multiplier).cast("bigint")
    return total


def finished(total: Column) -> Column:
    for shift, constant in ROUNDS:
        rest = total % PRIME
        total = rest * (rest + shift) + constant
    return total % PRIME


def pick(parts: Sequence[Column | str], size: Column, seed: int) -> Column:
    """An index in 1..size."""
    return mixed(parts, seed) % size.cast("bigint") + 1


def mixed_sql(parts: Sequence[str], seed: int) -> str:
    """The SQL text of :func:`mixed`."""
    total = f"CAST({seed} AS BIGINT)"
    for multiplier, part in _weighted(parts):
        total += f" + (CAST({part} AS BIGINT) % {PRIME}) * {multiplier}"
    for shift, constant in ROUNDS:
        rest = f"(({total}) % {PRIME})"
        total = f"({rest} * ({rest} + {shift}) + {constant})"
    return f"(({total}) % {PRIME})"


def pick_sql(parts: Sequence[str], size: str, seed: int) -> str:
    return f"({mixed_sql(parts, seed)} % ({size}) + 1)"


def normal(parts: Sequence[Column | str], seed: int) -> Column:
    """A standard normal draw that depends on the parts and the seed alone (Box-Muller on two mixed numbers)."""
    one, two = ((mixed(parts, seed + k) + 0.5) / F.lit(float(PRIME)) for k in (0, 1))
    return F.sqrt(-2 * F.ln(one)) * F.cos(2 * math.pi * two)


def normal_sql(parts: Sequence[str], seed: int) -> str:
    one, two = (f"(({mixed_sql(parts, seed + k)} + 0.5::DOUBLE) / {PRIME}.0::DOUBLE)" for k in (0, 1))
    return f"(sqrt(-2 * ln({one})) * cos(2 * pi() * {two}))"
