"""Numeric column helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def round_half_up(value: Column | str, digits: int) -> Column:
    """Half-up rounding that does not depend on the order of a float sum.

    A mean such as 1.005 may come out as 1.00499999 or 1.00500001 depending on
    how rows were spread over tasks. Values within 1e-6 of a tie (in units of the
    last kept digit) count as the tie and move away from zero, so a retried task
    cannot change a reported figure.
    """
    c = F.col(value) if isinstance(value, str) else value
    scale = 10.0**digits
    return F.signum(c) * F.floor(F.abs(c) * F.lit(scale) + F.lit(0.500001)) / F.lit(scale)


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """``part / whole * scale`` with null where the whole is zero."""
    return part / F.when(whole != 0, whole) * F.lit(scale)


def holds(condition: Column) -> Column:
    """The condition with null counted as false, as a filter would."""
    return F.coalesce(condition, F.lit(False))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def labelled(value: Column, bounds, labels, inclusive: bool = False) -> Column:
    """Label of the first bound above the value; the last label is open-ended.

    ``inclusive`` puts the bound itself into the lower class.
    """
    if len(labels) != len(bounds) + 1:
        raise ValueError("labels must be one longer than bounds")
    tests = [(value <= F.lit(b)) if inclusive else (value < F.lit(b)) for b in bounds]
    chain = F.when(value.isNull(), F.lit(None))
    for test, label in zip(tests, labels):
        chain = chain.when(test, F.lit(label))
    return chain.otherwise(F.lit(labels[-1]))
