"""Arithmetic on unsigned 8-bit values, which wraps, as column expressions; and the two-point security lattice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, HIGH = 0, 1


def wrap(c: Column) -> Column:
    """A number as a value of 0 … 255."""
    return F.pmod(c.cast("bigint"), F.lit(256)).cast("smallint")


def plus(a: Column, b: Column) -> Column:
    return wrap(a.cast("bigint") + b.cast("bigint"))


def minus(a: Column, b: Column) -> Column:
    return wrap(a.cast("bigint") - b.cast("bigint"))


def times(a: Column, b: Column) -> Column:
    return wrap(a.cast("bigint") * b.cast("bigint"))


def quotient(a: Column, b: Column) -> Column:
    """Whole quotient; null if b is 0."""
    return F.when(wrap(b) != 0, F.floor(wrap(a) / wrap(b)).cast("smallint"))


def remainder(a: Column, b: Column) -> Column:
    return F.when(wrap(b) != 0, (wrap(a) % wrap(b)).cast("smallint"))


def both(a: Column, b: Column) -> Column:
    return wrap(a).bitwiseAND(wrap(b))


def either(a: Column, b: Column) -> Column:
    return wrap(a).bitwiseOR(wrap(b))


def differ(a: Column, b: Column) -> Column:
    return wrap(a).bitwiseXOR(wrap(b))


def negate(a: Column) -> Column:
    return wrap(-a.cast("bigint"))


def shift_left(a: Column, n: int) -> Column:
    return wrap(F.shiftleft(wrap(a).cast("int"), n))


def shift_right(a: Column, n: int) -> Column:
    return F.shiftright(wrap(a).cast("int"), n).cast("smallint")


def join(level: Column) -> Column:
    """The least upper bound of a group's levels; low for none."""
    return F.coalesce(F.max(level), F.lit(LOW))


def meet(level: Column) -> Column:
    """The greatest lower bound of a group's levels; high for none."""
    return F.coalesce(F.min(level), F.lit(HIGH))


def touch(cache: Column, line: Column, size: int) -> Column:
    """A least-recently-used cache (array, latest first, of `size` lines at most) after an access to line."""
    return F.slice(F.concat(F.array(line), F.filter(cache, lambda x: x != line)), 1, size)
