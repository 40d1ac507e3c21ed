"""Folds over arrays of any length as column expressions.

Appending to an array copies it, so a plain fold that collects its steps takes time with the square of their number. Here
the array is cut into blocks of BLOCK, and these into blocks again: no fold appends to more than BLOCK entries but the last
one, which has one entry a BLOCK * BLOCK of the array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cut(items: Column) -> Column:
    number = F.ceil(F.size(items) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(number, F.lit(1)) - 1), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))


def collected(items: Column, start: Column, step: Callable[[Column, Column], Column], of: str) -> Column:
    """Struct (at, out): fold step(at, item), a struct (at, out: array<of>), over the items from at = start; outs are joined."""

    def level(items: Column, at: Column, inner: Callable[[Column, Column], Column], type_: str) -> Column:
        begin = F.struct(at.alias("at"), F.array().cast(f"array<{type_}>").alias("out"))
        return F.aggregate(items, begin, lambda state, item: let(inner(state["at"], item), lambda new: F.struct(new["at"].alias("at"), F.concat(state["out"], new["out"]).alias("out"))))

    def over(inner: Callable[[Column, Column], Column], type_: str) -> Callable[[Column, Column], Column]:
        return lambda at, block: let(level(block, at, inner, type_), lambda done: F.struct(done["at"].alias("at"), F.array(done["out"]).alias("out")))

    flat = lambda done: F.struct(done["at"].alias("at"), F.flatten(F.flatten(done["out"])).alias("out"))
    whole = lambda items: level(_cut_twice(items), start, over(over(step, of), f"array<{of}>"), f"array<array<{of}>>")
    return let(items, lambda x: let(whole(x), flat))


def _cut_twice(items: Column) -> Column:
    return let(_cut(items), _cut)


def running(lengths: Column) -> Column:
    """The sums of the first 1, 2, ... entries."""
    def step(at: Column, n: Column) -> Column:
        return let(at + n, lambda now: F.struct(now.alias("at"), F.array(now).alias("out")))

    return collected(lengths, F.lit(0), step, "int")["out"]
