"""Small building blocks of DataFrame expressions on arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that running sums add up at once, and how often blocks are taken of blocks.
BLOCK, LEVELS = 32, 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def bound(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` standing for ``value``, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _prefix(values: str, first: str, combine: Callable[[str, str], str], k: int) -> str:
    """``first`` and the combination of the first 1, 2, ... values with it; its cost is the square of their number."""
    return f"aggregate({values}, array({first}), (a{k}, x{k}) -> concat(a{k}, array({combine(f'element_at(a{k}, -1)', f'x{k}')})))"


def running(values: str, combine: Callable[[str, str], str], levels: int = LEVELS) -> str:
    """SQL text of the combination of 0 and all values (bigint) before each one, and of all of them.

    Values are taken in blocks, the blocks' own results in blocks again, and so
    on for ``levels``: an array copy is as long as a block, so the cost grows
    with the number of values until blocks of the top level are many.  The text
    is parsed at once, where as many calls on columns would take seconds.
    """
    if not levels:
        return _prefix(values, "0L", combine, 0)
    k = levels
    cut = bound(f"concat({values}, array(0L))", f"v{k}", f"transform(sequence(1, size(v{k}), {BLOCK}), s{k} -> slice(v{k}, s{k}, {BLOCK}))")
    whole = f"transform(b{k}, c{k} -> aggregate(c{k}, 0L, (p{k}, q{k}) -> {combine(f'p{k}', f'q{k}')}))"
    placed = f"flatten(transform(b{k}, (d{k}, i{k}) -> slice({_prefix(f'd{k}', f'get(r{k}, i{k})', combine, k)}, 1, size(d{k}))))"
    return bound(cut, f"b{k}", bound(running(whole, combine, levels - 1), f"r{k}", placed))


def running_sum(values: str) -> str:
    return running(values, lambda a, x: f"{a} + {x}")


def running_max(values: str) -> str:
    return running(values, lambda a, x: f"greatest({a}, {x})")
