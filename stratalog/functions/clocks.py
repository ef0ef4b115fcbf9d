"""Logical clocks as columns.  A vector clock is a map of counters; a missing counter is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(clock: Column, actor: Column) -> Column:
    return F.coalesce(F.try_element_at(clock, actor), F.lit(0))


def vector_before(left: Column, right: Column) -> Column:
    """No counter greater, one less."""
    actors = F.array_union(F.map_keys(left), F.map_keys(right))
    return F.forall(actors, lambda a: _at(left, a) <= _at(right, a)) & F.exists(actors, lambda a: _at(left, a) < _at(right, a))


def vector_concurrent(left: Column, right: Column) -> Column:
    """Neither before the other; equal clocks are concurrent."""
    return ~vector_before(left, right) & ~vector_before(right, left)


def vector_valid(clock: Column) -> Column:
    return F.forall(F.map_values(clock), lambda v: v >= 0)


def lamport_before(left: Column, right: Column) -> Column:
    """Structs with counter (and actor)."""
    return left["counter"] < right["counter"]


def hybrid_before(left: Column, right: Column) -> Column:
    """Structs with wall and logical (and actor)."""
    return (left["wall"] < right["wall"]) | ((left["wall"] == right["wall"]) & (left["logical"] < right["logical"]))
