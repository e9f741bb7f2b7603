"""Update masks: which fields of the stored user a request may overwrite."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rosterfold.schemas import IMMUTABLE_USER_FIELDS, USER_FIELDS


def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(value) for value in values])


def writable(mask: Column) -> Column:
    """The mask without immutable fields and all paths below them; repeated paths collapse."""
    return F.filter(F.array_distinct(mask), lambda path: ~F.substring_index(path, ".", 1).isin(IMMUTABLE_USER_FIELDS))


def is_known(mask: Column) -> Column:
    return F.size(F.array_except(mask, _names(USER_FIELDS))) == 0


def covers(mask: Column, field: str) -> Column:
    return F.array_contains(mask, field)


def merged(mask: Column, field: str, requested: Column, current: Column) -> Column:
    return F.when(covers(mask, field), requested).otherwise(current)

