"""Validation rules. Each gives an array of violations, empty when the value is fine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rosterfold.functions import messages as text
from rosterfold.functions.status import violation
from rosterfold.functions.text import units


def _none() -> Column:
    return F.array().cast("array<struct<field:string,description:string>>")


def _one(field: str, description: str) -> Column:
    return F.array(violation(field, description))


def _sized(field: str, label: str, value: Column, low: int, high: int) -> Column:
    """At most one of empty, too short and too long, in that order."""
    size = units(value)
    return (F.when(size == 0, _one(field, text.EMPTY % label))
            .when(size < low, _one(field, text.TOO_SHORT % (label, low)))
            .when(size > high, _one(field, text.TOO_LONG % (label, high)))
            .otherwise(_none()))


def _present(field: str, label: str, value: Column) -> Column:
    return F.when(value == "", _one(field, text.EMPTY % label)).otherwise(_none())


def user_id_violations(user_id: Column) -> Column:
    """Length and alphabet are judged separately, so a value can break both."""
    alphabet = F.when(user_id.rlike("[^a-z0-9-]"), _one(
        "userId", text.BAD_ALPHABET)).otherwise(_none())
    return F.concat(_sized("userId", text.USER_ID_LABEL, user_id, 4, 63), alphabet)


def profile_violations(display_name: Column, email: Column, uid: Column) -> Column:
    """All broken profile rules, in the order display name, email, uid."""
    return F.concat(
        _sized("user.displayName", text.DISPLAY_NAME_LABEL, display_name, 4, 120),
        _present("user.email", text.EMAIL_LABEL, email),
        _present("user.uid", text.UID_LABEL, uid))


def broken(violations: Column) -> Column:
    return F.size(violations) > 0
