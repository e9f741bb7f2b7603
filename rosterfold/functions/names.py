"""Resource names of users and invitations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rosterfold.functions.text import units

# Fixed values of the naming scheme.
USER_PREFIX = "users/"
INVITATION_PATTERN = "(users/[a-z0-9-]+)/groupInvitations/[a-z0-9-]+"
SHORTEST_ID, LONGEST_ID = 4, 63


def user_name(user_id: Column) -> Column:
    return F.concat(F.lit(USER_PREFIX), user_id)


def user_id_of(name: Column) -> Column:
    return F.replace(name, F.lit(USER_PREFIX), F.lit(""))


def is_user_name(name: Column) -> Column:
    """Prefix and total length only; the characters are not looked at."""
    return F.startswith(name, F.lit(USER_PREFIX)) & units(name).between(
        len(USER_PREFIX) + SHORTEST_ID, len(USER_PREFIX) + LONGEST_ID)


def invitation_parent(name: Column) -> Column:
    """User a invitation belongs to, from the first match anywhere in the name; '' without one."""
    return F.regexp_extract(name, INVITATION_PATTERN, 1)


def invitation_name(parent: Column, request_id: Column) -> Column:
    """A name that a retried request reproduces: the id part is a digest of the request id."""
    digest = F.sha2(request_id.cast("string"), 256)
    parts, start = [], 1
    for width in (8, 4, 4, 4, 12):
        parts.append(F.substring(digest, start, width))
        start += width
    return F.concat(parent, F.lit("/groupInvitations/"), F.concat_ws("-", *parts))
