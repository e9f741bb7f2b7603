"""Record schemas of the directory domain and the ingest rule that makes a frame conform to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TEXT, NUMBER, MOMENT = T.StringType(), T.IntegerType(), T.TimestampNTZType()
TEXT_LIST = T.ArrayType(T.StringType())

USER = _struct(name=TEXT, uid=TEXT, display_name=TEXT, email=TEXT, groups=TEXT_LIST,
               aggregate_version=NUMBER, etag=TEXT)
INVITATION = _struct(name=TEXT, group_name=TEXT, state=TEXT, create_time=MOMENT, update_time=MOMENT,
                     aggregate_version=NUMBER, etag=TEXT)
GROUP = _struct(name=TEXT, owner=TEXT)

# Requests: every row carries its place in the total order, (ts, request_id). The id is unique by contract.
CREATE_USER_REQUEST = _struct(request_id=T.LongType(), ts=MOMENT, uid=TEXT, user_id=TEXT,
                              display_name=TEXT, email=TEXT)
UPDATE_USER_REQUEST = _struct(request_id=T.LongType(), ts=MOMENT, name=TEXT, uid=TEXT, etag=TEXT, mask=TEXT_LIST,
                              display_name=TEXT, email=TEXT, groups=TEXT_LIST, allow_missing=T.BooleanType())
REMOVE_GROUP_REQUEST = _struct(request_id=T.LongType(), ts=MOMENT, user_name=TEXT, group_name=TEXT)
CREATE_INVITATION_REQUEST = _struct(request_id=T.LongType(), ts=MOMENT, parent=TEXT, group_name=TEXT)
DECIDE_INVITATION_REQUEST = _struct(request_id=TEXT, ts=MOMENT, name=TEXT, etag=TEXT, action=TEXT)
LOOKUP_REQUEST = _struct(request_id=T.LongType(), ts=MOMENT, name=TEXT, uid=TEXT,
                         page_token=TEXT, page_size=NUMBER)

# Domain events of a user; ordered by (ts, event_rank, seq). ``groups`` is the whole list of a created or updated
# user, null when an update leaves the list alone; ``added_groups`` is what an update appends.
USER_EVENT = _struct(ts=MOMENT, event_rank=NUMBER, seq=T.LongType(), name=TEXT, event_type=TEXT, group_name=TEXT,
                     uid=TEXT, display_name=TEXT, email=TEXT, groups=TEXT_LIST, added_groups=TEXT_LIST)

# Domain events of an invitation; ordered by (ts, event_rank, seq, request_id).
INVITATION_EVENT = _struct(ts=MOMENT, event_rank=NUMBER, seq=T.LongType(), request_id=TEXT, name=TEXT,
                           event_type=TEXT, group_name=TEXT, state=TEXT, create_time=MOMENT, update_time=MOMENT)

USER_EVENT_ORDER = ["ts", "event_rank", "seq"]
INVITATION_EVENT_ORDER = ["ts", "event_rank", "seq", "request_id"]

# Event names. Events of one time take effect in this order: what creates comes before what changes,
# and what comes from different request tables has an order whatever their numbers are.
USER_EVENT_TYPES = ["UserCreated", "UserUpdated", "GroupCreated", "GroupInvitationAccepted", "GroupRemoved"]
INVITATION_EVENT_TYPES = ["GroupInvitationCreated", "GroupInvitationAccepted", "GroupInvitationRejected"]

USER_FIELDS = USER.fieldNames()
IMMUTABLE_USER_FIELDS = ["uid", "name", "aggregate_version", "etag"]


def _rank(schema: T.StructType) -> Column:
    """The place of an event's type among those of one time."""
    types = INVITATION_EVENT_TYPES if "request_id" in schema.fieldNames() else USER_EVENT_TYPES
    return F.array_position(F.array(*map(F.lit, types)), F.col("event_type")).cast("int")


def conform(df: DataFrame, schema: T.StructType, keep_null: tuple[str, ...] = ()) -> DataFrame:
    """Select the schema's columns, absent ones included, in its order.

    Text is never null in the domain, so null text becomes the empty string and a null list the
    empty list, except for the columns named in ``keep_null``.
    """

    def column(field: T.StructField) -> Column:
        if field.name == "event_rank":
            return _rank(schema).alias(field.name)
        present = field.name in df.columns
        value = (F.col(field.name) if present else F.lit(None)).cast(field.dataType)
        if field.name not in keep_null:
            if isinstance(field.dataType, T.StringType):
                value = F.coalesce(value, F.lit(""))
            elif isinstance(field.dataType, T.ArrayType):
                value = F.coalesce(value, F.array().cast(field.dataType))
            elif isinstance(field.dataType, T.BooleanType):
                value = F.coalesce(value, F.lit(False))
        return value.alias(field.name)

    return df.select(*[column(field) for field in schema])
