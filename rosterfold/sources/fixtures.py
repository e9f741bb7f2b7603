"""Directory requests and events derived from the star-schema test tables.

Used by the registered queries, the benchmark and the tests; the operators know nothing of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterfold import schemas as s
from rosterfold.functions.etags import invitation_etag, user_etag
from rosterfold.operators.folds import (GROUP_CREATED, GROUP_REMOVED, INVITATION_ACCEPTED, INVITATION_CREATED,
                                        USER_CREATED, USER_UPDATED)
from rosterfold.operators.skew import lookup

_CUSTOMER = "concat('users/cust-', cast(c_custkey as string))"
_ORDER_USER = "concat('users/cust-', cast(o_custkey as string))"
_EVENT_USER = "concat('users/cust-', cast(user_id as string))"
_NOBODY = "concat('users/none-', cast(user_id as string))"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _table(spark, sf_dir, "events").filter(F.col("event_type") == kind)


def _brought_near(rows: DataFrame) -> DataFrame:
    """The dates of orders and shipments moved into the weeks of the request tables, a day to 18 minutes, in their order."""
    minutes = "18 * datediff(cast(ts as date), date '1995-01-01')"
    return rows.withColumn("ts", F.expr(f"timestampadd(MINUTE, {minutes}, timestamp_ntz '2024-01-01 00:00:00')"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr(
        f"{_CUSTOMER} as name", "concat('uid-', cast(c_custkey as string)) as uid", "c_name as display_name",
        "concat('c', cast(c_custkey as string), '@example.com') as email", "1 as aggregate_version")
    rows = rows.withColumn("etag", user_etag(F.col("name"), F.col("aggregate_version")))
    return s.conform(rows, s.USER)


def create_user_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, "signup").selectExpr(
        "event_id as request_id", "ts", "concat('uid-', cast(user_id as string)) as uid",
        """case when event_id % 11 = 0 then 'ab' when event_id % 13 = 0 then 'Bad_Name'
           else concat('user-', cast((user_id * 3 + event_id) % 197 as string)) end as user_id""",
        """case when event_id % 7 = 0 then ' x '
           else concat('  Member ', cast(user_id as string), '  ') end as display_name""",
        "case when event_id % 17 = 0 then '  ' else concat('m', cast(user_id as string), '@example.com ') end as email")
    return s.conform(rows, s.CREATE_USER_REQUEST)


def update_user_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, "click").selectExpr(
        "event_id as request_id", "ts", f"case when event_id % 13 = 0 then {_NOBODY} else {_EVENT_USER} end as name",
        "concat('uid-none-', cast(user_id as string)) as uid",
        "case when event_id % 5 = 0 then 0 else 1 end as etag_version",
        """split(case event_id % 6 when 0 then 'display_name' when 1 then 'email' when 2 then 'uid'
           when 3 then 'display_name,email' when 4 then 'nope' else 'uid,email' end, ',') as mask""",
        """case when event_id % 7 = 0 then ' x '
           else concat('  Renamed ', cast(event_id as string), ' ') end as display_name""",
        "concat(' r', cast(event_id as string), '@example.com') as email",
        "event_id % 2 = 0 as allow_missing")
    tag = F.when(F.col("etag_version") == 0, '"stale"').otherwise(user_etag(F.col("name"), F.col("etag_version")))
    return s.conform(rows.withColumn("etag", tag), s.UPDATE_USER_REQUEST)


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    renames = "o_orderstatus = 'P' and o_orderpriority = '1-URGENT'"
    log = orders.selectExpr(
        "cast(o_orderdate as timestamp_ntz) as ts", "o_orderkey as seq", f"{_ORDER_USER} as name",
        f"""case when {renames} then '{USER_UPDATED}' when o_orderstatus = 'O' then '{GROUP_CREATED}'
            when o_orderstatus = 'F' then '{INVITATION_ACCEPTED}' else '{GROUP_REMOVED}' end as event_type""",
        f"case when not ({renames}) then concat('groups/g-', cast(o_orderkey % 7 as string)) end as group_name",
        f"case when {renames} then concat('Renamed ', cast(o_orderkey as string)) end as display_name",
        f"""case when {renames} then case o_orderkey % 3 when 0 then array() when 1 then array('groups/g-1')
            else array('groups/g-2', 'groups/g-3') end end as groups""")

    def created(at: str, seq: int, condition: str) -> DataFrame:
        return customer.filter(condition).selectExpr(
            f"timestamp_ntz '{at}' as ts", f"cast({seq} as bigint) as seq", f"{_CUSTOMER} as name",
            f"'{USER_CREATED}' as event_type", "c_name as display_name", "cast(array() as array<string>) as groups")

    log = log.unionByName(created("1994-01-01 00:00:00", -1, "c_custkey % 50 <> 49"), allowMissingColumns=True)
    log = log.unionByName(created("1998-01-01 12:00:00", -2, "c_custkey % 50 = 48"), allowMissingColumns=True)
    return s.conform(log, s.USER_EVENT, keep_null=("groups", "display_name"))


def created_invitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 9").selectExpr(
        "o_orderdate as ts", "o_orderkey as seq",
        f"concat({_ORDER_USER}, '/groupInvitations/inv-', cast(o_orderkey as string)) as name",
        f"'{INVITATION_CREATED}' as event_type", "concat('groups/g-', cast(o_orderkey % 7 as string)) as group_name",
        "'PENDING' as state", "o_orderdate as create_time")
    return s.conform(rows, s.INVITATION_EVENT)


def decision_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").filter("l_returnflag in ('A', 'R')").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag", "l_linestatus")
    # Both sides are big tables, so they are merged, also where the files are small enough to broadcast.
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").hint("merge")
    rows = lookup(lines, orders, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_shipdate"], "inner").selectExpr(
        """concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string),
           date_format(l_shipdate, 'yyyyMMdd'), l_returnflag) as request_id""",
        "l_shipdate as ts",
        f"concat({_ORDER_USER}, '/groupInvitations/inv-', cast(l_orderkey as string)) as name",
        "case l_returnflag when 'A' then 'ACCEPTED' else 'REJECTED' end as action",
        "case when l_linenumber = 3 then 2 when l_linestatus = 'O' then 1 else 0 end as etag_version")
    rows = rows.withColumn("etag", invitation_etag(F.col("name"), F.col("etag_version")))
    return s.conform(rows, s.DECIDE_INVITATION_REQUEST)


def created_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with their owner and the time they were made: one for each order."""
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_orderdate as ts", "o_orderkey as seq", "concat('groups/own-', cast(o_orderkey as string)) as name", f"{_ORDER_USER} as owner")


def member_births(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A created event for every customer, ahead of all dates of the tables."""
    rows = _table(spark, sf_dir, "customer").selectExpr(
        "timestamp_ntz '1900-01-01 00:00:00' as ts", "cast(0 as bigint) as seq", f"{_CUSTOMER} as name", f"'{USER_CREATED}' as event_type",
        "c_name as display_name", "cast(array() as array<string>) as groups")
    return s.conform(rows, s.USER_EVENT)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").selectExpr(
        "concat('groups/g-', cast(o_orderkey % 5 as string)) as name").distinct()
    return s.conform(rows, s.GROUP)


def create_invitation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, "purchase").selectExpr(
        "event_id as request_id", "ts", f"case when event_id % 11 = 0 then {_NOBODY} else {_EVENT_USER} end as parent",
        "concat('groups/g-', cast(event_id % 7 as string)) as group_name")
    return s.conform(rows, s.CREATE_INVITATION_REQUEST)


def remove_group_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, "error").selectExpr(
        "event_id as request_id", "ts",
        f"case when event_id % 11 = 0 then {_NOBODY} else {_EVENT_USER} end as user_name",
        "concat('groups/g-', cast(event_id % 7 as string)) as group_name")
    return s.conform(rows, s.REMOVE_GROUP_REQUEST)


def lookup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, "view").selectExpr(
        "event_id as request_id", "ts",
        f"case when event_id % 9 = 0 then 'bad' when event_id % 8 = 0 then {_NOBODY} else {_EVENT_USER} end as name",
        """case when event_id % 8 = 0 then concat('uid-none-', cast(user_id as string))
           else concat('uid-', cast(user_id as string)) end as uid""",
        "base64(encode(cast(cast(event_id % 4 as int) * 3 as string), 'UTF-8')) as page_token", "3 as page_size")
    return s.conform(rows, s.LOOKUP_REQUEST)


def oddly_named_invitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created invitations, some under names that have no user in front."""
    rows = _table(spark, sf_dir, "orders").selectExpr(
        "o_orderdate as ts", "o_orderkey as seq",
        f"case o_orderstatus when 'P' then concat('people/', cast(o_custkey as string)) else {_ORDER_USER} end || '/groupInvitations/inv-' || cast(o_orderkey as string) as name",
        f"'{INVITATION_CREATED}' as event_type", "concat('groups/g-', cast(o_orderkey % 7 as string)) as group_name")
    return s.conform(rows, s.INVITATION_EVENT)


def request_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create requests as records of a topic (key, value, timestamp); some values are cut off, some are not there."""
    rows = create_user_requests(spark, sf_dir)
    value = F.to_json(F.struct("request_id", "uid", "user_id", "display_name", "email"))
    cut = F.when(F.col("request_id") % 7 == 1, F.substring(value, 1, 20)).when(F.col("request_id") % 7 != 2, value)
    return rows.select(F.col("request_id").cast("string").alias("key"), cut.alias("value"), F.col("ts").cast("timestamp").alias("timestamp"))


# Tables whose times lie together, for histories of all of them.


def near_user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brought_near(user_events(spark, sf_dir))


def near_decision_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brought_near(decision_requests(spark, sf_dir))


def known_and_made_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that were always there, without a time, and those that users make."""
    always = groups(spark, sf_dir).selectExpr("cast(null as timestamp_ntz) as ts", "cast(0 as bigint) as seq", "name", "owner")
    return _brought_near(created_groups(spark, sf_dir)).select("ts", "seq", "name", "owner").unionByName(always)


def newcomer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create requests for the names that other requests use without a user."""
    return create_user_requests(spark, sf_dir).withColumns({
        "user_id": F.expr("case when user_id in ('ab', 'Bad_Name') then user_id else concat('none-', substr(uid, 5)) end"),
        "uid": F.expr("concat('uid-new-', substr(uid, 5))")})


def informed_update_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update requests that guess the version a user has by then, some of which append a group."""
    rows = update_user_requests(spark, sf_dir)
    guess = F.expr("1 + (13 * (day(ts) - 1)) div 30 + request_id % 4")
    appends = F.col("request_id") % 6 == 2
    return rows.withColumns({
        "etag": F.when(F.col("request_id") % 5 == 0, '"stale"').otherwise(user_etag(F.col("name"), guess)),
        "mask": F.when(appends, F.array(F.lit("groups"))).otherwise(F.col("mask")),
        "groups": F.when(appends, F.array(F.concat(F.lit("groups/g-"), (F.col("request_id") % 7).cast("string")))).otherwise(F.col("groups"))})
