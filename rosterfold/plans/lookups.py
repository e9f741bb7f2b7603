"""Reads over folded state, in bulk: one row per lookup request."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterfold.functions import messages as text, status as st
from rosterfold.functions.names import invitation_parent, is_user_name
from rosterfold.functions.paging import page_offset, page_token
from rosterfold.operators.gates import Gate, judged, is_passed, when_passed
from rosterfold.operators.skew import Probe, lookup
from rosterfold.operators.workspace import pinned

USER_COLUMNS = ["uid", "display_name", "email", "aggregate_version", "etag"]

# Index rows are fetched a block at a time, so that a page of any size is a few join keys.
BLOCK = 128


def _stored(users: DataFrame) -> DataFrame:
    return users.select("name", F.struct(*USER_COLUMNS).alias("cur"))


def _answered(rows: DataFrame, ahead: list[Gate]) -> DataFrame:
    gates = [*ahead,
             Gate("name", ~is_user_name(F.col("name")),
                  st.status(st.INVALID_ARGUMENT, F.format_string(text.BAD_NAME, "name"))),
             Gate("user", F.col("cur").isNull(), st.not_found(F.format_string(text.NOT_THERE, "name")))]
    return judged(rows, gates, st.ok(""))


def get_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Users by name."""
    rows = lookup(requests.select("request_id", "name"), _stored(users), ["name"], ["request_id"])
    return _answered(rows, []).select("request_id", "name", "gate", "status",
                                      *[when_passed(F.col(f"cur.{c}")).alias(c) for c in USER_COLUMNS])


def find_users(requests: DataFrame, uid_names: DataFrame, users: DataFrame) -> DataFrame:
    """Users by uid: uid to name, then name to user.

    The two state tables have one row per key, so they are cut to the asked uids and joined first, and requests only once.
    """
    asked = requests.select("request_id", F.col("uid").alias("asked_uid"))
    named = uid_names.select(F.col("uid").alias("asked_uid"), "name").join(asked.select("asked_uid").distinct(), "asked_uid", "left_semi")
    directory = named.join(_stored(users), "name", "left")
    rows = lookup(asked, directory, ["asked_uid"], ["request_id"])
    unknown = Gate("uid", F.col("name").isNull(),
                   st.not_found(F.format_string(text.NO_UID, "asked_uid")))
    return _answered(rows, [unknown]).select("request_id", "asked_uid", "name", "gate", "status",
                                             *[when_passed(F.col(f"cur.{c}")).alias(c) for c in USER_COLUMNS])


def groups_of(requests: DataFrame, users: DataFrame, groups: DataFrame, probe: Probe | None = None) -> DataFrame:
    """Group rows of every distinct user that the requests name, once per user."""
    asked = requests.select("name").filter(is_user_name(F.col("name"))).distinct()
    asked = asked.join(users.select("name"), "name", "left_semi")
    return lookup(groups, asked, ["name"], ["position"], "left_semi", probe)


def of_parents(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows with an invitation ``name`` whose parent some request asks for; made before these rows are folded or judged."""
    asked = requests.select(F.col("name").alias("_parent")).distinct()
    return lookup(rows.withColumn("_parent", invitation_parent("name")), asked, ["_parent"], ["name"], "left_semi").select(*rows.columns)


def list_invitations(requests: DataFrame, index: DataFrame, invitations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of parents' invitations, newest first: (answers, items).

    ``answers`` has one row per request with its status, total and the token of the next page;
    ``items`` has one row per listed invitation. An offset past the end gives an empty page.
    """
    sizes = index.groupBy("parent").agg(F.count(F.lit(1)).alias("total"))
    rows = requests.select("request_id", F.col("name").alias("parent"), page_offset(F.col("page_token")).alias("offset"),
                           F.col("page_size").cast("long").alias("page_size"))
    rows = lookup(rows, sizes, ["parent"], ["request_id"])
    gates = [
        Gate("index", F.col("total").isNull(), st.not_found(F.format_string(text.NO_INVITATIONS, "parent"))),
        Gate("page_size", F.col("page_size") <= 0, st.bad_request(F.array(st.violation(
            "page_size", text.BAD_PAGE_SIZE))))]
    end = F.col("offset") + F.col("page_size")
    answers = judged(rows, gates, st.ok("")).withColumn(
        "next_page_token", when_passed(F.when(end < F.col("total"), page_token(end.cast("int"))).otherwise("")))
    answers = pinned(answers, "answers")

    last = F.least(end, F.col("total"))
    asked = answers.filter(is_passed() & (F.col("offset") < F.col("total"))).select(
        "request_id", "parent", F.col("offset").alias("_after"), last.alias("_last"),
        F.explode(F.sequence(F.floor(F.col("offset") / BLOCK), F.floor((last - 1) / BLOCK))).alias("_block"))
    wanted = asked.select("parent", "_block").distinct()
    listed = index.withColumn("_block", F.floor((F.col("position") - 1) / BLOCK))
    listed = listed.join(wanted, ["parent", "_block"], "left_semi")
    state = invitations.select("name", "group_name", "state", "aggregate_version", "etag")
    listed = lookup(listed, state, ["name"], ["parent", "position"], probe=Probe(index))
    items = lookup(asked, listed, ["parent", "_block"], ["request_id"], "inner")
    items = items.filter((F.col("position") > F.col("_after")) & (F.col("position") <= F.col("_last")))
    items = items.select("request_id", "parent", "position", *state.columns)
    return answers.select("request_id", "parent", "gate", "status", "total", "next_page_token"), items
