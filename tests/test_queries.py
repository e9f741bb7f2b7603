"""Every registered query against its SQL twin, and the outcome counts of the derived inputs."""

import pytest

import __spark_entry__ as entry
from rosterfold.checks import registry
from rosterfold.checks.compare import differences

SF = "/root/testdata/sf0.001"


def test_every_query_has_a_twin():
    own = {name for name in entry.queries() if not name.startswith("op") and name != "pipeline"}
    assert own == {name for name in entry.oracle_sql() if not name.startswith("op")}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    assert differences(spark, SF, name) is None


@pytest.mark.parametrize("name", ["create_user_outcomes", "update_user_replay", "decide_invitation_replay", "user_history",
                                  "user_groups", "invitation_snapshot", "list_invitations", "remove_group_outcomes"])
def test_query_equals_sql_when_keys_are_heavy(heavy, name):
    assert differences(heavy, SF, name) is None


COUNTS = {
    "create_user_outcomes": {0: 15, 6: 178, 3: 6},
    "update_user_snapshot": {0: 125, 5: 16, 10: 40, 3: 29},
    "remove_group_outcomes": {0: 63, 5: 138},
    "create_invitation_outcomes": {0: 117, 3: 85},
    "get_user": {0: 137, 3: 27, 5: 24},
}


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_outcome_counts(spark, name):
    rows = entry.queries()[name](spark, SF).groupBy("code").count().collect()
    assert {r["code"]: r["count"] for r in rows} == COUNTS[name]


def test_entry(spark):
    assert entry.entry(spark).count() > 1000
