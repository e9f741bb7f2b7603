from pyspark.sql import functions as F

from rosterfold.functions import masks, names, paging, rules
from rosterfold.functions.etags import etag, user_etag
from rosterfold.functions.text import strip_blank, units

SMILE = "\U0001F600"


def values(spark, inputs, *columns, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    result = rows.select("i", *[c.alias(f"c{n}") for n, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1] if len(columns) == 1 else tuple(r)[1:] for r in result]


X = F.col("x")


def descriptions(spark, inputs, errors):
    return [[v.description for v in row] for row in values(spark, inputs, errors)]


def test_etag_is_a_quoted_digest(spark):
    expected = '"9357a833c85573d8cca565b450a13e08103a167ac1572ac79cf22024500b6a68"'
    assert values(spark, ["users/abcd"], user_etag(X, F.lit(1))) == [expected]
    assert values(spark, ["users/abcd"], etag("other", X, F.lit(1))) != [expected]


def test_trimming_drops_control_characters_and_keeps_other_blanks(spark):
    given = ["\t\n\x01 a b \x01\r\n", " a ", "", " \x00 ", "a \u0085"]
    assert values(spark, given, strip_blank(X)) == ["a b", " a ", "", "", "a \u0085"]


def test_length_counts_utf16_units(spark):
    assert values(spark, ["abc", SMILE + SMILE, ""], units(X).cast("int")) == [3, 4, 0]


def test_parent_is_the_first_match_anywhere(spark):
    given = ["users/user-id-1/groupInvitations/group-invitation-1", "xx users/a/groupInvitations/b/users/c/groupInvitations/d",
             "users/A/groupInvitations/b", ""]
    assert values(spark, given, names.invitation_parent(X)) == ["users/user-id-1", "users/a", "", ""]


def test_user_name_format_looks_at_prefix_and_length(spark):
    given = ["users/" + "a" * n for n in (3, 4, 63, 64)] + ["users/ABCD", "group/abcd"]
    assert values(spark, given, names.is_user_name(X)) == [False, True, True, False, True, False]


def test_invitation_names_repeat_for_the_same_request(spark):
    a, b, c = values(spark, ["users/a", "users/a", "users/b"], names.invitation_name(X, F.lit(7)))
    assert a == b and a.split("/")[:3] == ["users", "a", "groupInvitations"] and c.startswith("users/b/")
    assert [len(p) for p in a.split("/")[3].split("-")] == [8, 4, 4, 4, 12]
    assert values(spark, [a], names.invitation_parent(X)) == ["users/a"]


def test_user_id_and_name(spark):
    assert values(spark, ["abcd"], names.user_name(X), names.user_id_of(names.user_name(X))) == [("users/abcd", "abcd")]


def test_user_id_rules(spark):
    low, high = "User Id must has minimum 4 characters.", "User Id must has maximum 63 characters."
    odd = "User Id can only contain lower case letter, digit, and hyphen."
    given = ["", "abc", "abcd", "a" * 63, "a" * 64, "ABCD", "ab_d", "A", SMILE + SMILE]
    assert descriptions(spark, given, rules.user_id_violations(X)) == [
        ["User Id must not be empty."], [low], [], [], [high], [odd], [odd], [low, odd], [odd]]


def test_display_name_boundaries(spark):
    errors = rules.profile_violations(X, F.lit("e"), F.lit("u"))
    given = ["", "abc", "abcd", "a" * 120, "a" * 121, SMILE + SMILE]
    assert descriptions(spark, given, errors) == [
        ["User display name must not be empty."], ["User display name must has minimum 4 characters."], [], [],
        ["User display name must has maximum 120 characters."], []]


def test_profile_violations_come_in_order(spark):
    row = values(spark, [""], rules.profile_violations(X, X, X))[0]
    assert [v.field for v in row] == ["user.displayName", "user.email", "user.uid"]


def test_masks(spark):
    given = [["display_name", "uid", "display_name", "uid.x", "name.y.z"], [], ["nope"], ["groups", "etag"], [""]]
    clean = masks.writable(X)
    assert values(spark, given, clean, masks.is_known(clean), kind="array<string>") == [
        (["display_name"], True), ([], True), (["nope"], False), (["groups"], True), ([""], False)]


def test_masked_fields_replace(spark):
    given = [["email"], ["groups"], []]
    text = masks.merged(X, "email", F.lit(""), F.lit("old"))
    assert values(spark, given, text, kind="array<string>") == ["", "old", "old"]


def test_page_tokens(spark):
    assert values(spark, [10, 0], paging.page_token(X), kind="int") == ["MTA=", "MA=="]
    # 10; not Base64; empty; "abc"; "-5"; " 5"; beyond an int; bytes that are not text
    given = ["MTA=", "!!", "", "YWJj", "LTU=", "IDU=", "OTk5OTk5OTk5OTk5", "/w=="]
    assert values(spark, given, paging.page_offset(X)) == [10, 0, 0, 0, 0, 0, 0, 0]
