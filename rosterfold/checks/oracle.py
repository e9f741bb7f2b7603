"""The registered queries once more, as plain SQL over the test tables.

Written from the rules of the domain, not from the Spark plans: the allocation and the update replay
are row-by-row recursions here, the folds are windows over the whole log.
"""

from __future__ import annotations

INVALID = "Request contain invalid arguments. See details for more information."


def _etag(secret: str, name: str, version: str) -> str:
    return f"""('"' || sha256('{secret}-' || {name} || '-' || cast({version} as varchar)) || '"')"""


def user_etag(name: str, version: str) -> str:
    return _etag("eb659ae2", name, version)


def invitation_etag(name: str, version: str) -> str:
    return _etag("999a4c02", name, version)


def trim(text: str) -> str:
    blank = " || ".join(f"chr({code})" for code in range(1, 33))
    return f"trim({text}, {blank})"


def _joined(parts: list[str], separator: str = ",") -> str:
    return f"array_to_string([x for x in [{', '.join(parts)}] if x is not null], '{separator}')"


def user_id_errors(x: str) -> tuple[str, str]:
    size = f"case when length({x}) = 0 then {{0}} when length({x}) < 4 then {{1}} when length({x}) > 63 then {{2}} end"
    alphabet = f"case when regexp_matches({x}, '[^a-z0-9-]') then {{0}} end"
    fields = _joined([size.format("'userId'", "'userId'", "'userId'"), alphabet.format("'userId'")])
    texts = _joined([
        size.format("'User Id must not be empty.'", "'User Id must has minimum 4 characters.'",
                    "'User Id must has maximum 63 characters.'"),
        alphabet.format("'User Id can only contain lower case letter, digit, and hyphen.'")])
    return fields, texts


def profile_errors(display_name: str, email: str, uid: str) -> tuple[str, str]:
    size = (f"case when length({display_name}) = 0 then {{0}} when length({display_name}) < 4 then {{1}} "
            f"when length({display_name}) > 120 then {{2}} end")
    fields = _joined([size.format(*["'user.displayName'"] * 3), f"case when {email} = '' then 'user.email' end",
                      f"case when {uid} = '' then 'user.uid' end"])
    texts = _joined([
        size.format("'User display name must not be empty.'", "'User display name must has minimum 4 characters.'",
                    "'User display name must has maximum 120 characters.'"),
        f"case when {email} = '' then 'User email must not be empty.' end",
        f"case when {uid} = '' then 'User uid must not be empty.' end"])
    return fields, texts


# Derived inputs.

FX_USERS = f"""fx_users as (
 select *, {user_etag('name', '1')} as etag from (
 select 'users/cust-' || cast(c_custkey as varchar) as name, 'uid-' || cast(c_custkey as varchar) as uid,
  c_name as display_name, 'c' || cast(c_custkey as varchar) || '@example.com' as email,
  cast(1 as integer) as aggregate_version from customer))"""

FX_CREATE = f"""fx_create as (
 select event_id as request_id, ts, 'uid-' || cast(user_id as varchar) as uid,
  case when event_id % 11 = 0 then 'ab' when event_id % 13 = 0 then 'Bad_Name'
   else 'user-' || cast((user_id * 3 + event_id) % 197 as varchar) end as user_id,
  case when event_id % 7 = 0 then ' x ' else '  Member ' || cast(user_id as varchar) || '  ' end as display_name,
  case when event_id % 17 = 0 then '  ' else 'm' || cast(user_id as varchar) || '@example.com ' end as email
 from events where event_type = 'signup')"""

FX_UPDATE = f"""fx_update as (
 select *, case when etag_version = 0 then '"stale"' else {user_etag('name', 'etag_version')} end as etag,
  list_distinct([x for x in string_split(mask_csv, ',') if x not in ('uid', 'name', 'aggregate_version', 'etag')]) as mask
 from (
 select event_id as request_id, ts,
  case when event_id % 13 = 0 then 'users/none-' || cast(user_id as varchar)
   else 'users/cust-' || cast(user_id as varchar) end as name,
  'uid-none-' || cast(user_id as varchar) as uid,
  case when event_id % 5 = 0 then 0 else 1 end as etag_version,
  case event_id % 6 when 0 then 'display_name' when 1 then 'email' when 2 then 'uid'
   when 3 then 'display_name,email' when 4 then 'nope' else 'uid,email' end as mask_csv,
  case when event_id % 7 = 0 then ' x ' else '  Renamed ' || cast(event_id as varchar) || ' ' end as display_name,
  ' r' || cast(event_id as varchar) || '@example.com' as email, event_id % 2 = 0 as allow_missing
 from events where event_type = 'click'))"""

FX_USER_EVENTS = """fx_user_events as (
 select *, list_position(['UserCreated', 'UserUpdated', 'GroupCreated', 'GroupInvitationAccepted', 'GroupRemoved'], event_type) as event_rank from (
 select o_orderdate as ts, o_orderkey as seq, 'users/cust-' || cast(o_custkey as varchar) as name,
  case o_orderstatus when 'O' then 'GroupCreated' when 'F' then 'GroupInvitationAccepted' else 'GroupRemoved' end as event_type,
  'groups/g-' || cast(o_orderkey % 7 as varchar) as group_name, cast(null as varchar) as display_name,
  cast(null as varchar) as payload_groups
 from orders where not (o_orderstatus = 'P' and o_orderpriority = '1-URGENT')
 union all
 select o_orderdate, o_orderkey, 'users/cust-' || cast(o_custkey as varchar), 'UserUpdated', null,
  'Renamed ' || cast(o_orderkey as varchar),
  case o_orderkey % 3 when 0 then '' when 1 then 'groups/g-1' else 'groups/g-2,groups/g-3' end
 from orders where o_orderstatus = 'P' and o_orderpriority = '1-URGENT'
 union all
 select timestamp '1994-01-01 00:00:00', -1, 'users/cust-' || cast(c_custkey as varchar), 'UserCreated', null, c_name, ''
 from customer where c_custkey % 50 <> 49
 union all
 select timestamp '1998-01-01 12:00:00', -2, 'users/cust-' || cast(c_custkey as varchar), 'UserCreated', null, c_name, ''
 from customer where c_custkey % 50 = 48))"""

USER_LOG = f"""user_log as (
 select *, row_number() over (partition by name, epoch order by ts, event_rank, seq) as place from (
 select *, sum(case when event_type = 'UserCreated' then 1 else 0 end) over (partition by name order by ts, event_rank, seq) as epoch
 from fx_user_events)),
user_versions as (
 select ts, event_rank, seq, name, event_type, cast(epoch as bigint) as epoch,
  case when epoch > 0 then cast(place as integer) end as aggregate_version,
  case when epoch > 0 then last_value(display_name ignore nulls) over (partition by name order by ts, event_rank, seq) end as display_name
 from user_log),
user_now as (
 select name, display_name, aggregate_version, {user_etag('name', 'aggregate_version')} as etag from (
 select *, row_number() over (partition by name order by ts desc, event_rank desc, seq desc) as back from user_versions where epoch > 0)
 where back = 1)"""

USER_GROUPS = """added as (
 select e.name, e.ts, e.event_rank, e.seq, i.ordinal, case when event_type in ('UserCreated', 'UserUpdated')
   then string_split(payload_groups, ',')[i.ordinal + 1] else group_name end as group_name
 from (select * from user_log where epoch > 0) e, (select unnest([0, 1]) as ordinal) i
 where (event_type in ('GroupCreated', 'GroupInvitationAccepted') and i.ordinal = 0)
  or (event_type in ('UserCreated', 'UserUpdated') and payload_groups <> '' and i.ordinal < len(string_split(payload_groups, ',')))),
resets as (select name, ts, event_rank, seq from user_log where epoch > 0 and event_type in ('UserCreated', 'UserUpdated')),
removals as (select name, group_name, ts, event_rank, seq from user_log where epoch > 0 and event_type = 'GroupRemoved'),
spans as (
 select a.*, (select min((r.ts, r.event_rank, r.seq)) from resets r where r.name = a.name and (r.ts, r.event_rank, r.seq) > (a.ts, a.event_rank, a.seq)) as reset_at,
  (select min((r.ts, r.event_rank, r.seq)) from removals r where r.name = a.name and r.group_name = a.group_name and (r.ts, r.event_rank, r.seq) > (a.ts, a.event_rank, a.seq)) as removed_at
 from added a),
groups_now as (
 select name, row_number() over (partition by name order by ts, event_rank, seq, ordinal) as position, group_name, ts, seq
 from spans where reset_at is null and removed_at is null)"""

FX_INVITATIONS = """fx_invitations as (
 select o_orderdate as ts, o_orderkey as seq,
  'users/cust-' || cast(o_custkey as varchar) || '/groupInvitations/inv-' || cast(o_orderkey as varchar) as name,
  'groups/g-' || cast(o_orderkey % 7 as varchar) as group_name from orders where o_orderkey % 10 <> 9)"""

FX_DECISIONS = f"""fx_decisions as (
 select *, {invitation_etag('name', 'etag_version')} as etag from (
 select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) || '-' || cast(l_partkey as varchar)
   || '-' || strftime(l_shipdate, '%Y%m%d') || '-' || l_returnflag as request_id,
  l_shipdate as ts,
  'users/cust-' || cast(o_custkey as varchar) || '/groupInvitations/inv-' || cast(l_orderkey as varchar) as name,
  case l_returnflag when 'A' then 'ACCEPTED' else 'REJECTED' end as action,
  case when l_linenumber = 3 then 2 when l_linestatus = 'O' then 1 else 0 end as etag_version
 from lineitem join orders on l_orderkey = o_orderkey where l_returnflag in ('A', 'R')))"""

FX_GROUPS = "fx_groups as (select distinct 'groups/g-' || cast(o_orderkey % 5 as varchar) as name from orders)"

FX_INVITE = """fx_invite as (
 select event_id as request_id, ts,
  case when event_id % 11 = 0 then 'users/none-' || cast(user_id as varchar)
   else 'users/cust-' || cast(user_id as varchar) end as parent,
  'groups/g-' || cast(event_id % 7 as varchar) as group_name from events where event_type = 'purchase')"""

FX_REMOVE = """fx_remove as (
 select event_id as request_id, ts,
  case when event_id % 11 = 0 then 'users/none-' || cast(user_id as varchar)
   else 'users/cust-' || cast(user_id as varchar) end as user_name,
  'groups/g-' || cast(event_id % 7 as varchar) as group_name from events where event_type = 'error')"""

FX_LOOKUP = """fx_lookup as (
 select event_id as request_id, ts,
  case when event_id % 9 = 0 then 'bad' when event_id % 8 = 0 then 'users/none-' || cast(user_id as varchar)
   else 'users/cust-' || cast(user_id as varchar) end as name,
  case when event_id % 8 = 0 then 'uid-none-' || cast(user_id as varchar) else 'uid-' || cast(user_id as varchar) end as uid,
  cast(event_id % 4 as integer) * 3 as page_offset, 3 as page_size from events where event_type = 'view')"""


# Create requests, one by one.

_ID_FIELDS, _ID_TEXTS = user_id_errors("user_id")
_FIELDS, _TEXTS = profile_errors("display_name", "email", "uid")

CREATE_WALK = f"""{FX_CREATE},
asked as (
 select request_id, ts, uid, user_id, {_ID_FIELDS} as id_fields, {_ID_TEXTS} as id_texts, {_FIELDS} as fields, {_TEXTS} as texts,
  display_name, email, row_number() over (order by ts, request_id) as n
 from (select * replace ({trim('display_name')} as display_name, {trim('email')} as email) from fx_create)),
walk as (
 select cast(0 as bigint) as n, cast([] as varchar[]) as uids, cast([] as varchar[]) as ids, cast('' as varchar) as gate
 union all
 select n, case when gate = 'ok' then list_append(uids, uid) else uids end,
  case when gate = 'ok' then list_append(ids, user_id) else ids end, gate from (
  select a.n, w.uids, w.ids, a.uid, a.user_id,
   case when list_contains(w.uids, a.uid) then 'uid' when a.id_texts <> '' then 'user_id_format'
    when list_contains(w.ids, a.user_id) then 'user_id' when a.texts <> '' then 'fields' else 'ok' end as gate
  from walk w join asked a on a.n = w.n + 1)),
created as (
 select a.*, nullif(w.gate, 'ok') as gate, 'users/' || user_id as name from asked a join walk w on a.n = w.n)"""

CREATE_OUTCOMES = f"""with recursive {CREATE_WALK}
select request_id, uid, user_id, gate,
 cast(case gate when 'uid' then 6 when 'user_id' then 6 when 'user_id_format' then 3 when 'fields' then 3 else 0 end as integer) as code,
 case gate when 'uid' then 'User already exists.' when 'user_id' then 'User Id is taken.'
  when 'user_id_format' then '{INVALID}' when 'fields' then '{INVALID}' else 'User created.' end as message,
 case gate when 'user_id_format' then id_fields when 'fields' then fields end as violation_fields,
 case gate when 'user_id_format' then id_texts when 'fields' then texts end as violation_texts,
 case gate when 'uid' then 'User with uid ' || uid || ' already exists.'
  when 'user_id' then 'User with user id ' || user_id || ' already exists.' end as reason,
 case gate when 'uid' then 'uid=' || uid when 'user_id' then 'userId=' || user_id end as detail,
 case when gate is null then name end as name, case when gate is null then cast(1 as integer) end as aggregate_version,
 case when gate is null then {user_etag('name', '1')} end as etag
from created"""


# Updates.

_UP_FIELDS, _UP_TEXTS = profile_errors("new_name", "new_email", "cur_uid")

UPDATE_JUDGED = f"""merged as (
 select r.request_id, r.ts, r.name, r.etag as request_etag, r.mask, r.allow_missing, r.uid as request_uid,
  r.display_name as request_name, r.email as request_email, u.uid as cur_uid, u.etag as cur_etag, u.aggregate_version as cur_version,
  {trim("case when list_contains(r.mask, 'display_name') then r.display_name else u.display_name end")} as new_name,
  {trim("case when list_contains(r.mask, 'email') then r.email else u.email end")} as new_email
 from fx_update r left join fx_users u on r.name = u.name),
judged as (
 select *, {_UP_FIELDS} as fields, {_UP_TEXTS} as texts,
  case when cur_uid is null then 'user' when request_etag <> cur_etag then 'etag'
   when not list_has_all(['name', 'uid', 'display_name', 'email', 'groups', 'aggregate_version', 'etag'], mask) then 'mask'
   when {_UP_TEXTS} <> '' then 'fields' end as gate
 from merged)"""

_UPDATE_STATUS = f"""cast(case gate when 'user' then 5 when 'etag' then 10 when 'mask' then 3 when 'fields' then 3 else 0 end as integer) as code,
 case gate when 'user' then 'User with name ' || name || ' does not exists.' when 'etag' then 'Concurrency error.'
  when 'mask' then '{INVALID}' when 'fields' then '{INVALID}' else 'User updated.' end as message,
 case gate when 'mask' then 'update_mask' when 'fields' then fields end as violation_fields,
 case gate when 'mask' then 'Unable to map update_mask to User type.' when 'fields' then texts end as violation_texts,
 case gate when 'etag' then 'Etag is not the latest version.' end as reason,
 case gate when 'etag' then 'providedEtag=' || request_etag end as detail"""

UPDATE_SNAPSHOT = f"""with {FX_USERS}, {FX_UPDATE}, {UPDATE_JUDGED}
select request_id, name, gate, {_UPDATE_STATUS},
 case when gate is null then new_name end as display_name, case when gate is null then new_email end as email,
 case when gate is null then cast(cur_version + 1 as integer) end as aggregate_version,
 case when gate is null then {user_etag('name', '(cur_version + 1)')} end as etag
from judged"""

_RE_FIELDS, _RE_TEXTS = profile_errors("new_name", "new_email", "cur_uid")

UPDATE_REPLAY = f"""with recursive {FX_USERS}, {FX_UPDATE},
asked as (select *, row_number() over (partition by name order by ts, request_id) as n from fx_update),
walk as (
 select name, cast(0 as bigint) as n, uid as cur_uid, aggregate_version as version, display_name as shown, email as mail,
  cast(null as bigint) as request_id, cast('' as varchar) as gate, cast('' as varchar) as fields, cast('' as varchar) as texts,
  cast('' as varchar) as request_etag
 from fx_users
 union all
 select name, n, cur_uid, case when gate = 'ok' then cast(version + 1 as integer) else version end,
  case when gate = 'ok' then new_name else shown end, case when gate = 'ok' then new_email else mail end,
  request_id, gate, fields, texts, request_etag from (
  select *, {_RE_FIELDS} as fields, {_RE_TEXTS} as texts,
   case when request_etag <> {user_etag('name', 'version')} then 'etag'
    when not list_has_all(['name', 'uid', 'display_name', 'email', 'groups', 'aggregate_version', 'etag'], mask) then 'mask'
    when {_RE_TEXTS} <> '' then 'fields' else 'ok' end as gate
  from (
   select w.name, a.n, w.cur_uid, w.version, w.shown, w.mail, a.request_id, a.etag as request_etag, a.mask,
    {trim("case when list_contains(a.mask, 'display_name') then a.display_name else w.shown end")} as new_name,
    {trim("case when list_contains(a.mask, 'email') then a.email else w.mail end")} as new_email
   from walk w join asked a on a.name = w.name and a.n = w.n + 1))),
replayed as (
 select request_id, name, nullif(gate, 'ok') as gate, fields, texts, request_etag, shown, mail, version from walk where n > 0
 union all
 select request_id, name, 'user', '', '', etag, null, null, null from fx_update where name not in (select name from fx_users))
select request_id, name, gate, {_UPDATE_STATUS},
 case when gate is null then shown end as display_name, case when gate is null then mail end as email,
 case when gate is null then cast(version as integer) end as aggregate_version,
 case when gate is null then {user_etag('name', 'version')} end as etag
from replayed"""

_NEW_FIELDS, _NEW_TEXTS = profile_errors("shown", "mail", "request_uid")
_NEW_ID_FIELDS, _NEW_ID_TEXTS = user_id_errors("replace(name, 'users/', '')")

# In this fixture one uid always asks for one user id, so the first valid request of a name gets both.
UPSERT = f"""with {FX_USERS}, {FX_UPDATE}, {UPDATE_JUDGED},
routed as (
 select *, {trim('request_name')} as shown, {trim('request_email')} as mail,
  case when not (starts_with(name, 'users/') and length(name) between 10 and 69) then 'invalid'
   when cur_uid is null and allow_missing then 'create' else 'update' end as route from judged),
creating as (
 select *, {_NEW_ID_TEXTS} as id_texts, {_NEW_TEXTS} as new_texts,
  min(case when {_NEW_ID_TEXTS} = '' and {_NEW_TEXTS} = '' then (ts, request_id) end) over (partition by name) as granted
 from routed where route = 'create'),
outcomes as (
 select request_id, name, route, gate, cast(case gate when 'user' then 5 when 'etag' then 10 when 'mask' then 3 when 'fields' then 3 else 0 end as integer) as code,
  case when gate is null then cur_uid end as uid, case when gate is null then new_name end as display_name,
  case when gate is null then new_email end as email, case when gate is null then cast(cur_version + 1 as integer) end as aggregate_version
 from routed where route = 'update'
 union all
 select request_id, name, route, 'name', cast(3 as integer), null, null, null, null from routed where route = 'invalid'
 union all
 select request_id, name, route, g, cast(case g when 'uid' then 6 when 'user_id_format' then 3 when 'fields' then 3 else 0 end as integer),
  case when g is null then request_uid end, case when g is null then shown end, case when g is null then mail end,
  case when g is null then cast(1 as integer) end
 from (select *, case when (ts, request_id) > granted then 'uid' when id_texts <> '' then 'user_id_format'
  when new_texts <> '' then 'fields' end as g from creating))
select request_id, name, route, gate, code, uid, display_name, email, aggregate_version,
 case when gate is null then {user_etag('name', 'aggregate_version')} end as etag from outcomes"""


# Histories of several request tables, walked through one user's requests and events at a time.


def _near(ts: str) -> str:
    return f"timestamp '2024-01-01' + to_minutes(cast(18 * date_diff('day', date '1995-01-01', cast({ts} as date)) as integer))"


KNOWN_FIELDS = "['name', 'uid', 'display_name', 'email', 'groups', 'aggregate_version', 'etag']"

NEAR_LOG = f"""{FX_USER_EVENTS.replace('fx_user_events as', 'far_user_events as')},
fx_user_events as (select * replace ({_near('ts')} as ts) from far_user_events),
{USER_LOG}"""

REMOVE_WALK = f"""{FX_USER_EVENTS}, {FX_REMOVE},
steps as (
 select name, {_near('ts')} as ts, event_rank, seq, event_type, group_name, display_name, payload_groups, cast(null as bigint) as request_id from fx_user_events
 union all select user_name, ts, 5, request_id, 'asked', group_name, null, null, request_id from fx_remove),
ordered as (select *, row_number() over (partition by name order by ts, event_rank, seq) as n from steps),
walk as (
 select distinct name, cast(0 as bigint) as n, cast(0 as bigint) as version, cast(null as varchar) as shown, cast([] as varchar[]) as members,
  cast(null as bigint) as request_id, cast(null as varchar) as group_name, cast(null as varchar) as gate from steps
 union all
 select name, n, case when event_type = 'UserCreated' then 1 when version = 0 or gate is not null then version else version + 1 end,
  case when event_type in ('UserCreated', 'UserUpdated') then display_name else shown end,
  case when event_type = 'UserCreated' then [] when version = 0 or gate is not null then members
   when event_type = 'UserUpdated' then [x for x in string_split(payload_groups, ',') if x <> '']
   when event_type in ('GroupRemoved', 'asked') then [x for x in members if x <> group_name] else list_append(members, group_name) end,
  request_id, group_name, gate
 from (select o.*, w.version, w.shown, w.members, case when event_type <> 'asked' then null when w.version = 0 then 'user'
   when not list_contains(w.members, o.group_name) then 'group' end as gate
  from walk w join ordered o on o.name = w.name and o.n = w.n + 1)),
removed as (select *, name as user_name from walk where request_id is not null)"""

UPSERT_REPLAY = f"""with recursive {FX_USERS}, {FX_UPDATE},
ordered as (select *, {trim('display_name')} as own_name, {trim('email')} as own_mail, row_number() over (partition by name order by ts, request_id) as n from fx_update),
judged as (select *, {user_id_errors("replace(name, 'users/', '')")[1]} as id_texts, {profile_errors('own_name', 'own_mail', 'uid')[1]} as own_texts from ordered),
walk as (
 select distinct f.name, cast(0 as bigint) as n, u.uid, coalesce(u.aggregate_version, 0) as version, u.display_name as shown, u.email as mail,
  cast(null as bigint) as request_id, cast(null as varchar) as route, cast(null as varchar) as gate from fx_update f left join fx_users u on f.name = u.name
 union all
 select name, n, case when route = 'create' and gate is null then asked_uid else uid end,
  case when gate is not null then version when route = 'create' then 1 else version + 1 end,
  case when gate is not null then shown when route = 'create' then own_name else new_name end,
  case when gate is not null then mail when route = 'create' then own_mail else new_mail end, request_id, route, gate
 from (
  select *, case route when 'invalid' then 'name' when 'create' then case when id_texts <> '' then 'user_id_format' when own_texts <> '' then 'fields' end
   else case when version = 0 then 'user' when etag <> {user_etag('name', 'version')} then 'etag' when not list_has_all({KNOWN_FIELDS}, mask) then 'mask'
    when {profile_errors('new_name', 'new_mail', 'uid')[1]} <> '' then 'fields' end end as gate
  from (
   select w.name, j.n, w.uid, w.version, w.shown, w.mail, j.request_id, j.uid as asked_uid, j.etag, j.mask, j.id_texts, j.own_texts, j.own_name, j.own_mail,
    {trim("case when list_contains(j.mask, 'display_name') then j.display_name else w.shown end")} as new_name,
    {trim("case when list_contains(j.mask, 'email') then j.email else w.mail end")} as new_mail,
    case when not (starts_with(w.name, 'users/') and length(w.name) between 10 and 69) then 'invalid' when w.version = 0 and j.allow_missing then 'create' else 'update' end as route
   from walk w join judged j on j.name = w.name and j.n = w.n + 1)))
select request_id, name, route, gate,
 cast(case gate when 'user' then 5 when 'etag' then 10 when 'mask' then 3 when 'fields' then 3 when 'name' then 3 when 'user_id_format' then 3 else 0 end as integer) as code,
 case when gate is null then uid end as uid, case when gate is null then shown end as display_name, case when gate is null then mail end as email,
 case when gate is null then cast(version as integer) end as aggregate_version, case when gate is null then {user_etag('name', 'version')} end as etag
from walk where n > 0"""

# Invitations.

DECIDED = f"""{FX_INVITATIONS}, {FX_DECISIONS},
stored as (select name, group_name, ts, {invitation_etag('name', '1')} as etag1, {invitation_etag('name', '2')} as etag2 from fx_invitations),
met as (
 select d.*, s.group_name, s.ts as created_ts, s.etag1, s.etag2,
  min(case when d.etag = s.etag1 then (d.ts, d.request_id) end) over (partition by d.name) as won
 from fx_decisions d left join stored s on d.name = s.name),
replayed as (
 select *, case when etag1 is null then 'invitation'
  when won is null or (ts, request_id) <= won then case when etag = etag1 then null else 'etag' end
  when etag = etag2 then 'state' else 'etag' end as gate from met)"""

_DECISION_COLUMNS = f"""request_id, name, action, gate,
 cast(case gate when 'invitation' then 3 when 'etag' then 10 when 'state' then 9 else 0 end as integer) as code,
 case gate when 'invitation' then '{INVALID}' when 'etag' then 'Concurrency error.' when 'state' then ''
  else 'Group Invitation ' || lower(action) end as message,
 case gate when 'invitation' then 'group' end as violation_fields,
 case gate when 'invitation' then name || ' does not exists.' end as violation_texts,
 case gate when 'etag' then 'Etag is not the latest version.' end as reason,
 case gate when 'etag' then 'providedEtag=' || etag end as detail,
 case gate when 'state' then 'NOT_PENDING' end as precondition,
 case when gate is null then group_name end as group_name, case when gate is null then action end as state,
 case when gate is null then date_trunc('millisecond', created_ts) end as create_time,
 case when gate is null then date_trunc('millisecond', ts) end as update_time,
 case when gate is null then cast(2 as integer) end as aggregate_version, case when gate is null then etag2 end as etag"""

INVITATION_LOG = f"""{DECIDED},
invitation_log as (
 select name, 'GroupInvitationCreated' as event_type, group_name, 'PENDING' as state, ts as create_time, cast(null as timestamp) as update_time,
  cast(1 as integer) as aggregate_version from fx_invitations
 union all
 select name, 'GroupInvitation' || upper(action[1]) || lower(action[2:]), group_name, action, created_ts, date_trunc('millisecond', ts), cast(2 as integer)
 from replayed where gate is null),
invitations_now as (
 select * exclude (back) from (
 select *, row_number() over (partition by name order by aggregate_version desc) as back from invitation_log) where back = 1)"""

INVITATION_INDEX = f"""index_rows as (
 select regexp_extract(name, '(users/[a-z0-9-]+)/groupInvitations/[a-z0-9-]+', 1) as parent, name,
  row_number() over (partition by regexp_extract(name, '(users/[a-z0-9-]+)/groupInvitations/[a-z0-9-]+', 1) order by ts desc, seq desc) as position
 from fx_invitations)"""

CREATE_INVITATIONS = f"""invited as (
 select *, case when group_name not in (select name from fx_groups) then 'group' when parent not in (select name from fx_users) then 'parent' end as gate,
  parent || '/groupInvitations/' || substr(digest, 1, 8) || '-' || substr(digest, 9, 4) || '-' || substr(digest, 13, 4) || '-' ||
   substr(digest, 17, 4) || '-' || substr(digest, 21, 12) as name
 from (select *, sha256(cast(request_id as varchar)) as digest from fx_invite))"""

# Users that create requests make on the way have the names that other requests ask for in vain.
FX_NEWCOMERS = FX_CREATE.replace("'uid-' ||", "'uid-new-' ||").replace("'user-' || cast((user_id * 3 + event_id) % 197 as varchar)", "'none-' || cast(user_id as varchar)")

DIRECTORY = f"""with recursive {CREATE_WALK.replace(FX_CREATE, FX_NEWCOMERS)}, {FX_USERS}, {FX_UPDATE}, {FX_GROUPS}, {FX_INVITE}, {CREATE_INVITATIONS}, {FX_REMOVE}, {DECIDED},
guesses as (
 select request_id, ts, name, display_name, email, case when request_id % 6 = 2 then ['groups'] else mask end as mask,
  case when request_id % 6 = 2 then ['groups/g-' || cast(request_id % 7 as varchar)] else [] end as appended,
  case when request_id % 5 = 0 then '"stale"' else {user_etag('name', '(1 + 13 * (day(ts) - 1) // 30 + request_id % 4)')} end as etag from fx_update),
steps as (
 select name, ts, 1 as rank, request_id as seq, 'create' as kind, uid, display_name as shown, email as mail, null as etag, cast([] as varchar[]) as mask, cast([] as varchar[]) as names
 from created where gate is null
 union all select name, ts, 2, request_id, 'update', null, display_name, email, etag, mask, appended from guesses
 union all select 'users/cust-' || cast(o_custkey as varchar), {_near('o_orderdate')}, 3, o_orderkey, 'join', null, null, null, null, [], ['groups/own-' || cast(o_orderkey as varchar)] from orders
 union all select regexp_extract(name, '(users/[a-z0-9-]+)/groupInvitations/[a-z0-9-]+', 1), {_near('ts')}, 4, row_number() over (), 'join', null, null, null, null, [], [group_name]
 from replayed where gate is null and action = 'ACCEPTED'
 union all select user_name, ts, 5, request_id, 'remove', null, null, null, null, [], [group_name] from fx_remove),
ordered as (select *, row_number() over (partition by name order by ts, rank, seq) as n from steps),
life as (
 select distinct s.name, cast(0 as bigint) as n, u.uid, cast(coalesce(u.aggregate_version, 0) as bigint) as version, u.display_name as shown, u.email as mail,
  cast([] as varchar[]) as members, cast(null as bigint) as request_id, cast('' as varchar) as kind, cast(null as varchar) as gate
 from steps s left join fx_users u on s.name = u.name
 union all
 select name, n, case when kind = 'create' then new_uid else uid end,
  case when kind = 'create' then 1 when version = 0 or gate is not null then version else version + 1 end,
  case when kind in ('create', 'update') and gate is null then new_name else shown end, case when kind in ('create', 'update') and gate is null then new_mail else mail end,
  case when version = 0 or gate is not null then members when kind = 'remove' then [x for x in members if x <> names[1]]
   when kind = 'join' or list_contains(mask, 'groups') then list_concat(members, names) else members end, seq, kind, gate
 from (
  select *, case kind when 'update' then case when version = 0 then 'user' when etag <> {user_etag('name', 'version')} then 'etag'
    when not list_has_all({KNOWN_FIELDS}, mask) then 'mask' when {profile_errors('new_name', 'new_mail', 'uid')[1]} <> '' then 'fields' end
   when 'remove' then case when version = 0 then 'user' when not list_contains(members, names[1]) then 'group' end end as gate
  from (
   select l.name, o.n, l.uid, l.version, l.shown, l.mail, l.members, o.seq, o.kind, o.etag, o.mask, o.names, o.uid as new_uid,
    {trim("case when o.kind = 'create' or list_contains(o.mask, 'display_name') then o.shown else l.shown end")} as new_name,
    {trim("case when o.kind = 'create' or list_contains(o.mask, 'email') then o.mail else l.mail end")} as new_mail
   from life l join ordered o on o.name = l.name and o.n = l.n + 1))),
outcomes as (
 select kind as pipeline, cast(request_id as varchar) as request_id, gate, version as aggregate_version, {user_etag('name', 'version')} as etag
 from life where kind in ('update', 'remove')
 union all select 'create', cast(request_id as varchar), gate, 1, {user_etag('name', '1')} from created
 union all select 'invite', cast(i.request_id as varchar), case when i.gate = 'group' then 'group' when u.name is null and (c.ts is null or c.ts > i.ts) then 'parent' end, 1,
  {invitation_etag('i.name', '1')} from invited i left join fx_users u on i.parent = u.name left join (select * from created where gate is null) c on c.name = i.parent
 union all select 'decide', request_id, gate, 2, etag2 from replayed)
select pipeline, request_id, gate, cast(case when gate is null then 0
  when gate = 'etag' then 10 when gate = 'state' then 9 when gate in ('uid', 'user_id') then 6
  when gate = 'user' or pipeline = 'remove' then 5 else 3 end as integer) as code,
 case when gate is null then cast(aggregate_version as integer) end as aggregate_version, case when gate is null then etag end as etag from outcomes"""

_READ_USER = """cast(case gate when 'uid' then 5 when 'name' then 3 when 'user' then 5 else 0 end as integer) as code"""


def _seen(key: str, kept: str) -> str:
    return f"""select {key}, ts, request_id, row_number() over (partition by {key} order by ts, request_id) as value from created where {kept}"""


_REACHED_ID = "(gate is null or gate in ('user_id', 'fields'))"

LAST_WRITES = f"""with recursive {CREATE_WALK},
writes as (
 select 'uid' as kind, uid as key, value, ts, request_id, 0 as step from ({_seen('uid', 'true')})
 union all select 'uid', uid, 0, ts, request_id, 1 from created where gate in ('user_id_format', 'user_id', 'fields')
 union all select 'user_id', user_id, value, ts, request_id, 0 from ({_seen('user_id', _REACHED_ID)})
 union all select 'user_id', user_id, 0, ts, request_id, 1 from created where gate = 'fields')
select kind, key, cast(value as bigint) as value from (
 select *, row_number() over (partition by kind, key order by ts desc, request_id desc, step desc) as back from writes) where back = 1"""


def oracle_sql() -> dict[str, str]:
    id_fields, id_texts = user_id_errors("user_id")
    fields, texts = profile_errors("display_name", "email", "uid")
    trimmed = f"(select * replace ({trim('display_name')} as display_name, {trim('email')} as email) from fx_create)"
    user_changelog = f"""with {FX_USER_EVENTS}, {USER_LOG}"""
    queries = {
        "etag_user": f"with {FX_USERS} select name, aggregate_version, etag from fx_users",
        "parent_name": f"""with {FX_INVITATIONS} select name,
 regexp_extract(name, '(users/[a-z0-9-]+)/groupInvitations/[a-z0-9-]+', 1) as parent from fx_invitations""",
        "trimmed_profile": f"""with {FX_CREATE} select request_id, display_name, email,
 cast(length(display_name) as integer) as display_units from {trimmed}""",
        "user_id_rules": f"""with {FX_CREATE} select request_id, user_id, {id_fields} as violation_fields,
 {id_texts} as violation_texts from fx_create""",
        "profile_rules": f"""with {FX_CREATE} select request_id, {fields} as violation_fields, {texts} as violation_texts from {trimmed}""",
        "mask_clean_merge": f"""with {FX_USERS}, {FX_UPDATE}, {UPDATE_JUDGED}
select request_id, array_to_string(list_sort(mask), ',') as clean_mask,
 list_has_all(['name', 'uid', 'display_name', 'email', 'groups', 'aggregate_version', 'etag'], mask) as mask_known,
 new_name as display_name, new_email as email from judged where cur_uid is not null""",
        "page_tokens": f"""with {FX_LOOKUP} select request_id, to_base64(encode(cast(page_offset as varchar))) as page_token,
 cast(page_offset as integer) as page_offset from fx_lookup""",
        "gate_route_counts": f"""with {FX_USERS}, {FX_UPDATE}, {UPDATE_JUDGED}
select coalesce(gate, 'passed') as gate, count(*) as requests from judged group by 1""",
        "uid_running_count": f"with recursive {CREATE_WALK} {_seen('uid', 'true')}",
        "user_id_running_count": f"with recursive {CREATE_WALK} {_seen('user_id', _REACHED_ID)}",
        "last_write_table": LAST_WRITES,
        "create_user_outcomes": CREATE_OUTCOMES,
        "user_created_events": f"""with recursive {CREATE_WALK}
select name, 'UserCreated' as event_type, request_id as seq, uid, display_name, email from created where gate is null""",
        "update_user_snapshot": UPDATE_SNAPSHOT,
        "update_user_replay": UPDATE_REPLAY,
        "remove_group_outcomes": f"""with {FX_USER_EVENTS}, {USER_LOG}, {USER_GROUPS}, {FX_REMOVE},
held as (select name, group_name, count(*) as equal from groups_now group by 1, 2),
sizes as (select name, count(*) as total from groups_now group by 1),
judged as (select r.*, u.aggregate_version as v, u.display_name, h.equal, s.total,
  case when u.name is null then 'user' when h.equal is null then 'group' end as gate
 from fx_remove r left join user_now u on r.user_name = u.name left join held h on r.user_name = h.name and r.group_name = h.group_name
 left join sizes s on r.user_name = s.name)
select request_id, user_name, group_name, gate, cast(case when gate is null then 0 else 5 end as integer) as code,
 case gate when 'user' then 'User with name ' || user_name || ' does not exists.'
  when 'group' then 'Group with name ' || group_name || ' does not exists.' else 'Group removed.' end as message,
 case when gate is null then display_name end as display_name, case when gate is null then total - equal end as groups_left,
 case when gate is null then cast(v + 1 as integer) end as aggregate_version,
 case when gate is null then {user_etag('user_name', '(v + 1)')} end as etag from judged""",
        "remove_group_replay": f"""with recursive {REMOVE_WALK}
select request_id, user_name, group_name, gate, cast(case when gate is null then 0 else 5 end as integer) as code,
 case gate when 'user' then 'User with name ' || user_name || ' does not exists.'
  when 'group' then 'Group with name ' || group_name || ' does not exists.' else 'Group removed.' end as message,
 case when gate is null then shown end as display_name, case when gate is null then cast(len(members) as bigint) end as groups_left,
 case when gate is null then cast(version as integer) end as aggregate_version, case when gate is null then {user_etag('user_name', 'version')} end as etag from removed""",
        "upsert_replay": UPSERT_REPLAY,
        "directory_replay": DIRECTORY,
        "remove_group_items": f"""with {FX_USER_EVENTS}, {USER_LOG}, {USER_GROUPS}, {FX_REMOVE},
passed as (select r.* from fx_remove r where (r.user_name, r.group_name) in (select (name, group_name) from groups_now))
select p.request_id, row_number() over (partition by p.request_id order by g.position) as position, g.group_name
from passed p join groups_now g on p.user_name = g.name and p.group_name <> g.group_name""",
        "membership_from_invitations": f"""with {DECIDED}
select regexp_extract(name, '(users/[a-z0-9-]+)/groupInvitations/[a-z0-9-]+', 1) as name, group_name, count(*) as times
from replayed where gate is null and action = 'ACCEPTED' group by 1, 2""",
        "membership_from_groups": """select 'users/cust-' || cast(o_custkey as varchar) as name, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as position,
 'groups/own-' || cast(o_orderkey as varchar) as group_name from orders""",
        "create_invitation_outcomes": f"""with {FX_USERS}, {FX_GROUPS}, {FX_INVITE}, {CREATE_INVITATIONS}
select request_id, parent, group_name, gate, cast(case when gate is null then 0 else 3 end as integer) as code,
 case when gate is null then 'Group Invitation created.' else '{INVALID}' end as message, gate as violation_fields,
 case gate when 'group' then group_name || ' does not exists.' when 'parent' then parent || ' does not exists.' end as violation_texts,
 case when gate is null then name end as name, case when gate is null then 'PENDING' end as state,
 case when gate is null then date_trunc('millisecond', ts) end as create_time,
 case when gate is null then cast(1 as integer) end as aggregate_version,
 case when gate is null then {invitation_etag('name', '1')} end as etag from invited""",
        "decide_invitation_snapshot": f"""with {DECIDED}
select {_DECISION_COLUMNS} from (select * replace (case when etag1 is null then 'invitation' when etag <> etag1 then 'etag' end as gate) from replayed)""",
        "decide_invitation_replay": f"with {DECIDED} select {_DECISION_COLUMNS} from replayed",
        "upsert_routes": UPSERT,
        "user_history": f"""{user_changelog} select name, ts, seq, event_type, epoch, aggregate_version, display_name,
 case when aggregate_version is not null then {user_etag('name', 'aggregate_version')} end as etag from user_versions""",
        "user_snapshot": f"{user_changelog} select name, display_name, aggregate_version, etag from user_now",
        "changelog_table": f"{user_changelog} select name, display_name, aggregate_version, etag from user_now",
        "user_groups": f"""{user_changelog}, {USER_GROUPS} select name, position, group_name, ts as since_ts, seq as since_seq from groups_now""",
        "group_spans": f"""{user_changelog}, {USER_GROUPS}
select name, group_name, ts as since_ts, cast(event_rank as integer) as since_rank, seq as since_seq, cast(ordinal as integer) as ordinal,
 case when reset_at is null or removed_at < reset_at then removed_at[1] else reset_at[1] end as until_ts,
 cast(case when reset_at is null or removed_at < reset_at then removed_at[2] else reset_at[2] end as integer) as until_rank,
 case when reset_at is null or removed_at < reset_at then removed_at[3] else reset_at[3] end as until_seq from spans""",
        "invitation_history": f"""with {INVITATION_LOG} select name, event_type, group_name, state, create_time, update_time,
 aggregate_version, {invitation_etag('name', 'aggregate_version')} as etag from invitation_log""",
        "invitation_snapshot": f"""with {INVITATION_LOG} select name, group_name, state, create_time, update_time,
 aggregate_version, {invitation_etag('name', 'aggregate_version')} as etag from invitations_now""",
        "invitation_index": f"with {FX_INVITATIONS}, {INVITATION_INDEX} select parent, position, name from index_rows",
        "uid_name_map": f"""with recursive {CREATE_WALK} select uid, name from (
 select *, row_number() over (partition by uid order by ts desc, request_id desc) as back from created where gate is null) where back = 1""",
        "get_user": f"""with {FX_USERS}, {FX_LOOKUP}
select request_id, name, gate, {_READ_USER}, case gate when 'name' then name || ' is not a valid name format.'
  when 'user' then name || ' does not exists.' else '' end as message, uid, display_name, email, aggregate_version, etag from (
 select l.request_id, l.name, case when not (starts_with(l.name, 'users/') and length(l.name) between 10 and 69) then 'name'
  when u.name is null then 'user' end as gate, u.uid, u.display_name, u.email, u.aggregate_version, u.etag
 from fx_lookup l left join fx_users u on l.name = u.name)""",
        "find_user": f"""with {FX_USERS}, {FX_LOOKUP}
select request_id, asked_uid, name, gate, {_READ_USER}, case gate when 'uid' then 'Uid ' || asked_uid || ' does not exists.'
  when 'name' then name || ' is not a valid name format.' else '' end as message, uid, display_name, email, aggregate_version, etag from (
 select l.request_id, l.uid as asked_uid, u.name, case when u.name is null then 'uid'
  when not (starts_with(u.name, 'users/') and length(u.name) between 10 and 69) then 'name' end as gate,
  u.uid, u.display_name, u.email, u.aggregate_version, u.etag
 from fx_lookup l left join fx_users u on l.uid = u.uid)""",
        "get_user_groups": f"""{user_changelog}, {USER_GROUPS}, {FX_LOOKUP}
select name, position, group_name from groups_now where name in (
 select name from fx_lookup where starts_with(name, 'users/') and length(name) between 10 and 69)""",
        "list_invitations": f"""with {INVITATION_LOG}, {INVITATION_INDEX}, {FX_LOOKUP}
select l.request_id, i.parent, i.position, i.name, n.group_name, n.state, n.aggregate_version,
 {invitation_etag('n.name', 'n.aggregate_version')} as etag
from fx_lookup l join index_rows i on i.parent = l.name and i.position > l.page_offset and i.position <= l.page_offset + l.page_size
join invitations_now n on n.name = i.name""",
        "list_invitation_pages": f"""with {FX_INVITATIONS}, {INVITATION_INDEX}, {FX_LOOKUP},
sizes as (select parent, count(*) as total from index_rows group by 1)
select l.request_id, l.name as parent, case when total is null then 'index' end as gate,
 cast(case when total is null then 5 else 0 end as integer) as code,
 case when total is null then 'No group invitations for user ' || l.name || '.' else '' end as message, total,
 case when total is null then null when page_offset + page_size < total
  then to_base64(encode(cast(page_offset + page_size as varchar))) else '' end as next_page_token
from fx_lookup l left join sizes s on l.name = s.parent""",
        "unnamed_parents": """select 'people/' || cast(o_custkey as varchar) || '/groupInvitations/inv-' || cast(o_orderkey as varchar) as name,
 'groups/g-' || cast(o_orderkey % 7 as varchar) as group_name from orders where o_orderstatus = 'P'""",
        "laid_out_tables": f"""{user_changelog}
select u.name, display_name, aggregate_version, etag, events from user_now u join (select name, count(*) as events from fx_user_events group by name) using (name)""",
        "malformed_requests": f"""with {FX_CREATE} select case when request_id % 7 in (1, 2) then 'malformed' else 'request' end as kind, cast(request_id as varchar) as key,
 case when request_id % 7 not in (1, 2) then uid end as uid, ts from fx_create""",
        "groups_at_version": f"""with {NEAR_LOG}, {USER_GROUPS}, {FX_LOOKUP},
places as (select l.request_id, v.name, v.ts, v.event_rank, v.seq, v.aggregate_version from fx_lookup l join user_versions v
 on l.name = v.name and v.epoch = 1 and v.aggregate_version = 1 + l.request_id % 12)
select p.request_id, p.name, p.aggregate_version, row_number() over (partition by p.request_id order by s.ts, s.event_rank, s.seq, s.ordinal) as position, s.group_name
from places p join spans s on p.name = s.name and (s.ts, s.event_rank, s.seq) <= (p.ts, p.event_rank, p.seq)
 and (s.reset_at is null or (p.ts, p.event_rank, p.seq) < s.reset_at) and (s.removed_at is null or (p.ts, p.event_rank, p.seq) < s.removed_at)""",
        "user_as_of": f"""with {NEAR_LOG}, {FX_LOOKUP},
seen as (select l.request_id, l.name, v.display_name, v.aggregate_version, row_number() over (partition by l.request_id order by v.ts desc, v.event_rank desc, v.seq desc) as back
 from fx_lookup l left join user_versions v on v.name = l.name and v.epoch > 0 and v.ts <= l.ts)
select request_id, name, display_name, aggregate_version, case when aggregate_version is not null then {user_etag('name', 'aggregate_version')} end as etag from seen where back = 1""",
        "orphan_events": f"{user_changelog} select name, ts, seq, event_type from user_versions where epoch = 0",
        "event_sinks": f"""with recursive {CREATE_WALK}, {FX_USERS}, {FX_UPDATE}, {UPDATE_JUDGED}, {FX_GROUPS}, {FX_INVITE},
{CREATE_INVITATIONS}, {FX_USER_EVENTS}, {USER_LOG}, {USER_GROUPS}, {FX_REMOVE}, {DECIDED}
select 'UserCreated' as event_type, name, ts, request_id as seq, '' as group_name, display_name, email, '' as state from created where gate is null
union all select 'UserUpdated', name, ts, request_id, '', new_name, new_email, '' from judged where gate is null
union all select 'GroupRemoved', user_name, ts, request_id, group_name, '', '', '' from fx_remove r
 where (r.user_name, r.group_name) in (select (name, group_name) from groups_now)
union all select 'GroupInvitationCreated', name, ts, request_id, group_name, '', '', 'PENDING' from invited where gate is null
union all select 'GroupInvitation' || upper(action[1]) || lower(action[2:]), name, ts, 0, group_name, '', '', action from replayed where gate is null""",
        "response_sinks": f"""select 'create_user' as pipeline, cast(request_id as varchar) as request_id, gate, code, message, coalesce(violation_fields, '') as violation_fields from ({CREATE_OUTCOMES})
union all select 'update_user', cast(request_id as varchar), gate, code, message, coalesce(violation_fields, '') from ({UPDATE_SNAPSHOT})
union all select 'remove_group', cast(request_id as varchar), gate, code, message, '' from (__REMOVED__)
union all select 'create_invitation', cast(request_id as varchar), gate, code, message, coalesce(violation_fields, '') from (__INVITED__)
union all select lower(action[:6]) || '_invitation', request_id, gate, code, message, coalesce(violation_fields, '') from (with {DECIDED} select {_DECISION_COLUMNS} from replayed)""",
    }
    queries["response_sinks"] = (queries["response_sinks"].replace("__REMOVED__", queries["remove_group_outcomes"])
                                 .replace("__INVITED__", queries["create_invitation_outcomes"]))
    queries["stream_event_sinks"] = f"""select 'UserCreated' as event_type, name, ts, '' as group_name, display_name, email, '' as state
 from (with recursive {CREATE_WALK} select * from created where gate is null)
union all select 'UserUpdated', u.name, f.ts, '', u.display_name, u.email, '' from ({UPDATE_REPLAY}) u join (with {FX_UPDATE} select * from fx_update) f using (request_id) where u.gate is null
union all select 'GroupRemoved', r.user_name, f.ts, r.group_name, '', '', '' from ({queries['remove_group_outcomes']}) r join (with {FX_REMOVE} select * from fx_remove) f using (request_id) where r.gate is null
union all select 'GroupInvitation' || upper(action[1]) || lower(action[2:]), name, ts, group_name, '', '', action from (with {DECIDED} select * from replayed where gate is null)
union all select 'Released uid', uid, ts, '', '', '', '' from (with recursive {CREATE_WALK} select * from created where gate in ('user_id_format', 'user_id', 'fields'))
union all select 'Released user_id', user_id, ts, '', '', '', '' from (with recursive {CREATE_WALK} select * from created where gate = 'fields')"""
    queries["stream_user_fold"] = queries["user_snapshot"]
    queries["stream_remove_replay"] = f"select request_id, gate, groups_left, aggregate_version, etag from ({queries['remove_group_replay']})"
    queries["stream_user_state"] = queries["user_snapshot"]
    queries["stream_uid_counts"] = f"with {FX_CREATE} select uid, count(*) as value from fx_create group by uid"
    queries["stream_multi_sink"] = f"""with {FX_USERS}, {FX_GROUPS}, {FX_INVITE}, {CREATE_INVITATIONS}
select request_id, gate, cast(case when gate is null then 0 else 3 end as integer) as code,
 case when gate is null then name end as event_name from invited"""
    queries["stream_uid_map"] = queries["uid_name_map"]
    queries["stream_update_users"] = f"select request_id, gate, aggregate_version from ({UPDATE_REPLAY})"
    queries["stream_decide_invitations"] = f"with {DECIDED} select request_id, gate, case when gate is null then action end as state from replayed"
    queries["stream_remove_groups"] = f"select request_id, gate, code, aggregate_version from ({queries['remove_group_outcomes']})"
    queries["stream_invitation_fold"] = queries["invitation_snapshot"]
    queries["stream_invitation_index"] = queries["invitation_index"]
    queries["stream_user_groups"] = f"select name, position, group_name from ({queries['user_groups']})"
    queries["stream_create_users"] = f"""with recursive {CREATE_WALK} select request_id, uid, user_id, gate from created"""
    return queries
