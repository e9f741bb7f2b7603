"""The rules of the domain applied one record at a time; the yardstick of the property tests."""

from __future__ import annotations

import hashlib
import re


def user_etag(name: str, version: int) -> str:
    return '"' + hashlib.sha256(f"eb659ae2-{name}-{version}".encode()).hexdigest() + '"'


def invitation_etag(name: str, version: int) -> str:
    return '"' + hashlib.sha256(f"999a4c02-{name}-{version}".encode()).hexdigest() + '"'


def units(text: str) -> int:
    return len(text.encode("utf-16-be")) // 2


BLANK = "".join(chr(c) for c in range(33))


def user_id_ok(user_id: str) -> bool:
    return 4 <= units(user_id) <= 63 and not re.search("[^a-z0-9-]", user_id)


def profile_ok(display_name: str, email: str, uid: str) -> bool:
    return 4 <= units(display_name) <= 120 and email != "" and uid != ""


def create_users(requests, held=()):
    """gate by request id; requests are (request_id, ts, uid, user_id, display_name, email)."""
    uids, ids, gates = {u for u, _ in held}, {i for _, i in held}, {}
    for rid, _, uid, user_id, display_name, email in sorted(requests, key=lambda r: (r[1], r[0])):
        if uid in uids:
            gates[rid] = "uid"
        elif not user_id_ok(user_id):
            gates[rid] = "user_id_format"
        elif user_id in ids:
            gates[rid] = "user_id"
        elif not profile_ok(display_name.strip(BLANK), email.strip(BLANK), uid):
            gates[rid] = "fields"
        else:
            gates[rid] = None
            uids.add(uid)
            ids.add(user_id)
    return gates


KNOWN = {"name", "uid", "display_name", "email", "groups", "aggregate_version", "etag"}
FIXED = {"uid", "name", "aggregate_version", "etag"}


def replay_updates(users, requests):
    """(gate, display_name, email, version) by request id.

    users: name -> (uid, display_name, email, version); requests are
    (request_id, ts, name, etag, mask, display_name, email).
    """
    state, out = dict(users), {}
    for rid, _, name, etag, mask, display_name, email in sorted(requests, key=lambda r: (r[1], r[0])):
        if name not in state:
            out[rid] = ("user", None, None, None)
            continue
        uid, shown, mail, version = state[name]
        paths = set(mask) - FIXED
        shown = (display_name if "display_name" in paths else shown).strip(BLANK)
        mail = (email if "email" in paths else mail).strip(BLANK)
        if etag != user_etag(name, version):
            out[rid] = ("etag", None, None, None)
        elif not paths <= KNOWN:
            out[rid] = ("mask", None, None, None)
        elif not profile_ok(shown, mail, uid):
            out[rid] = ("fields", None, None, None)
        else:
            state[name] = (uid, shown, mail, version + 1)
            out[rid] = (None, shown, mail, version + 1)
    return out


USER_EVENT_TYPES = ["UserCreated", "UserUpdated", "GroupCreated", "GroupInvitationAccepted", "GroupRemoved"]


def event_place(event):
    return event[0], 1 + USER_EVENT_TYPES.index(event[3]), event[1]


def fold_users(events):
    """History rows (name, seq) -> (version, display_name) and, per name, the group list after each event.

    events are (ts, seq, name, event_type, group_name, display_name, groups, added_groups).
    """
    state, history, lists = {}, {}, {}
    for _, seq, name, kind, group, shown, groups, added in sorted(events, key=event_place):
        current = state.get(name)
        if kind == "UserCreated":
            current = (1, shown, list(groups or []) + list(added or []))
        elif current is None:
            history[name, seq] = (None, None)
            continue
        else:
            version, now, members = current
            if kind == "UserUpdated":
                members = (list(groups) if groups is not None else list(members)) + list(added or [])
                now = shown
            elif kind == "GroupRemoved":
                members = [g for g in members if g != group]
            else:
                members = [*members, group]
            current = (version + 1, now, members)
        state[name] = current
        history[name, seq] = current[:2]
        lists.setdefault(name, []).append((seq, current[2]))
    return history, lists


def replay_decisions(invitations, requests):
    """gate by request id. invitations: name -> (state, version); requests (id, ts, name, etag, action)."""
    state, gates = dict(invitations), {}
    for rid, _, name, etag, action in sorted(requests, key=lambda r: (r[1], r[0])):
        if name not in state:
            gates[rid] = "invitation"
        elif etag != invitation_etag(name, state[name][1]):
            gates[rid] = "etag"
        elif state[name][0] != "PENDING":
            gates[rid] = "state"
        else:
            state[name] = (action, state[name][1] + 1)
            gates[rid] = None
    return gates


def name_ok(name):
    return name.startswith("users/") and 10 <= units(name) <= 69


def replay_upserts(users, requests):
    """(route, gate, version) by request id; users: name -> (uid, display_name, email, version); requests are
    (request_id, ts, name, uid, etag, mask, display_name, email, allow_missing)."""
    state, uids, out = dict(users), {u[0] for u in users.values()}, {}
    for rid, ts, name, uid, etag, mask, shown, mail, allowed in sorted(requests, key=lambda r: (r[1], r[0])):
        if not name_ok(name):
            out[rid] = ("invalid", "name", None)
        elif name not in state and allowed:
            user_id = name.replace("users/", "")
            gate = ("uid" if uid in uids else "user_id_format" if not user_id_ok(user_id)
                    else "fields" if not profile_ok(shown.strip(BLANK), mail.strip(BLANK), uid) else None)
            out[rid] = ("create", gate, None if gate else 1)
            if gate is None:
                state[name] = (uid, shown.strip(BLANK), mail.strip(BLANK), 1)
                uids.add(uid)
        else:
            outcome = replay_updates(state, [(rid, ts, name, etag, mask, shown, mail)])[rid]
            out[rid] = ("update", outcome[0], outcome[3])
            if outcome[0] is None:
                state[name] = (state[name][0], *outcome[1:])
    return out


class Directory:
    """The whole service, one request at a time."""

    def __init__(self, users, groups, pending):
        """users: name -> (uid, display_name, email, version, groups); groups: known names; pending: invitation name -> group."""
        self.users = {n: [*u[:4], list(u[4])] for n, u in users.items()}
        self.uids, self.groups = {u[0] for u in users.values()}, set(groups)
        self.invitations = {n: [g, "PENDING", 1] for n, g in pending.items()}

    def create(self, uid, user_id, shown, mail):
        name, shown, mail = f"users/{user_id}", shown.strip(BLANK), mail.strip(BLANK)
        if uid in self.uids:
            return "uid", None
        if not user_id_ok(user_id):
            return "user_id_format", None
        if name in self.users:
            return "user_id", None
        if not profile_ok(shown, mail, uid):
            return "fields", None
        self.users[name] = [uid, shown, mail, 1, []]
        self.uids.add(uid)
        return None, 1

    def update(self, name, etag, mask, shown, mail, groups):
        if name not in self.users:
            return "user", None
        user, paths = self.users[name], set(mask) - FIXED
        if etag != user_etag(name, user[3]):
            return "etag", None
        if not paths <= KNOWN:
            return "mask", None
        shown = (shown if "display_name" in paths else user[1]).strip(BLANK)
        mail = (mail if "email" in paths else user[2]).strip(BLANK)
        if not profile_ok(shown, mail, user[0]):
            return "fields", None
        user[1:] = [shown, mail, user[3] + 1, user[4] + (list(groups) if "groups" in paths else [])]
        return None, user[3]

    def make(self, group, owner):
        self.groups.add(group)
        self._join(owner, group)

    def _join(self, name, group):
        if name in self.users:
            self.users[name][3] += 1
            self.users[name][4].append(group)

    def remove(self, name, group):
        if name not in self.users:
            return "user", None, None
        user = self.users[name]
        if group not in user[4]:
            return "group", None, None
        user[3:] = [user[3] + 1, [g for g in user[4] if g != group]]
        return None, user[3], len(user[4])

    def invite(self, name, parent, group):
        if group not in self.groups:
            return "group", None
        if parent not in self.users:
            return "parent", None
        self.invitations[name] = [group, "PENDING", 1]
        return None, 1

    def decide(self, name, etag, action):
        if name not in self.invitations:
            return "invitation", None
        invitation = self.invitations[name]
        if etag != invitation_etag(name, invitation[2]):
            return "etag", None
        if invitation[1] != "PENDING":
            return "state", None
        invitation[1:] = [action, 2]
        if action == "ACCEPTED":
            self._join(re.search("(users/[a-z0-9-]+)/groupInvitations/[a-z0-9-]+", name)[1], invitation[0])
        return None, 2
