"""Texts of statuses and violations."""

# Callers compare these texts, so wording and punctuation stay as they are.

# Success
USER_CREATED = "User created."
USER_UPDATED = "User updated."
GROUP_REMOVED = "Group removed."
INVITATION_CREATED = "Group Invitation created."
INVITATION_ACCEPTED = "Group Invitation accepted"
INVITATION_REJECTED = "Group Invitation rejected"

# Refusals; %s is the name or id at fault
INVALID = "Request contain invalid arguments. See details for more information."
UID_EXISTS = "User already exists."
UID_EXISTS_REASON = "User with uid %s already exists."
USER_ID_TAKEN = "User Id is taken."
USER_ID_TAKEN_REASON = "User with user id %s already exists."
NO_USER = "User with name %s does not exists."
NO_GROUP = "Group with name %s does not exists."
NOT_THERE = "%s does not exists."
NO_UID = "Uid %s does not exists."
NO_INVITATIONS = "No group invitations for user %s."
BAD_NAME = "%s is not a valid name format."
STALE = "Concurrency error."
STALE_REASON = "Etag is not the latest version."
NOT_PENDING = "Group invitation is not in pending state."
BAD_MASK = "Unable to map update_mask to User type."
BAD_PAGE_SIZE = "Page size must be positive."

# Field rules; %s is the label of the field, %d its bound
EMPTY = "%s must not be empty."
TOO_SHORT = "%s must has minimum %d characters."
TOO_LONG = "%s must has maximum %d characters."
BAD_ALPHABET = "User Id can only contain lower case letter, digit, and hyphen."
USER_ID_LABEL = "User Id"
DISPLAY_NAME_LABEL = "User display name"
EMAIL_LABEL = "User email"
UID_LABEL = "User uid"
