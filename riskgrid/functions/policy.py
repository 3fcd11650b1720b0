"""UI policy rules (P1-P8) as boolean column expressions.

The rules are two-valued: a missing hazard or a NULL comparison is "no".
Role and status are compared ignoring case (not trimmed), as the policy does.
Inputs are column names or Columns of one row = (viewer, hazard):
``role``, ``uid`` (viewer id), ``reporter``, ``assignee``, ``status`` and
``exists`` (the hazard row was found).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import schemas as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_role(role, name: str) -> Column:
    return F.coalesce(F.lower(_c(role)) == F.lit(name.lower()), F.lit(False))


def is_status(status, name: str) -> Column:
    return F.lower(F.coalesce(_c(status), F.lit(""))) == F.lit(name.lower())


def is_known_status(status) -> Column:
    return (is_status(status, S.STATUS_OPEN) | is_status(status, S.STATUS_IN_PROGRESS)
            | is_status(status, S.STATUS_RESOLVED))


def _same(a, b) -> Column:
    return F.coalesce(_c(a) == _c(b), F.lit(False))


def can_view(role, uid, reporter, assignee, status, exists) -> Column:
    officer = is_role(role, S.ROLE_SAFETY_OFFICER)
    worker = is_role(role, S.ROLE_FIELD_WORKER) & (_same(reporter, uid) | _same(assignee, uid))
    manager = is_role(role, S.ROLE_SITE_MANAGER) & (
        _same(assignee, uid) | _same(reporter, uid)
        | (_c(assignee).isNull() & is_status(status, S.STATUS_OPEN)))
    return _c(exists) & (officer | worker | manager)


def can_edit_details(role, uid, reporter, assignee, status, exists) -> Column:
    officer = is_role(role, S.ROLE_SAFETY_OFFICER)
    worker = is_role(role, S.ROLE_FIELD_WORKER) & _same(reporter, uid) & _c(assignee).isNull() \
        & is_status(status, S.STATUS_OPEN)
    manager = is_role(role, S.ROLE_SITE_MANAGER) & (_same(assignee, uid) | _same(reporter, uid))
    return can_view(role, uid, reporter, assignee, status, exists) & (officer | worker | manager)


def can_self_assign(role, assignee, status, exists) -> Column:
    return (_c(exists) & is_role(role, S.ROLE_SITE_MANAGER) & _c(assignee).isNull()
            & is_status(status, S.STATUS_OPEN))


def can_assign_to_other(role) -> Column:
    return is_role(role, S.ROLE_SAFETY_OFFICER)


def can_change_status(role, uid, reporter, assignee, status, exists, new_status) -> Column:
    # A plain string is a status value; pass F.col(...) for a status column.
    ns = F.lit(new_status) if isinstance(new_status, str) else new_status
    officer = is_role(role, S.ROLE_SAFETY_OFFICER) & is_known_status(ns)
    manager = is_role(role, S.ROLE_SITE_MANAGER) & _same(assignee, uid) & (
        (is_status(status, S.STATUS_OPEN) & is_status(ns, S.STATUS_IN_PROGRESS))
        | (is_status(status, S.STATUS_IN_PROGRESS) & is_status(ns, S.STATUS_RESOLVED)))
    return can_view(role, uid, reporter, assignee, status, exists) & (officer | manager)


def allowed_next_statuses(role, uid, assignee, status, exists) -> Column:
    empty = F.array().cast("array<string>")
    manager_next = (F.when(is_status(status, S.STATUS_OPEN), F.array(F.lit(S.STATUS_IN_PROGRESS)))
                    .when(is_status(status, S.STATUS_IN_PROGRESS), F.array(F.lit(S.STATUS_RESOLVED)))
                    .otherwise(empty))
    return (F.when(~_c(exists), empty)
            .when(is_role(role, S.ROLE_SAFETY_OFFICER), F.array(*[F.lit(s) for s in S.STATUSES]))
            .when(is_role(role, S.ROLE_SITE_MANAGER) & _same(assignee, uid), manager_next)
            .otherwise(empty))


def can_add_comment(role) -> Column:
    return (is_role(role, S.ROLE_FIELD_WORKER) | is_role(role, S.ROLE_SITE_MANAGER)
            | is_role(role, S.ROLE_SAFETY_OFFICER))


def row_actions(role, uid, reporter, assignee, status, exists) -> dict[str, Column]:
    """Take / Start / Resolve buttons of the list."""
    return {
        "can_take": can_self_assign(role, assignee, status, exists),
        "can_start": can_change_status(role, uid, reporter, assignee, status, exists, S.STATUS_IN_PROGRESS),
        "can_resolve": can_change_status(role, uid, reporter, assignee, status, exists, S.STATUS_RESOLVED),
    }
