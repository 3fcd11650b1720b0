"""Row scoping: which hazards a user may see (V1-V3).

* ``scope`` is one viewer's filter. The role is a Python value, so the role
  branch is chosen on the driver and the predicate that reaches Catalyst is a
  plain, pushable filter.
* ``access_flags`` is the batch form of the accessibility function: a table of
  (hazard_id, user_id, role) requests joined to the hazards once.
* ``visible_grants`` is the scope of every active user at once. The set of
  (user, hazard) pairs is quadratic (every manager sees every unassigned Open
  hazard), so it is never materialised: each hazard yields at most two
  "related" edges (reporter, assignee), and officers and managers carry one
  grant row each that stands for "all hazards" and "the unassigned-Open pool".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import schemas as S

GRANT_ALL = "all"
GRANT_POOL = "pool"
GRANT_RELATED = "related"


def canonical_role_value(role: str | None) -> str:
    """Python twin of the SQL role normalisation: trimmed, NULL -> '',
    compared ignoring case."""
    r = (role or "").strip(" ")
    for known in S.ROLES:
        if r.lower() == known.lower():
            return known
    return r


def in_pool(assignee: Column | str = "assigned_to_user_id", status: Column | str = "status") -> Column:
    """Unassigned and Open: visible to every site manager."""
    a = F.col(assignee) if isinstance(assignee, str) else assignee
    s = F.col(status) if isinstance(status, str) else status
    return a.isNull() & (s == F.lit(S.STATUS_OPEN))


def scope_predicate(user_id: int, role: str | None) -> Column:
    role = canonical_role_value(role)
    uid = F.lit(user_id)
    rep, asg = F.col("reported_by_user_id"), F.col("assigned_to_user_id")
    if role == S.ROLE_SAFETY_OFFICER:
        return F.lit(True)
    if role == S.ROLE_FIELD_WORKER:
        return (rep == uid) | (asg == uid)
    if role == S.ROLE_SITE_MANAGER:
        return (asg == uid) | (rep == uid) | in_pool()
    return F.lit(False)


def scope(hazards: DataFrame, user_id: int, role: str | None) -> DataFrame:
    """V1: the hazards one viewer may see."""
    return hazards.where(scope_predicate(user_id, role))


def access_expr(role: Column, uid: Column, reporter: Column, assignee: Column, status: Column) -> Column:
    """Accessibility of one (hazard, user, role) row after a left join to the
    hazard (reporter is NULL when the hazard is missing). Officers pass before
    the hazard is looked at, so a missing hazard id is accessible to them."""
    r = T.canonical_role(T.trim_or_empty(role))
    related_worker = (reporter == uid) | (assignee == uid)
    related_manager = (assignee == uid) | (reporter == uid) | ((status == F.lit(S.STATUS_OPEN)) & assignee.isNull())
    return (F.when(r == F.lit(S.ROLE_SAFETY_OFFICER), F.lit(True))
            .when(reporter.isNull(), F.lit(False))
            .when(r == F.lit(S.ROLE_FIELD_WORKER), F.coalesce(related_worker, F.lit(False)))
            .when(r == F.lit(S.ROLE_SITE_MANAGER), F.coalesce(related_manager, F.lit(False)))
            .otherwise(F.lit(False)))


def hazard_state(hazards: DataFrame, prefix: str = "h_") -> DataFrame:
    """Columns of a hazard needed by access and command checks.

    Joined by merging: few columns of many hazards look small by their file's size, and would be
    collected on the driver."""
    return hazards.select(
        F.col("hazard_id").alias(f"{prefix}hazard_id"),
        F.col("reported_by_user_id").alias(f"{prefix}reporter"),
        F.col("assigned_to_user_id").alias(f"{prefix}assignee"),
        F.col("status").alias(f"{prefix}status"),
    ).hint("merge")


def access_flags(requests: DataFrame, hazards: DataFrame) -> DataFrame:
    """V2: ``requests`` has hazard_id, user_id, role; adds ``accessible``.

    One equi-join on hazard_id; a hot hazard id on the request side is split
    by AQE's skew-join handling, and the hazard side is unique per key.
    """
    h = hazard_state(hazards)
    j = requests.join(h, requests["hazard_id"] == h["h_hazard_id"], "left")
    return j.select(*[requests[c] for c in requests.columns],
                    access_expr(F.col("role"), F.col("user_id"), F.col("h_reporter"),
                                F.col("h_assignee"), F.col("h_status")).alias("accessible"))


def related_edges(hazards: DataFrame, *cols: str) -> DataFrame:
    """At most two edges per hazard: (assignee, h) and (reporter, h) unless the
    reporter is the assignee. Disjoint by construction, so no distinct is
    needed; one scan emits both. ``in_pool`` marks hazards every manager
    already sees."""
    a, r = F.col("assigned_to_user_id"), F.col("reported_by_user_id")
    users = F.array(F.when(a.isNotNull(), a), F.when(~a.eqNullSafe(r), r))
    out = hazards.select(F.explode(users).alias("user_id"), F.col("hazard_id"), in_pool().alias("in_pool"),
                         *[F.col(c) for c in cols])
    return out.where(F.col("user_id").isNotNull())


def active_users(users: DataFrame) -> DataFrame:
    return users.where(F.col("is_active")).select(
        "user_id", T.canonical_role(T.trim_or_empty("role")).alias("role"))


def visible_grants(users: DataFrame, hazards: DataFrame) -> DataFrame:
    """V3: (user_id, role, hazard_id, grant) for every active user.

    grant = 'all' (officer, hazard_id NULL), 'pool' (manager, hazard_id NULL,
    meaning every unassigned Open hazard) or 'related' (one hazard the user
    reported or is assigned to, not already covered by the pool).
    """
    au = active_users(users)
    officers = au.where(F.col("role") == S.ROLE_SAFETY_OFFICER).select(
        "user_id", "role", F.lit(None).cast("long").alias("hazard_id"), F.lit(GRANT_ALL).alias("grant"))
    managers = au.where(F.col("role") == S.ROLE_SITE_MANAGER).select(
        "user_id", "role", F.lit(None).cast("long").alias("hazard_id"), F.lit(GRANT_POOL).alias("grant"))
    related_users = au.where(F.col("role").isin(S.ROLE_FIELD_WORKER, S.ROLE_SITE_MANAGER))
    e = related_edges(hazards)
    rel = (e.join(related_users, "user_id", "inner")
           .where((F.col("role") == S.ROLE_FIELD_WORKER) | ~F.col("in_pool"))
           .select("user_id", "role", "hazard_id", F.lit(GRANT_RELATED).alias("grant")))
    return officers.unionByName(managers).unionByName(rel)
