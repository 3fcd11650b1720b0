"""DuckDB SQL for every query that has a SQL equivalent.

Each statement starts with the register binding (the driver's tables mapped
to users, hazards, logs, attachments, commands and login events) as CTEs,
followed by the query itself. Column names equal the Spark query's.
"""

from __future__ import annotations

BINDING = r"""
WITH users AS (
  SELECT CAST(c_custkey AS BIGINT) AS user_id,
         'user' || CAST(c_custkey AS STRING) AS user_name,
         c_name AS full_name,
         CASE WHEN c_custkey % 100 = 99 THEN 'Auditor'
              WHEN c_custkey % 10 = 0 THEN 'SafetyOfficer'
              WHEN c_custkey % 10 IN (1, 2, 3) THEN 'SiteManager'
              ELSE 'FieldWorker' END AS role,
         NOT (c_custkey % 20 IN (7, 13)) AS is_active
  FROM customer
),
hazards AS (
  SELECT CAST(o_orderkey AS BIGINT) AS hazard_id,
         CASE WHEN o_orderkey % 25 = 0 THEN 'Demo: ' ELSE '' END
           || CASE o_orderkey % 4 WHEN 0 THEN 'Loose rail' WHEN 1 THEN 'Wet floor, level 2'
                                  WHEN 2 THEN 'Sign "EXIT" missing' ELSE 'Blocked aisle' END
           || ' #' || CAST(o_orderkey AS STRING) AS title,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL
              ELSE CASE o_orderkey % 7 WHEN 0 THEN 'Smoke seen. ' WHEN 1 THEN 'Electrical panel open. '
                                       WHEN 2 THEN 'Gas smell. ' WHEN 3 THEN 'Forklift leaking. '
                                       WHEN 4 THEN 'ריח עשן. ' WHEN 5 THEN '' ELSE 'Tripping risk. ' END
                   || d.text END AS description,
         CAST(o_custkey AS BIGINT) AS reported_by_user_id,
         CAST(CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_custkey
                                  ELSE 10 * (o_orderkey % 15) + 1 END AS BIGINT) AS assigned_to_user_id,
         CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'InProgress' ELSE 'Resolved' END AS status,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
                              WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS severity,
         CASE WHEN o_orderkey % 97 = 0 THEN 'Legacy' ELSE
           CASE o_orderkey % 6 WHEN 0 THEN 'Fire' WHEN 1 THEN 'Electrical' WHEN 2 THEN 'Chemical'
                               WHEN 3 THEN 'Equipment' WHEN 4 THEN 'Physical' ELSE 'General' END END AS type,
         o_orderdate AS created_at,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL
              ELSE o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 90 AS INT) END AS due_date
  FROM orders JOIN documents d ON d.doc_id = o_orderkey % (SELECT greatest(count(*), 1) FROM documents)
),
hazard_logs AS (
  SELECT CAST(event_id AS BIGINT) AS hazard_log_id,
         CAST((event_id * 7) % 300 AS BIGINT) AS hazard_id,
         CASE event_type WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'UpdatedDetails'
              WHEN 'purchase' THEN 'Assigned' WHEN 'click' THEN 'StatusChanged' ELSE 'Comment' END AS action_type,
         CASE event_type WHEN 'view' THEN props WHEN 'click' THEN 'Open -> InProgress' ELSE '' END AS details,
         CAST(user_id AS BIGINT) AS performed_by_user_id,
         ts AS created_at
  FROM events
),
hazard_attachments AS (
  SELECT CAST(page_id AS BIGINT) AS attachment_id, CAST((page_id * 13) % 300 AS BIGINT) AS hazard_id,
         url AS file_name, 'text/html' AS content_type,
         CAST(length(html) AS INT) AS file_size_bytes, CAST(NULL AS STRING) AS storage_path,
         CASE WHEN page_id % 3 = 0 THEN NULL ELSE CAST(page_id % 15 AS BIGINT) END AS uploaded_by_user_id,
         TIMESTAMP '2024-01-01 00:00:00' AS uploaded_at
  FROM pages
),
hazard_commands AS (
  SELECT event_id AS command_id, ts AS command_ts,
         CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'update' WHEN 'purchase' THEN 'assign'
              WHEN 'click' THEN 'change_status' ELSE 'comment' END AS kind,
         CASE WHEN event_id % 50 = 0 THEN -1 ELSE CAST((event_id * 7) % 300 AS BIGINT) END AS hazard_id,
         CASE WHEN event_id % 41 = 0 THEN 99 ELSE CAST(user_id AS BIGINT) END AS performed_by_user_id,
         CASE event_id % 5 WHEN 0 THEN 'Open' WHEN 1 THEN 'InProgress' WHEN 2 THEN ' Resolved '
                           WHEN 3 THEN 'Closed' ELSE NULL END AS new_status,
         CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(user_id AS BIGINT) WHEN 2 THEN 1 ELSE 5 END AS assign_to_user_id,
         CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE props END AS details,
         CASE event_id % 6 WHEN 0 THEN 13 WHEN 1 THEN 4 ELSE CAST(user_id AS BIGINT) END AS reported_by_user_id,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'Reported item ' || CAST(event_id AS STRING) END AS title,
         props AS description,
         CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Low' WHEN 2 THEN 'High' ELSE 'Critical' END AS severity,
         CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Fire' ELSE 'Physical' END AS type,
         CASE WHEN event_id % 2 = 0 THEN NULL ELSE ts END AS due_date
  FROM events
),
login_events AS (
  SELECT event_id AS login_id, ts, '10.0.0.' || CAST(user_id % 4 AS STRING) AS ip,
         'User' || CAST(user_id AS STRING) AS user_name, event_type <> 'error' AS success
  FROM events
)
"""

NOW = "TIMESTAMP '1998-07-01 12:00:00'"
HAZARD_COLS = ("hazard_id, title, description, reported_by_user_id, assigned_to_user_id, status, "
               "severity, type, created_at, due_date")


def scope_sql(uid: int, role: str, alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    if role == "SafetyOfficer":
        return "TRUE"
    if role == "FieldWorker":
        return f"({p}reported_by_user_id = {uid} OR {p}assigned_to_user_id = {uid})"
    if role == "SiteManager":
        return (f"({p}assigned_to_user_id = {uid} OR {p}reported_by_user_id = {uid} "
                f"OR ({p}assigned_to_user_id IS NULL AND {p}status = 'Open'))")
    return "FALSE"


OVERDUE = f"(due_date IS NOT NULL AND due_date < {NOW} AND status <> 'Resolved')"


def kpi_cols(cond: str = "TRUE") -> str:
    return (f"count(*) FILTER (WHERE {cond}) AS total, "
            f"count(*) FILTER (WHERE {cond} AND status = 'Open') AS open_count, "
            f"count(*) FILTER (WHERE {cond} AND status = 'InProgress') AS in_progress_count, "
            f"count(*) FILTER (WHERE {cond} AND status = 'Resolved') AS resolved_count, "
            f"count(*) FILTER (WHERE {cond} AND {OVERDUE}) AS overdue_count")


NAMED_LIST = f"""
SELECT h.hazard_id, h.title, h.description, h.reported_by_user_id, h.assigned_to_user_id, h.status,
       h.severity, h.type, h.created_at, h.due_date, rb.full_name AS reported_by_name,
       ab.full_name AS assigned_to_name
FROM hazards h JOIN users rb ON rb.user_id = h.reported_by_user_id
LEFT JOIN users ab ON ab.user_id = h.assigned_to_user_id
"""

SQL: dict[str, str] = {}


def register(name: str, body: str) -> None:
    SQL[name] = BINDING + body


# S1-S4 ----------------------------------------------------------------------
register("src_users", "SELECT * FROM users")
register("src_hazards", "SELECT * FROM hazards")
register("src_hazard_logs", "SELECT * FROM hazard_logs")
register("src_hazard_attachments", "SELECT * FROM hazard_attachments")

# V1 -------------------------------------------------------------------------
register("scope_officer", f"SELECT * FROM hazards WHERE {scope_sql(10, 'SafetyOfficer')}")
register("scope_manager", f"SELECT * FROM hazards WHERE {scope_sql(11, 'SiteManager')}")
register("scope_worker", f"SELECT * FROM hazards WHERE {scope_sql(14, 'FieldWorker')}")

# F1-F7, F10, F11 ------------------------------------------------------------
register("filter_search", "SELECT * FROM hazards WHERE coalesce(lower(title) LIKE '%a_e%', FALSE) "
                          "OR coalesce(lower(description) LIKE '%a_e%', FALSE)")
register("filter_status", "SELECT * FROM hazards WHERE status = 'InProgress'")
register("filter_severity", "SELECT * FROM hazards WHERE severity = 'Critical'")
register("filter_type", "SELECT * FROM hazards WHERE type = 'Chemical'")
register("filter_assignee", "SELECT * FROM hazards WHERE assigned_to_user_id = 11")
register("filter_overdue", f"SELECT * FROM hazards WHERE {OVERDUE}")
register("filter_created_range", "SELECT * FROM hazards WHERE created_at >= TIMESTAMP '1996-01-01 00:00:00' "
                                 "AND created_at <= TIMESTAMP '1996-06-30 23:59:59'")
register("filter_title_prefix", "SELECT * FROM hazards WHERE title LIKE 'Demo:%'")
register("users_by_role", "SELECT user_id, user_name, full_name, role FROM users "
                          "WHERE is_active AND role = 'SiteManager'")

# F8 -------------------------------------------------------------------------
register("hazard_list", f"""
SELECT * FROM ({NAMED_LIST}) x
WHERE {scope_sql(11, 'SiteManager')}
  AND (coalesce(lower(title) LIKE '%rail%', FALSE) OR coalesce(lower(description) LIKE '%rail%', FALSE))
  AND due_date IS NOT NULL AND due_date < {NOW} AND status <> 'Resolved'
""")

# J1-J3 ----------------------------------------------------------------------
register("join_reporter", """
SELECT h.hazard_id, h.reported_by_user_id, u.full_name AS reported_by_name
FROM hazards h JOIN users u ON u.user_id = h.reported_by_user_id""")
register("join_assignee", """
SELECT h.hazard_id, h.assigned_to_user_id, u.full_name AS assigned_to_name
FROM hazards h LEFT JOIN users u ON u.user_id = h.assigned_to_user_id""")
register("join_log_performer", """
SELECT l.hazard_log_id, l.hazard_id, l.performed_by_user_id, u.full_name AS performed_by_name
FROM hazard_logs l JOIN users u ON u.user_id = l.performed_by_user_id""")

# A1-A5 ----------------------------------------------------------------------
register("kpi_officer", f"SELECT {kpi_cols()} FROM hazards WHERE {scope_sql(10, 'SafetyOfficer')}")
register("kpi_manager", f"SELECT {kpi_cols()} FROM hazards WHERE {scope_sql(11, 'SiteManager')}")
register("kpi_worker", f"SELECT {kpi_cols()} FROM hazards WHERE {scope_sql(14, 'FieldWorker')}")
register("breakdown_severity", f"SELECT severity AS key, count(*) AS count FROM hazards "
                               f"WHERE {scope_sql(11, 'SiteManager')} GROUP BY severity")
register("breakdown_type", f"SELECT type AS key, count(*) AS count FROM hazards "
                           f"WHERE {scope_sql(11, 'SiteManager')} GROUP BY type")
register("breakdown_percent", f"""
, b AS (SELECT severity AS key, count(*) AS count FROM hazards
        WHERE {scope_sql(11, 'SiteManager')} GROUP BY severity)
SELECT key, count,
       CAST(round_even(count / greatest(1, (SELECT max(count) FROM b)) * 100.0, 0) AS INT) AS percent,
       '~/Hazards/HazardList.aspx?severity=' || replace(url_encode(key), '%20', '+') AS link
FROM b""")
register("dashboard", f"""
SELECT CASE WHEN grouping(severity) = 1 AND grouping(type) = 1 THEN 'kpi'
            WHEN grouping(type) = 1 THEN 'severity' ELSE 'type' END AS section,
       CASE WHEN grouping(severity) = 0 THEN severity WHEN grouping(type) = 0 THEN type END AS key,
       {kpi_cols()}
FROM hazards WHERE {scope_sql(11, 'SiteManager')}
GROUP BY GROUPING SETS ((), (severity), (type))""")

# The oracle expands every (user, hazard) pair on purpose -----------------
PAIRS = """
, au AS (SELECT user_id, role FROM users WHERE is_active),
pairs AS (
  SELECT au.user_id, h.*
  FROM au JOIN hazards h ON
       au.role = 'SafetyOfficer'
    OR (au.role = 'FieldWorker' AND (h.reported_by_user_id = au.user_id OR h.assigned_to_user_id = au.user_id))
    OR (au.role = 'SiteManager' AND (h.assigned_to_user_id = au.user_id OR h.reported_by_user_id = au.user_id
                                     OR (h.assigned_to_user_id IS NULL AND h.status = 'Open')))
)
"""
register("dashboard_all_kpi", PAIRS + f"""
SELECT au.user_id, au.role,
       count(p.hazard_id) AS total,
       count(p.hazard_id) FILTER (WHERE p.status = 'Open') AS open_count,
       count(p.hazard_id) FILTER (WHERE p.status = 'InProgress') AS in_progress_count,
       count(p.hazard_id) FILTER (WHERE p.status = 'Resolved') AS resolved_count,
       count(p.hazard_id) FILTER (WHERE p.due_date IS NOT NULL AND p.due_date < {NOW}
                                  AND p.status <> 'Resolved') AS overdue_count
FROM au LEFT JOIN pairs p ON p.user_id = au.user_id
GROUP BY au.user_id, au.role""")
register("dashboard_all_severity", PAIRS + "SELECT user_id, severity AS key, count(*) AS count FROM pairs "
                                           "GROUP BY user_id, severity")
register("dashboard_all_type", PAIRS + "SELECT user_id, type AS key, count(*) AS count FROM pairs "
                                       "GROUP BY user_id, type")
register("visible_pairs", """
, au AS (SELECT user_id, role FROM users WHERE is_active)
SELECT user_id, role, CAST(NULL AS INT) AS hazard_id, 'all' AS "grant" FROM au WHERE role = 'SafetyOfficer'
UNION ALL
SELECT user_id, role, CAST(NULL AS INT), 'pool' FROM au WHERE role = 'SiteManager'
UNION ALL
SELECT DISTINCT au.user_id, au.role, h.hazard_id, 'related'
FROM au JOIN hazards h ON (h.reported_by_user_id = au.user_id OR h.assigned_to_user_id = au.user_id)
WHERE au.role = 'FieldWorker'
   OR (au.role = 'SiteManager' AND NOT (h.assigned_to_user_id IS NULL AND h.status = 'Open'))""")

# A7 -------------------------------------------------------------------------
register("drilldown_consistency", f"""
, s AS (SELECT * FROM hazards WHERE {scope_sql(11, 'SiteManager')}),
l AS (SELECT * FROM ({NAMED_LIST}) x WHERE {scope_sql(11, 'SiteManager')})
SELECT 'status' AS dimension, b.key, b.bucket_count, coalesce(c.list_count, 0) AS list_count,
       b.bucket_count = coalesce(c.list_count, 0) AS consistent
FROM (SELECT status AS key, count(*) AS bucket_count FROM s GROUP BY status) b
LEFT JOIN (SELECT status AS key, count(*) AS list_count FROM l GROUP BY status) c ON c.key = b.key
UNION ALL
SELECT 'severity', b.key, b.bucket_count, coalesce(c.list_count, 0), b.bucket_count = coalesce(c.list_count, 0)
FROM (SELECT severity AS key, count(*) AS bucket_count FROM s GROUP BY severity) b
LEFT JOIN (SELECT severity AS key, count(*) AS list_count FROM l GROUP BY severity) c ON c.key = b.key
UNION ALL
SELECT 'type', b.key, b.bucket_count, coalesce(c.list_count, 0), b.bucket_count = coalesce(c.list_count, 0)
FROM (SELECT type AS key, count(*) AS bucket_count FROM s GROUP BY type) b
LEFT JOIN (SELECT type AS key, count(*) AS list_count FROM l GROUP BY type) c ON c.key = b.key
UNION ALL
SELECT 'overdue', '1', (SELECT count(*) FROM s WHERE {OVERDUE}), (SELECT count(*) FROM l WHERE {OVERDUE}),
       (SELECT count(*) FROM s WHERE {OVERDUE}) = (SELECT count(*) FROM l WHERE {OVERDUE})""")

# Requests from the command table ------------------------------------------
REQUESTS = """
, req AS (
  SELECT c.command_id AS request_id, c.hazard_id, c.performed_by_user_id AS user_id, u.role
  FROM hazard_commands c LEFT JOIN users u ON u.user_id = c.performed_by_user_id
)
"""


def access_sql(role: str, uid: str, rep: str, asg: str, status: str) -> str:
    r = f"lower(trim(coalesce({role}, '')))"
    return (f"CASE WHEN {r} = 'safetyofficer' THEN TRUE WHEN {rep} IS NULL THEN FALSE "
            f"WHEN {r} = 'fieldworker' THEN coalesce({rep} = {uid} OR {asg} = {uid}, FALSE) "
            f"WHEN {r} = 'sitemanager' THEN coalesce({asg} = {uid} OR {rep} = {uid} "
            f"OR ({status} = 'Open' AND {asg} IS NULL), FALSE) ELSE FALSE END")


register("access_flags", REQUESTS + f"""
SELECT q.request_id, q.hazard_id, q.user_id, q.role,
       {access_sql('q.role', 'q.user_id', 'h.reported_by_user_id', 'h.assigned_to_user_id', 'h.status')} AS accessible
FROM req q LEFT JOIN hazards h ON h.hazard_id = q.hazard_id""")

register("semi_eligible_assignee", """
SELECT command_id, assign_to_user_id FROM hazard_commands c
WHERE kind = 'assign' AND EXISTS (SELECT 1 FROM users u WHERE u.user_id = c.assign_to_user_id
                                  AND u.is_active AND u.role = 'SiteManager')""")
register("semi_active_reporter", """
SELECT command_id, reported_by_user_id FROM hazard_commands c
WHERE kind = 'create' AND EXISTS (SELECT 1 FROM users u WHERE u.user_id = c.reported_by_user_id AND u.is_active)""")
register("performer_role", """
SELECT c.command_id, c.performed_by_user_id, trim(u.role) AS performer_role
FROM hazard_commands c LEFT JOIN (SELECT * FROM users WHERE is_active) u ON u.user_id = c.performed_by_user_id""")
register("hazard_detail", REQUESTS + f"""
, ok AS (
  SELECT q.request_id, q.user_id, q.hazard_id FROM req q LEFT JOIN hazards h ON h.hazard_id = q.hazard_id
  WHERE {access_sql('q.role', 'q.user_id', 'h.reported_by_user_id', 'h.assigned_to_user_id', 'h.status')}
)
SELECT ok.request_id, ok.user_id AS viewer_id, x.* FROM ok JOIN ({NAMED_LIST}) x ON x.hazard_id = ok.hazard_id""")

_VIEWERS = ((10, "SafetyOfficer"), (11, "SiteManager"), (14, "FieldWorker"))
register("hazard_history", """
, lh AS (SELECT l.*, h.reported_by_user_id AS h_rep, h.assigned_to_user_id AS h_asg, h.status AS h_status
         FROM hazard_logs l LEFT JOIN hazards h ON h.hazard_id = l.hazard_id),
v AS (""" + " UNION ALL ".join(
    f"SELECT {uid} AS viewer_id, lh.* FROM lh WHERE {access_sql(repr(role), str(uid), 'h_rep', 'h_asg', 'h_status')}"
    for uid, role in _VIEWERS) + """)
SELECT v.viewer_id, v.hazard_log_id, v.hazard_id, v.action_type, v.details, v.performed_by_user_id,
       u.full_name AS performed_by_name, v.created_at
FROM v JOIN users u ON u.user_id = v.performed_by_user_id""")
register("user_by_name", """
SELECT e.login_id, u.user_id, u.user_name AS found_user_name, u.full_name, u.role, u.is_active
FROM login_events e JOIN users u ON lower(u.user_name) = lower(trim(e.user_name))
WHERE lower(trim(e.user_name)) <> ''""")

# W1-W5 ----------------------------------------------------------------------
CTX = """
, ctx AS (
  SELECT c.*, pr.role AS role, h.reported_by_user_id AS h_rep, h.assigned_to_user_id AS h_asg, h.status AS h_status,
         coalesce(tu.is_active AND tu.role = 'SiteManager', FALSE) AS target_mgr,
         coalesce(ru.is_active, FALSE) AS rep_active,
         upper(trim(c.new_status)) AS ns_u
  FROM hazard_commands c
  LEFT JOIN (SELECT user_id, trim(role) AS role FROM users WHERE is_active) pr ON pr.user_id = c.performed_by_user_id
  LEFT JOIN hazards h ON h.hazard_id = c.hazard_id
  LEFT JOIN users tu ON tu.user_id = c.assign_to_user_id
  LEFT JOIN users ru ON ru.user_id = c.reported_by_user_id
)
"""
P = "performed_by_user_id"
ROLES3 = "('SafetyOfficer', 'SiteManager', 'FieldWorker')"
CREATE_RES = f"""CASE WHEN role IS NULL THEN 'Unauthorized' WHEN NOT rep_active THEN 'BadRequest'
  WHEN role = 'FieldWorker' AND reported_by_user_id <> {P} THEN 'Forbidden'
  WHEN role NOT IN {ROLES3} THEN 'Forbidden' ELSE 'OK' END"""
UPDATE_RES = f"""CASE WHEN role IS NULL THEN 'Unauthorized' WHEN h_rep IS NULL THEN 'NotFound'
  WHEN role NOT IN {ROLES3} THEN 'Forbidden'
  WHEN role = 'SiteManager' AND NOT (h_asg = {P} OR (h_asg IS NULL AND h_status = 'Open')) THEN 'Forbidden'
  WHEN role = 'FieldWorker' AND NOT (h_rep = {P} AND h_asg IS NULL AND h_status = 'Open') THEN 'Forbidden'
  ELSE 'OK' END"""
ASSIGN_RES = f"""CASE WHEN role IS NULL THEN 'Unauthorized' WHEN h_status IS NULL THEN 'NotFound'
  WHEN role NOT IN ('SafetyOfficer', 'SiteManager') THEN 'Forbidden'
  WHEN role = 'SafetyOfficer' AND assign_to_user_id IS NOT NULL AND NOT target_mgr THEN 'Forbidden'
  WHEN role = 'SiteManager' AND assign_to_user_id <> {P} THEN 'Forbidden'
  WHEN role = 'SiteManager' AND NOT (h_status = 'Open' AND h_asg IS NULL) THEN 'Forbidden'
  ELSE 'OK' END"""
COMMENT_TAIL = f"""WHEN h_rep IS NULL THEN 'NotFound'
  WHEN role = 'FieldWorker' AND NOT (h_rep = {P} OR h_asg = {P}) THEN 'Forbidden'
  WHEN role = 'SiteManager' AND NOT (h_asg = {P} OR h_rep = {P} OR (h_status = 'Open' AND h_asg IS NULL)) THEN 'Forbidden'
  WHEN role NOT IN {ROLES3} THEN 'Forbidden' ELSE 'OK' END"""
BLANK_DETAILS = "trim(coalesce(details, '')) = ''"
BLANK_STATUS = "trim(coalesce(new_status, '')) = ''"
COMMENT_RES = f"""CASE WHEN role IS NULL THEN 'Unauthorized' WHEN {BLANK_DETAILS} THEN 'BadRequest' {COMMENT_TAIL}"""
STATUS_RES = f"""CASE WHEN role IS NULL THEN 'Unauthorized'
  WHEN {BLANK_STATUS} AND {BLANK_DETAILS} THEN 'BadRequest'
  WHEN {BLANK_STATUS} THEN (CASE {COMMENT_TAIL})
  WHEN ns_u NOT IN ('OPEN', 'INPROGRESS', 'RESOLVED') THEN 'BadRequest'
  WHEN h_status IS NULL THEN 'NotFound'
  WHEN role <> 'SafetyOfficer' AND role <> 'SiteManager' THEN 'Forbidden'
  WHEN role <> 'SafetyOfficer' AND h_asg <> {P} THEN 'Forbidden'
  WHEN role <> 'SafetyOfficer' AND NOT ((h_status = 'Open' AND ns_u = 'INPROGRESS')
                                        OR (h_status = 'InProgress' AND ns_u = 'RESOLVED')) THEN 'Forbidden'
  ELSE 'OK' END"""

register("cmd_create", CTX + f"""
, v AS (SELECT command_id, {CREATE_RES} AS result FROM ctx WHERE kind = 'create')
SELECT command_id, result,
       CASE WHEN result = 'OK' THEN CAST((SELECT max(hazard_id) FROM hazards)
            + row_number() OVER (PARTITION BY result = 'OK' ORDER BY command_id) AS BIGINT) END AS new_hazard_id
FROM v""")
register("cmd_update", CTX + f"SELECT command_id, {UPDATE_RES} AS result FROM ctx WHERE kind = 'update'")
register("cmd_assign", CTX + f"SELECT command_id, {ASSIGN_RES} AS result FROM ctx WHERE kind = 'assign'")
register("cmd_change_status", CTX + f"""
SELECT command_id, {STATUS_RES} AS result,
       CASE WHEN {BLANK_STATUS} THEN 'Comment' ELSE 'StatusChanged' END AS action
FROM ctx WHERE kind = 'change_status'""")
register("cmd_comment", CTX + f"SELECT command_id, {COMMENT_RES} AS result FROM ctx WHERE kind = 'comment'")


def policy_role(role: str, name: str) -> str:
    return f"coalesce(lower({role}) = '{name.lower()}', FALSE)"


def same(a: str, b: str) -> str:
    return f"coalesce({a} = {b}, FALSE)"


def is_status(s: str, name: str) -> str:
    return f"(lower(coalesce({s}, '')) = '{name.lower()}')"


def can_view_sql(role, uid, rep, asg, st, ex) -> str:
    return (f"({ex} AND ({policy_role(role, 'SafetyOfficer')} "
            f"OR ({policy_role(role, 'FieldWorker')} AND ({same(rep, uid)} OR {same(asg, uid)})) "
            f"OR ({policy_role(role, 'SiteManager')} AND ({same(asg, uid)} OR {same(rep, uid)} "
            f"OR ({asg} IS NULL AND {is_status(st, 'Open')})))))")


def can_edit_sql(role, uid, rep, asg, st, ex) -> str:
    return (f"({can_view_sql(role, uid, rep, asg, st, ex)} AND ({policy_role(role, 'SafetyOfficer')} "
            f"OR ({policy_role(role, 'FieldWorker')} AND {same(rep, uid)} AND {asg} IS NULL "
            f"AND {is_status(st, 'Open')}) "
            f"OR ({policy_role(role, 'SiteManager')} AND ({same(asg, uid)} OR {same(rep, uid)}))))")


register("effective_edit", CTX + f"""
, r AS (SELECT ctx.*, {UPDATE_RES} AS result FROM ctx WHERE kind = 'update'),
e AS (SELECT r.*, u.role AS viewer_role FROM r LEFT JOIN users u ON u.user_id = r.performed_by_user_id)
SELECT command_id, {can_edit_sql('viewer_role', P, 'h_rep', 'h_asg', 'h_status', 'h_rep IS NOT NULL')} AS policy_can_edit,
       result = 'OK' AS write_accepted,
       {can_edit_sql('viewer_role', P, 'h_rep', 'h_asg', 'h_status', 'h_rep IS NOT NULL')} AND result = 'OK'
         AS effective_edit
FROM e""")

# W7-W9 ----------------------------------------------------------------------
SEED_USERS_SQL = """
, seed_users AS (SELECT * FROM (VALUES (1, 'safety', 'Safety Officer', 'SafetyOfficer', TRUE),
                                       (2, 'manager', 'Site Manager', 'SiteManager', TRUE),
                                       (3, 'worker', 'Field Worker', 'FieldWorker', TRUE))
                 t(seq, user_name, full_name, role, is_active)),
upserted AS (
  SELECT u.user_id, u.user_name, coalesce(s.full_name, u.full_name) AS full_name,
         coalesce(s.role, u.role) AS role, coalesce(s.is_active, u.is_active) AS is_active
  FROM users u LEFT JOIN seed_users s ON lower(s.user_name) = lower(u.user_name)
  UNION ALL
  SELECT CAST((SELECT max(user_id) FROM users) + row_number() OVER (ORDER BY s.seq) AS INT),
         s.user_name, s.full_name, s.role, s.is_active
  FROM seed_users s WHERE NOT EXISTS (SELECT 1 FROM users u WHERE lower(u.user_name) = lower(s.user_name))
)
"""
register("upsert_users", SEED_USERS_SQL + "SELECT * FROM upserted")
DEMO = ", demo AS (SELECT hazard_id FROM hazards WHERE title LIKE 'Demo:%')"
register("purge_demo_hazards", DEMO + " SELECT * FROM hazards WHERE hazard_id NOT IN (SELECT hazard_id FROM demo)")
register("purge_demo_logs", DEMO + " SELECT * FROM hazard_logs WHERE hazard_id NOT IN (SELECT hazard_id FROM demo)")
register("purge_demo_attachments",
         DEMO + " SELECT * FROM hazard_attachments WHERE hazard_id NOT IN (SELECT hazard_id FROM demo)")
RELOAD = SEED_USERS_SQL + DEMO + f"""
, seed_h AS (SELECT * FROM (VALUES
   (1, 'Demo: Overdue Open – Unlabelled chemical containers',
    'Several containers are missing labels in the storage area.', 'High', 'Chemical', 'Open',
    TIMESTAMP '2025-12-01 00:00:00', 'worker', 'manager'),
   (2, 'Demo: In Progress – Missing guard rails on scaffold',
    'Guard rails are partially missing on level 2 scaffold.', 'Medium', 'Physical', 'InProgress',
    TIMESTAMP '2026-01-20 00:00:00', 'worker', 'worker'),
   (3, 'Demo: Resolved – Exposed electrical wiring in hallway',
    'Exposed wiring found near the main hallway panel.', 'Critical', 'Electrical', 'Resolved',
    TIMESTAMP '2025-12-15 00:00:00', 'manager', 'manager'),
   (4, 'Demo: Open (Unassigned) – Slippery floor near entrance',
    'Wet floor reported near the entrance, no signage.', 'Low', 'Physical', 'Open',
    TIMESTAMP '2026-02-01 00:00:00', 'worker', NULL))
   t(seq, title, description, severity, type, status, due_date, reporter_name, assignee_name)),
ins AS (
  SELECT CAST((SELECT max(hazard_id) FROM hazards) + s.seq AS INT) AS hazard_id, s.title, s.description,
         r.user_id AS reported_by_user_id, a.user_id AS assigned_to_user_id, s.status, s.severity, s.type,
         {NOW} AS created_at, s.due_date
  FROM seed_h s LEFT JOIN upserted r ON lower(r.user_name) = s.reporter_name
  LEFT JOIN upserted a ON lower(a.user_name) = s.assignee_name
),
seed_logs AS (
  SELECT hazard_id, 1 AS step, 'Created' AS action_type, 'Demo seed: hazard created' AS details,
         (SELECT max(user_id) FROM upserted WHERE lower(user_name) = 'safety') AS performed_by_user_id FROM ins
  UNION ALL
  SELECT hazard_id, 2, 'Assigned', 'Demo seed: assigned by system',
         (SELECT max(user_id) FROM upserted WHERE lower(user_name) = 'safety') FROM ins
  WHERE title LIKE 'Demo: Overdue Open%'
  UNION ALL
  SELECT hazard_id, 3, 'StatusChanged', 'Demo seed: moved to InProgress',
         (SELECT max(user_id) FROM upserted WHERE lower(user_name) = 'manager') FROM ins
  WHERE title LIKE 'Demo: In Progress%'
)
"""
register("reload_demo_hazards", RELOAD + """
SELECT * FROM hazards WHERE hazard_id NOT IN (SELECT hazard_id FROM demo)
UNION ALL SELECT * FROM ins""")
register("reload_demo_logs", RELOAD + f"""
SELECT * FROM hazard_logs WHERE hazard_id NOT IN (SELECT hazard_id FROM demo)
UNION ALL
SELECT CAST((SELECT max(hazard_log_id) FROM hazard_logs) + row_number() OVER (ORDER BY step, hazard_id) AS INT),
       hazard_id, action_type, details, CAST(performed_by_user_id AS INT), {NOW}
FROM seed_logs""")

# P1-P8 ----------------------------------------------------------------------
POLICY_ROWS = REQUESTS + """
, pr AS (
  SELECT q.request_id, q.user_id, q.role, h.hazard_id IS NOT NULL AS h_exists, h.reported_by_user_id AS h_rep,
         h.assigned_to_user_id AS h_asg, h.status AS h_status, c.new_status
  FROM req q LEFT JOIN hazards h ON h.hazard_id = q.hazard_id JOIN hazard_commands c ON c.command_id = q.request_id
)
"""
PA = ("role", "user_id", "h_rep", "h_asg", "h_status", "h_exists")


def known_status(s: str) -> str:
    return f"({is_status(s, 'Open')} OR {is_status(s, 'InProgress')} OR {is_status(s, 'Resolved')})"


def can_change_sql(role, uid, rep, asg, st, ex, new) -> str:
    return (f"({can_view_sql(role, uid, rep, asg, st, ex)} AND (({policy_role(role, 'SafetyOfficer')} "
            f"AND {known_status(new)}) OR ({policy_role(role, 'SiteManager')} AND {same(asg, uid)} AND "
            f"(({is_status(st, 'Open')} AND {is_status(new, 'InProgress')}) OR "
            f"({is_status(st, 'InProgress')} AND {is_status(new, 'Resolved')})))))")


def self_assign_sql(role, asg, st, ex) -> str:
    return f"({ex} AND {policy_role(role, 'SiteManager')} AND {asg} IS NULL AND {is_status(st, 'Open')})"


register("policy_can_view", POLICY_ROWS + f"SELECT request_id, {can_view_sql(*PA)} AS can_view FROM pr")
register("policy_can_edit", POLICY_ROWS + f"SELECT request_id, {can_edit_sql(*PA)} AS can_edit FROM pr")
register("policy_can_self_assign", POLICY_ROWS +
         f"SELECT request_id, {self_assign_sql('role', 'h_asg', 'h_status', 'h_exists')} AS can_self_assign FROM pr")
register("policy_can_assign_other", POLICY_ROWS +
         f"SELECT request_id, {policy_role('role', 'SafetyOfficer')} AS can_assign_other FROM pr")
register("policy_can_change_status", POLICY_ROWS +
         f"SELECT request_id, {can_change_sql(*PA, 'new_status')} AS can_change_status FROM pr")
register("policy_next_statuses", POLICY_ROWS + f"""
SELECT request_id,
       CASE WHEN NOT h_exists THEN '' WHEN {policy_role('role', 'SafetyOfficer')} THEN 'Open,InProgress,Resolved'
            WHEN {policy_role('role', 'SiteManager')} AND {same('h_asg', 'user_id')} THEN
              CASE WHEN {is_status('h_status', 'Open')} THEN 'InProgress'
                   WHEN {is_status('h_status', 'InProgress')} THEN 'Resolved' ELSE '' END
            ELSE '' END AS next_statuses
FROM pr""")
register("policy_can_comment", POLICY_ROWS + f"""
SELECT request_id, ({policy_role('role', 'FieldWorker')} OR {policy_role('role', 'SiteManager')}
                    OR {policy_role('role', 'SafetyOfficer')}) AS can_comment FROM pr""")
register("row_actions", POLICY_ROWS + f"""
SELECT request_id, {self_assign_sql('role', 'h_asg', 'h_status', 'h_exists')} AS can_take,
       {can_change_sql(*PA, "'InProgress'")} AS can_start,
       {can_change_sql(*PA, "'Resolved'")} AS can_resolve
FROM pr""")

# T1-T16 ---------------------------------------------------------------------
WS = r"[\s\p{Z}]"


def dash(x: str) -> str:
    return f"CASE WHEN coalesce(regexp_replace({x}, '{WS}', '', 'g') = '', TRUE) THEN '-' ELSE {x} END"


def trim_ws(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def csv(x: str) -> str:
    v = f"replace(coalesce({x}, ''), '\"', '\"\"')"
    return f"CASE WHEN regexp_matches({v}, '[,\"' || chr(13) || chr(10) || ']') THEN '\"' || {v} || '\"' ELSE {v} END"


def canon(x: str, values) -> str:
    whens = " ".join(f"WHEN lower(trim({x})) = '{v.lower()}' THEN '{v}'" for v in values)
    return f"CASE {whens} ELSE {x} END"


def d(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


CLASSIFY_RULES = (
    ("Fire", "High", ("fire", "אש", "smoke", "עשן")),
    ("Electrical", "High", ("electric", "electrical", "חשמל", "קצר")),
    ("Chemical", "Critical", ("chemical", "acid", "gas", "fume", "כימ", "חומצה", "גז", "אדים")),
    ("Equipment", "High", ("machine", "equipment", "forklift", "מכונה", "ציוד", "מלגזה")),
)


def classify_sql(x: str, pick: int, default: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower({x}), '{k}')" for k in rule[2])
                     + f" THEN '{rule[pick]}'" for rule in CLASSIFY_RULES)
    return f"CASE {whens} ELSE '{default}' END"


register("scalar_trim_blank", """
SELECT command_id, trim(coalesce(details, '')) AS details_trimmed, trim(coalesce(details, '')) = '' AS details_blank
FROM hazard_commands""")
register("scalar_canonical", f"""
SELECT command_id, {canon('new_status', ('Open', 'InProgress', 'Resolved'))} AS status_canonical,
       {canon('severity', ('Low', 'Medium', 'High', 'Critical'))} AS severity_canonical,
       {canon('type', ('Fire', 'Electrical', 'Chemical', 'Equipment', 'Physical', 'General'))} AS type_canonical
FROM hazard_commands""")
register("scalar_type_fallback", """
SELECT hazard_id, type, CASE WHEN type IN ('Fire', 'Electrical', 'Chemical', 'Equipment', 'Physical', 'General')
                             THEN type ELSE 'General' END AS edit_type FROM hazards""")
register("classify", f"""
SELECT hazard_id, {classify_sql('description', 0, 'General')} AS suggested_type,
       {classify_sql('description', 1, 'Medium')} AS suggested_severity FROM hazards""")
register("scalar_status_log", """
SELECT c.command_id,
       coalesce(h.status, '') || ' -> ' || coalesce(trim(c.new_status), '')
              || CASE WHEN c.details IS NULL OR rtrim(c.details) = '' THEN '' ELSE ' | ' || c.details END
         AS log_text
FROM hazard_commands c LEFT JOIN hazards h ON h.hazard_id = c.hazard_id
WHERE c.kind = 'change_status' AND trim(coalesce(c.new_status, '')) <> ''""")
register("csv_lines", f"""
SELECT hazard_id, CAST(hazard_id AS VARCHAR) || ',' || {csv('title')} || ',' || {csv('status')} || ','
       || {csv('severity')} || ',' || {csv('type')} || ',' || {csv('reported_by_name')} || ','
       || {csv('assigned_to_name')} || ',' || {d('created_at')} || ',' || coalesce({d('due_date')}, '') AS csv_line
FROM ({NAMED_LIST}) x""")
REPORT_LINE = (f"'#' || CAST(hazard_id AS VARCHAR) || ' | ' || coalesce(status, '') || ' | ' || coalesce(severity, '')"
               f" || ' | ' || coalesce(type, '') || ' | Due: ' || coalesce({d('due_date')}, '-') || ' | Assigned: '"
               f" || {dash('assigned_to_name')} || ' | ' || coalesce(title, '')")
register("report_lines", f"""
, r AS (SELECT row_number() OVER (ORDER BY created_at DESC, hazard_id DESC) AS line_no,
               {REPORT_LINE} AS line
        FROM ({NAMED_LIST}) x)
SELECT line_no, line FROM r""")
register("scalar_dates", f"""
SELECT hazard_id, {d('created_at')} AS created_day, {d('due_date')} AS due_day,
       strftime(created_at, '%Y-%m-%d %H:%M') AS created_minute FROM hazards""")
register("scalar_overdue_day", f"""
SELECT hazard_id, coalesce({OVERDUE}, FALSE) AS overdue_ts,
       coalesce(due_date IS NOT NULL AND CAST(due_date AS DATE) < DATE '1998-07-01'
                AND lower(coalesce(status, '')) <> 'resolved', FALSE) AS overdue_day
FROM hazards""")
register("list_display", f"""
SELECT hazard_id, {dash('assigned_to_name')} AS assigned_display, coalesce({d('due_date')}, '-') AS due_display,
       CASE WHEN status = 'InProgress' THEN 'In Progress' ELSE status END AS status_label
FROM ({NAMED_LIST}) x""")
register("scalar_comment_valid", f"""
SELECT command_id, length({trim_ws('details')}) >= 3 AS comment_valid FROM hazard_commands WHERE kind = 'comment'""")
_DUE_FMTS = ("%Y-%m-%d", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%S",
             "%m/%d/%Y", "%m/%d/%Y %H:%M")
_PARSED = "coalesce(" + ", ".join(f"try_strptime({trim_ws('due_text')}, '{f}')" for f in _DUE_FMTS) + ")"
register("scalar_due_parse", f"""
, t AS (SELECT command_id, CASE command_id % 4 WHEN 0 THEN strftime(command_ts, '%Y-%m-%d')
                                               WHEN 1 THEN strftime(command_ts, '%Y-%m-%d %H:%M')
                                               WHEN 2 THEN description ELSE '  ' END AS due_text
        FROM hazard_commands)
SELECT command_id, due_text, {_PARSED} AS due_parsed,
       coalesce(regexp_replace(due_text, '{WS}', '', 'g') = '', TRUE) OR {_PARSED} IS NOT NULL AS due_valid
FROM t""")
register("scalar_header_meta", f"""
SELECT hazard_id, 'Hazard #' || CAST(hazard_id AS VARCHAR) || ' - ' || coalesce(title, '') AS header,
       coalesce(status, '') || ' | Reported by ' || coalesce(reported_by_name, '') || ' | Assigned to '
       || {dash('assigned_to_name')} AS meta
FROM ({NAMED_LIST}) x""")
register("scalar_drill_link", """
SELECT type AS key, '~/Hazards/HazardList.aspx?type=' || replace(url_encode(type), '%20', '+') AS link,
       '?format=csv&type=' || replace(url_encode(type), '%20', '+') || '&overdue=1' AS export_query
FROM hazards GROUP BY type""")
register("scalar_form_valid", f"""
SELECT command_id, length({trim_ws('title')}) > 0 AND length({trim_ws('title')}) <= 200
       AND length({trim_ws('description')}) > 0 AND length({trim_ws('description')}) <= 2000 AS form_valid
FROM hazard_commands WHERE kind = 'create'""")

# E3-E5 ----------------------------------------------------------------------
def _iso(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%S')"


JSON_ITEM = f"""CAST(json_object('HazardId', hazard_id, 'Title', title, 'Status', status, 'Severity', severity, 'Type', type,
  'ReportedByUserId', reported_by_user_id, 'ReportedByName', reported_by_name, 'AssignedToUserId', assigned_to_user_id,
  'AssignedToName', assigned_to_name, 'CreatedAt', {_iso('created_at')}, 'DueDate', {_iso('due_date')}) AS VARCHAR)"""
register("json_list", ", x AS (" + NAMED_LIST + ") " + " UNION ALL ".join(
    f"SELECT {uid} AS viewer_id, hazard_id, {JSON_ITEM} AS json FROM x WHERE {scope_sql(uid, role)}"
    for uid, role in _VIEWERS if role != "FieldWorker"))
register("json_list_filtered", f"""
, x AS ({NAMED_LIST})
SELECT '{{"items":[' || coalesce(string_agg({JSON_ITEM}, ',' ORDER BY created_at DESC, hazard_id DESC), '') || ']}}' AS json
FROM x WHERE (lower(title) LIKE '%panel%' OR lower(description) LIKE '%panel%') AND lower(status) = 'open'
  AND lower(severity) = 'critical' AND lower(type) = 'fire' AND {OVERDUE}""")


def _stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(date_part('microsecond', {col}) AS BIGINT) % 1000000 // 1000 AS VARCHAR), 3, '0')"


_ALLOWED = REQUESTS + f"""
, ok AS (
  SELECT q.request_id, q.hazard_id FROM req q LEFT JOIN hazards h ON h.hazard_id = q.hazard_id
  WHERE {access_sql('q.role', 'q.user_id', 'h.reported_by_user_id', 'h.assigned_to_user_id', 'h.status')}
)"""

register("detail_requests", _ALLOWED + f"""
SELECT ok.request_id, ok.hazard_id FROM ok JOIN ({NAMED_LIST}) x ON x.hazard_id = ok.hazard_id""")

register("detail_nested", REQUESTS + f"""
, ok AS (
  SELECT q.request_id, q.hazard_id FROM req q LEFT JOIN hazards h ON h.hazard_id = q.hazard_id
  WHERE {access_sql('q.role', 'q.user_id', 'h.reported_by_user_id', 'h.assigned_to_user_id', 'h.status')}
),
lg AS (SELECT l.hazard_id, string_agg(CAST(json_object('created_at', {_stamp('l.created_at')}, 'hazard_log_id', l.hazard_log_id,
                'action_type', l.action_type, 'details', l.details, 'performed_by_user_id', l.performed_by_user_id,
                'performed_by_name', u.full_name) AS VARCHAR), ',' ORDER BY l.created_at DESC, l.hazard_log_id DESC) AS logs
       FROM hazard_logs l JOIN users u ON u.user_id = l.performed_by_user_id GROUP BY l.hazard_id)
SELECT ok.request_id, '{{"hazard":' || CAST(json_object('hazard_id', x.hazard_id, 'title', x.title, 'description', x.description,
         'reported_by_user_id', x.reported_by_user_id, 'assigned_to_user_id', x.assigned_to_user_id, 'status', x.status,
         'severity', x.severity, 'type', x.type, 'created_at', {_stamp('x.created_at')}, 'due_date', {_stamp('x.due_date')},
         'reported_by_name', x.reported_by_name, 'assigned_to_name', x.assigned_to_name) AS VARCHAR)
       || ',"logs":[' || coalesce(lg.logs, '') || ']}}' AS json
FROM ok JOIN ({NAMED_LIST}) x ON x.hazard_id = ok.hazard_id LEFT JOIN lg ON lg.hazard_id = x.hazard_id""")

register("detail_lines", _ALLOWED + f""",
x AS (SELECT * FROM ({NAMED_LIST}) n WHERE n.hazard_id IN (SELECT hazard_id FROM ok)),
lg AS (
  SELECT l.hazard_id, l.created_at, l.hazard_log_id, json_object('created_at', {_stamp('l.created_at')}, 'hazard_log_id', l.hazard_log_id,
           'action_type', l.action_type, 'details', l.details, 'performed_by_user_id', l.performed_by_user_id,
           'performed_by_name', u.full_name) AS entry,
         row_number() OVER (PARTITION BY l.hazard_id ORDER BY l.created_at DESC, l.hazard_log_id DESC) AS nth
  FROM hazard_logs l JOIN users u ON u.user_id = l.performed_by_user_id JOIN x ON x.hazard_id = l.hazard_id)
SELECT hazard_id, 0 AS line_kind, NULL::TIMESTAMP AS created_at, NULL::BIGINT AS hazard_log_id,
       '{{"hazard":' || CAST(json_object('hazard_id', x.hazard_id, 'title', x.title, 'description', x.description,
         'reported_by_user_id', x.reported_by_user_id, 'assigned_to_user_id', x.assigned_to_user_id, 'status', x.status,
         'severity', x.severity, 'type', x.type, 'created_at', {_stamp('x.created_at')}, 'due_date', {_stamp('x.due_date')},
         'reported_by_name', x.reported_by_name, 'assigned_to_name', x.assigned_to_name) AS VARCHAR) || ',"logs":[' AS json FROM x
UNION ALL SELECT hazard_id, 1, created_at, hazard_log_id, CASE WHEN nth = 1 THEN '' ELSE ',' END || CAST(entry AS VARCHAR) FROM lg
UNION ALL SELECT hazard_id, 2, NULL, NULL, ']}}' FROM x""")


def _map_sql(col: str) -> str:
    return (f"'{{' || coalesce((SELECT string_agg('\"' || k || '\":' || CAST(n AS VARCHAR), ',' ORDER BY k) FROM "
            f"(SELECT {col} AS k, count(*) AS n FROM s WHERE s.viewer_id = v.viewer_id GROUP BY {col})), '') || '}}'")


register("json_dashboard", ", s AS (" + " UNION ALL ".join(
    f"SELECT {uid} AS viewer_id, * FROM hazards WHERE {scope_sql(uid, role)}" for uid, role in _VIEWERS) + f"""),
v AS (SELECT unnest([{', '.join(str(u) for u, _ in _VIEWERS)}]) AS viewer_id),
k AS (SELECT viewer_id, {kpi_cols()} FROM s GROUP BY viewer_id)
SELECT v.viewer_id, '{{"OpenCount":' || coalesce(open_count, 0) || ',"InProgressCount":' || coalesce(in_progress_count, 0)
       || ',"ResolvedCount":' || coalesce(resolved_count, 0) || ',"OverdueOpenCount":' || coalesce(overdue_count, 0)
       || ',"BySeverity":' || {_map_sql('severity')} || ',"ByType":' || {_map_sql('type')} || '}}' AS json
FROM v LEFT JOIN k ON k.viewer_id = v.viewer_id""")

# S5-S7 ----------------------------------------------------------------------

# Written out rule by rule, apart from the lists that the checks are built from.
register("dq_unique", """
SELECT 'users' AS table_name, 'user_id' AS key_columns, CAST(user_id AS VARCHAR) AS key_value, count(*) AS n
FROM users GROUP BY user_id HAVING count(*) > 1
UNION ALL SELECT 'users', 'user_name', lower(user_name), count(*) FROM users GROUP BY lower(user_name) HAVING count(*) > 1
UNION ALL SELECT 'hazards', 'hazard_id', CAST(hazard_id AS VARCHAR), count(*) FROM hazards GROUP BY hazard_id HAVING count(*) > 1
UNION ALL SELECT 'hazard_logs', 'hazard_log_id', CAST(hazard_log_id AS VARCHAR), count(*) FROM hazard_logs
GROUP BY hazard_log_id HAVING count(*) > 1
UNION ALL SELECT 'hazard_attachments', 'attachment_id', CAST(attachment_id AS VARCHAR), count(*) FROM hazard_attachments
GROUP BY attachment_id HAVING count(*) > 1""")
register("dq_foreign_keys", """
SELECT 'hazards' AS child_table, 'reported_by_user_id' AS fk_column, 'users' AS parent_table,
       CAST(reported_by_user_id AS VARCHAR) AS key_value, count(*) AS n
FROM hazards WHERE reported_by_user_id NOT IN (SELECT user_id FROM users WHERE user_id IS NOT NULL) GROUP BY reported_by_user_id
UNION ALL SELECT 'hazards', 'assigned_to_user_id', 'users', CAST(assigned_to_user_id AS VARCHAR), count(*)
FROM hazards WHERE assigned_to_user_id NOT IN (SELECT user_id FROM users WHERE user_id IS NOT NULL) GROUP BY assigned_to_user_id
UNION ALL SELECT 'hazard_logs', 'hazard_id', 'hazards', CAST(hazard_id AS VARCHAR), count(*)
FROM hazard_logs WHERE hazard_id NOT IN (SELECT hazard_id FROM hazards WHERE hazard_id IS NOT NULL) GROUP BY hazard_id
UNION ALL SELECT 'hazard_logs', 'performed_by_user_id', 'users', CAST(performed_by_user_id AS VARCHAR), count(*)
FROM hazard_logs WHERE performed_by_user_id NOT IN (SELECT user_id FROM users WHERE user_id IS NOT NULL) GROUP BY performed_by_user_id
UNION ALL SELECT 'hazard_attachments', 'hazard_id', 'hazards', CAST(hazard_id AS VARCHAR), count(*)
FROM hazard_attachments WHERE hazard_id NOT IN (SELECT hazard_id FROM hazards WHERE hazard_id IS NOT NULL) GROUP BY hazard_id
UNION ALL SELECT 'hazard_attachments', 'uploaded_by_user_id', 'users', CAST(uploaded_by_user_id AS VARCHAR), count(*)
FROM hazard_attachments WHERE uploaded_by_user_id NOT IN (SELECT user_id FROM users WHERE user_id IS NOT NULL)
GROUP BY uploaded_by_user_id""")
register("dq_row_rules", """
, per_user AS (SELECT count(*) - count(user_id), count(*) - count(user_name), count(*) - count(full_name), count(*) - count(role),
         count(*) - count(is_active), count(*) FILTER (length(user_name) > 50), count(*) FILTER (length(full_name) > 100),
         count(*) FILTER (length(role) > 50), count(*) FILTER (role NOT IN ('FieldWorker', 'SiteManager', 'SafetyOfficer')) FROM users),
per_hazard AS (SELECT count(*) - count(hazard_id), count(*) - count(title), count(*) - count(reported_by_user_id), count(*) - count(status),
         count(*) - count(severity), count(*) - count(type), count(*) - count(created_at), count(*) FILTER (length(title) > 200),
         count(*) FILTER (length(description) > 2000), count(*) FILTER (length(status) > 30), count(*) FILTER (length(severity) > 30),
         count(*) FILTER (length(type) > 30), count(*) FILTER (status NOT IN ('Open', 'InProgress', 'Resolved')),
         count(*) FILTER (severity NOT IN ('Low', 'Medium', 'High', 'Critical')),
         count(*) FILTER (type NOT IN ('Fire', 'Electrical', 'Chemical', 'Equipment', 'Physical', 'General')) FROM hazards),
per_log AS (SELECT count(*) - count(hazard_log_id), count(*) - count(hazard_id), count(*) - count(action_type),
         count(*) - count(performed_by_user_id), count(*) - count(created_at), count(*) FILTER (length(action_type) > 50),
         count(*) FILTER (length(details) > 2000),
         count(*) FILTER (action_type NOT IN ('Created', 'UpdatedDetails', 'Assigned', 'StatusChanged', 'Comment')) FROM hazard_logs),
per_file AS (SELECT count(*) - count(attachment_id), count(*) - count(hazard_id), count(*) - count(file_name), count(*) - count(uploaded_at),
         count(*) FILTER (length(file_name) > 255), count(*) FILTER (length(content_type) > 100),
         count(*) FILTER (length(storage_path) > 500) FROM hazard_attachments),
u(a, b, c, d, e, f, g, h, i) AS (FROM per_user), z(a, b, c, d, e, f, g, h, i, j, k, l, m, n, o) AS (FROM per_hazard),
w(a, b, c, d, e, f, g, h) AS (FROM per_log), t(a, b, c, d, e, f, g) AS (FROM per_file)
SELECT 'users' AS table_name, unnest(['not_null:user_id', 'not_null:user_name', 'not_null:full_name', 'not_null:role', 'not_null:is_active',
         'max_len:user_name', 'max_len:full_name', 'max_len:role', 'domain:role']) AS rule,
       unnest([a, b, c, d, e, f, g, h, i]) AS violations FROM u
UNION ALL
SELECT 'hazards', unnest(['not_null:hazard_id', 'not_null:title', 'not_null:reported_by_user_id', 'not_null:status', 'not_null:severity',
         'not_null:type', 'not_null:created_at', 'max_len:title', 'max_len:description', 'max_len:status', 'max_len:severity',
         'max_len:type', 'domain:status', 'domain:severity', 'domain:type']),
       unnest([a, b, c, d, e, f, g, h, i, j, k, l, m, n, o]) FROM z
UNION ALL
SELECT 'hazard_logs', unnest(['not_null:hazard_log_id', 'not_null:hazard_id', 'not_null:action_type', 'not_null:performed_by_user_id',
         'not_null:created_at', 'max_len:action_type', 'max_len:details', 'domain:action_type']),
       unnest([a, b, c, d, e, f, g, h]) FROM w
UNION ALL
SELECT 'hazard_attachments', unnest(['not_null:attachment_id', 'not_null:hazard_id', 'not_null:file_name', 'not_null:uploaded_at',
         'max_len:file_name', 'max_len:content_type', 'max_len:storage_path']),
       unnest([a, b, c, d, e, f, g]) FROM t""")

# T15 ------------------------------------------------------------------------
register("login_key", f"""
SELECT login_id, coalesce(ip, 'unknown') || '|' ||
       CASE WHEN coalesce(regexp_replace(user_name, '{WS}', '', 'g') = '', TRUE) THEN 'unknown'
            ELSE lower(user_name) END AS login_key
FROM login_events""")


# L1, L2: one event per key and step ------------------------------------------
def register_steps(name: str, body: str) -> None:
    SQL[name] = BINDING.replace("WITH users", "WITH RECURSIVE users", 1) + body


_COUNT = "CASE WHEN r.ws IS NULL OR e.ts - r.ws > INTERVAL 7 DAY THEN 1 ELSE r.cnt + 1 END"
_REFUSED = "coalesce(r.bu > e.ts, FALSE)"
LOCKOUT = f"""
, e AS (SELECT lower(trim(user_name)) AS key, login_id, ts, success,
               row_number() OVER (PARTITION BY lower(trim(user_name)) ORDER BY ts, login_id) AS rn FROM login_events),
r AS (
  SELECT key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS login_id, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BOOLEAN) AS success,
         CAST(NULL AS VARCHAR) AS outcome, 0 AS failure_count, CAST(NULL AS INT) AS retry_after_minutes,
         CAST(NULL AS TIMESTAMP) AS ws, 0 AS cnt, CAST(NULL AS TIMESTAMP) AS bu
  FROM (SELECT DISTINCT key FROM e)
  UNION ALL
  SELECT e.key, e.rn, e.login_id, e.ts, e.success,
         CASE WHEN {_REFUSED} THEN 'refused' WHEN e.success THEN 'allowed' ELSE 'failed' END,
         CASE WHEN {_REFUSED} THEN r.cnt WHEN e.success THEN 0 ELSE {_COUNT} END,
         CASE WHEN {_REFUSED} THEN CAST(greatest(1, ceil(epoch(r.bu - e.ts) / 60.0)) AS INT) END,
         CASE WHEN {_REFUSED} THEN r.ws WHEN e.success THEN NULL
              WHEN r.ws IS NULL OR e.ts - r.ws > INTERVAL 7 DAY THEN e.ts ELSE r.ws END,
         CASE WHEN {_REFUSED} THEN r.cnt WHEN e.success THEN 0 ELSE {_COUNT} END,
         CASE WHEN {_REFUSED} THEN r.bu WHEN e.success THEN NULL WHEN {_COUNT} >= 3 THEN e.ts + INTERVAL 2 DAY ELSE r.bu END
  FROM r JOIN e ON e.key = r.key AND e.rn = r.rn + 1)
SELECT key, login_id, ts, success, outcome, failure_count, retry_after_minutes FROM r WHERE rn > 0"""
register_steps("lockout_batch", LOCKOUT)
register_steps("lockout_stream", LOCKOUT)

# One command per hazard and step ------------------------------------
_RES = (f"CASE kind WHEN 'update' THEN {UPDATE_RES} WHEN 'assign' THEN {ASSIGN_RES} "
        f"WHEN 'change_status' THEN {STATUS_RES} ELSE {COMMENT_RES} END")
_MOVES = f"(result = 'OK' AND kind = 'change_status' AND NOT {BLANK_STATUS})"
STEPS = CTX + f"""
, c AS (SELECT * EXCLUDE (h_rep, h_asg, h_status), row_number() OVER (PARTITION BY hazard_id ORDER BY command_ts, command_id) AS rn
        FROM ctx WHERE kind <> 'create'),
s AS (
  SELECT k.hazard_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS command_id, CAST(NULL AS VARCHAR) AS result,
         CAST(NULL AS VARCHAR) AS log_text, h.reported_by_user_id AS h_rep, h.assigned_to_user_id AS h_asg, h.status AS h_status
  FROM (SELECT DISTINCT hazard_id FROM c) k LEFT JOIN hazards h ON h.hazard_id = k.hazard_id
  UNION ALL
  SELECT hazard_id, rn, command_id, result,
         CASE WHEN {_MOVES} THEN coalesce(h_status, '') || ' -> ' || trim(new_status)
                || CASE WHEN details IS NULL OR rtrim(details) = '' THEN '' ELSE ' | ' || details END
              WHEN kind IN ('update', 'assign') THEN '' ELSE details END,
         h_rep, CASE WHEN result = 'OK' AND kind = 'assign' THEN assign_to_user_id ELSE h_asg END,
         CASE WHEN {_MOVES} THEN CASE ns_u WHEN 'OPEN' THEN 'Open' WHEN 'INPROGRESS' THEN 'InProgress' ELSE 'Resolved' END
              ELSE h_status END
  FROM (SELECT c.*, s.h_rep, s.h_asg, s.h_status, {_RES} AS result
        FROM s JOIN c ON c.hazard_id IS NOT DISTINCT FROM s.hazard_id AND c.rn = s.rn + 1) x),
done AS (SELECT c.*, s.result, s.log_text,
                CASE WHEN s.result = 'OK' THEN CASE WHEN c.kind = 'update' THEN 'UpdatedDetails' WHEN c.kind = 'assign' THEN 'Assigned'
                     WHEN c.kind = 'change_status' AND NOT {BLANK_STATUS} THEN 'StatusChanged' ELSE 'Comment' END END AS action
         FROM s JOIN c ON c.command_id = s.command_id WHERE s.rn > 0),
made AS (SELECT *, CASE WHEN result = 'OK' THEN (SELECT max(hazard_id) FROM hazards)
                        + row_number() OVER (PARTITION BY result = 'OK' ORDER BY command_id) END AS new_hazard_id
         FROM (SELECT ctx.*, {CREATE_RES} AS result FROM ctx WHERE kind = 'create'))
"""
APPLIED = STEPS + """
SELECT command_id, hazard_id, kind, performed_by_user_id, result, action FROM done
UNION ALL
SELECT command_id, hazard_id, kind, performed_by_user_id, result, CASE WHEN result = 'OK' THEN 'Created' END FROM made"""
register_steps("apply_commands", APPLIED)
register_steps("apply_commands_stream", APPLIED)
AFTER = STEPS + """
, fin AS (SELECT hazard_id AS f_id, h_asg, h_status FROM (
            SELECT *, row_number() OVER (PARTITION BY hazard_id ORDER BY rn DESC) AS last FROM s) WHERE last = 1),
upd AS (SELECT * FROM (SELECT done.*, row_number() OVER (PARTITION BY hazard_id ORDER BY command_ts DESC, command_id DESC) AS last
                       FROM done WHERE kind = 'update' AND result = 'OK') WHERE last = 1),
hazards_after AS (
SELECT h.hazard_id, CASE WHEN u.command_id IS NULL THEN h.title ELSE coalesce(u.title, '') END AS title,
       CASE WHEN u.command_id IS NULL THEN h.description ELSE coalesce(u.description, '') END AS description,
       h.reported_by_user_id, CASE WHEN f.f_id IS NULL THEN h.assigned_to_user_id ELSE f.h_asg END AS assigned_to_user_id,
       coalesce(f.h_status, h.status) AS status,
       CASE WHEN u.command_id IS NULL THEN h.severity ELSE coalesce(u.severity, 'Low') END AS severity,
       CASE WHEN u.command_id IS NULL THEN h.type ELSE coalesce(u.type, 'General') END AS type, h.created_at,
       CASE WHEN u.command_id IS NULL THEN h.due_date ELSE u.due_date END AS due_date
FROM hazards h LEFT JOIN fin f ON f.f_id = h.hazard_id LEFT JOIN upd u ON u.hazard_id = h.hazard_id
UNION ALL
SELECT new_hazard_id, coalesce(title, ''), coalesce(description, ''), reported_by_user_id, NULL, 'Open', coalesce(severity, 'Low'),
       coalesce(type, 'General'), command_ts, due_date
FROM made WHERE result = 'OK')
"""
register_steps("apply_hazards", AFTER + "SELECT * FROM hazards_after")


def after_commands(name: str) -> str:
    """A registered query's own part, over the hazards after all commands."""
    return AFTER + SQL[name][len(BINDING):].replace("JOIN hazards h", "JOIN hazards_after h")


register_steps("grants_after_apply", after_commands("visible_pairs"))
register_steps("dashboard_kpi_after_apply", after_commands("dashboard_all_kpi"))
register_steps("dashboard_type_after_apply", after_commands("dashboard_all_type"))
register_steps("apply_logs", STEPS + """
, added AS (SELECT command_ts, command_id, hazard_id, action AS action_type, log_text AS details, performed_by_user_id FROM done WHERE result = 'OK'
            UNION ALL
            SELECT command_ts, command_id, new_hazard_id, 'Created', '', performed_by_user_id FROM made WHERE result = 'OK')
SELECT hazard_log_id, hazard_id, action_type, details, performed_by_user_id, created_at FROM hazard_logs
UNION ALL
SELECT (SELECT max(hazard_log_id) FROM hazard_logs) + row_number() OVER (ORDER BY command_ts, command_id), hazard_id, action_type, details,
       performed_by_user_id, command_ts FROM added""")
