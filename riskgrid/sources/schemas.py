"""Declared schemas and value domains of the register.

Nothing is inferred: every table has a fixed StructType. Password columns of
the user table are never part of the engine's ``users``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
ROLE_SAFETY_OFFICER = "SafetyOfficer"
ROLE_SITE_MANAGER = "SiteManager"
ROLE_FIELD_WORKER = "FieldWorker"
ROLES = (ROLE_FIELD_WORKER, ROLE_SITE_MANAGER, ROLE_SAFETY_OFFICER)

STATUS_OPEN = "Open"
STATUS_IN_PROGRESS = "InProgress"
STATUS_RESOLVED = "Resolved"
STATUSES = (STATUS_OPEN, STATUS_IN_PROGRESS, STATUS_RESOLVED)
STATUS_LABELS = {"InProgress": "In Progress"}

SEVERITIES = ("Low", "Medium", "High", "Critical")
TYPES = ("Fire", "Electrical", "Chemical", "Equipment", "Physical", "General")

ACTION_CREATED = "Created"
ACTION_UPDATED = "UpdatedDetails"
ACTION_ASSIGNED = "Assigned"
ACTION_STATUS_CHANGED = "StatusChanged"
ACTION_COMMENT = "Comment"
ACTIONS = (ACTION_CREATED, ACTION_UPDATED, ACTION_ASSIGNED, ACTION_STATUS_CHANGED, ACTION_COMMENT)

RESULT_OK = "OK"
RESULT_UNAUTHORIZED = "Unauthorized"
RESULT_BAD_REQUEST = "BadRequest"
RESULT_NOT_FOUND = "NotFound"
RESULT_FORBIDDEN = "Forbidden"

# Declared NVARCHAR lengths.
MAX_LEN = {
    ("users", "user_name"): 50,
    ("users", "full_name"): 100,
    ("users", "role"): 50,
    ("hazards", "title"): 200,
    ("hazards", "description"): 2000,
    ("hazards", "status"): 30,
    ("hazards", "severity"): 30,
    ("hazards", "type"): 30,
    ("hazard_logs", "action_type"): 50,
    ("hazard_logs", "details"): 2000,
    ("hazard_attachments", "file_name"): 255,
    ("hazard_attachments", "content_type"): 100,
    ("hazard_attachments", "storage_path"): 500,
}
# ---------------------------------------------------------------------------

USERS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("user_name", T.StringType(), False),
    T.StructField("full_name", T.StringType(), False),
    T.StructField("role", T.StringType(), False),
    T.StructField("is_active", T.BooleanType(), False),
])

HAZARDS = T.StructType([
    T.StructField("hazard_id", T.LongType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("reported_by_user_id", T.LongType(), False),
    T.StructField("assigned_to_user_id", T.LongType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("due_date", T.TimestampNTZType(), True),
])

HAZARD_LOGS = T.StructType([
    T.StructField("hazard_log_id", T.LongType(), False),
    T.StructField("hazard_id", T.LongType(), False),
    T.StructField("action_type", T.StringType(), False),
    T.StructField("details", T.StringType(), True),
    T.StructField("performed_by_user_id", T.LongType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
])

HAZARD_ATTACHMENTS = T.StructType([
    T.StructField("attachment_id", T.LongType(), False),
    T.StructField("hazard_id", T.LongType(), False),
    T.StructField("file_name", T.StringType(), False),
    T.StructField("content_type", T.StringType(), True),
    T.StructField("file_size_bytes", T.IntegerType(), True),
    T.StructField("storage_path", T.StringType(), True),
    T.StructField("uploaded_by_user_id", T.LongType(), True),
    T.StructField("uploaded_at", T.TimestampNTZType(), False),
])

HAZARD_COMMANDS = T.StructType([
    T.StructField("command_id", T.LongType(), False),
    T.StructField("command_ts", T.TimestampNTZType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("hazard_id", T.LongType(), True),
    T.StructField("performed_by_user_id", T.LongType(), True),
    T.StructField("new_status", T.StringType(), True),
    T.StructField("assign_to_user_id", T.LongType(), True),
    T.StructField("details", T.StringType(), True),
    T.StructField("reported_by_user_id", T.LongType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("severity", T.StringType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("due_date", T.TimestampNTZType(), True),
])

LOGIN_EVENTS = T.StructType([
    T.StructField("login_id", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("ip", T.StringType(), True),
    T.StructField("user_name", T.StringType(), True),
    T.StructField("success", T.BooleanType(), False),
])

TABLES = {
    "users": USERS,
    "hazards": HAZARDS,
    "hazard_logs": HAZARD_LOGS,
    "hazard_attachments": HAZARD_ATTACHMENTS,
    "hazard_commands": HAZARD_COMMANDS,
    "login_events": LOGIN_EVENTS,
}

# Primary and unique keys declared in the DDL.
UNIQUE_KEYS = (
    ("users", ("user_id",)),
    ("users", ("user_name",)),
    ("hazards", ("hazard_id",)),
    ("hazard_logs", ("hazard_log_id",)),
    ("hazard_attachments", ("attachment_id",)),
)

# Foreign keys declared in the DDL: (child, column, parent, parent column).
FOREIGN_KEYS = (
    ("hazards", "reported_by_user_id", "users", "user_id"),
    ("hazards", "assigned_to_user_id", "users", "user_id"),
    ("hazard_logs", "hazard_id", "hazards", "hazard_id"),
    ("hazard_logs", "performed_by_user_id", "users", "user_id"),
    ("hazard_attachments", "hazard_id", "hazards", "hazard_id"),
    ("hazard_attachments", "uploaded_by_user_id", "users", "user_id"),
)
