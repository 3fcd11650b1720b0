"""The demo seed set of the register (users, hazards and their logs).

Used by the upsert and reload operators and by unit tests.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
TITLE_PREFIX = "Demo:"
TITLE_ASSIGNED = "Demo: Overdue Open"
TITLE_MOVED = "Demo: In Progress"
LOG_CREATED = "Demo seed: hazard created"
LOG_ASSIGNED = "Demo seed: assigned by system"
LOG_MOVED = "Demo seed: moved to InProgress"
# ---------------------------------------------------------------------------


# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's seed for right results.
SEED_USERS = (
    # (seq, user_name, full_name, role)
    (1, "safety", "Safety Officer", "SafetyOfficer"),
    (2, "manager", "Site Manager", "SiteManager"),
    (3, "worker", "Field Worker", "FieldWorker"),
)
SEED_HAZARDS = (
    # (seq, title, description, severity, type, status, due, reporter, assignee)
    (1, "Demo: Overdue Open – Unlabelled chemical containers",
     "Several containers are missing labels in the storage area.",
     "High", "Chemical", "Open", dt.datetime(2025, 12, 1), "worker", "manager"),
    (2, "Demo: In Progress – Missing guard rails on scaffold",
     "Guard rails are partially missing on level 2 scaffold.",
     "Medium", "Physical", "InProgress", dt.datetime(2026, 1, 20), "worker", "worker"),
    (3, "Demo: Resolved – Exposed electrical wiring in hallway",
     "Exposed wiring found near the main hallway panel.",
     "Critical", "Electrical", "Resolved", dt.datetime(2025, 12, 15), "manager", "manager"),
    (4, "Demo: Open (Unassigned) – Slippery floor near entrance",
     "Wet floor reported near the entrance, no signage.",
     "Low", "Physical", "Open", dt.datetime(2026, 2, 1), "worker", None),
)
# ---------------------------------------------------------------------------

SEED_USER_SCHEMA = T.StructType([
    T.StructField("seq", T.IntegerType(), False),
    T.StructField("user_name", T.StringType(), False),
    T.StructField("full_name", T.StringType(), False),
    T.StructField("role", T.StringType(), False),
    T.StructField("is_active", T.BooleanType(), False),
])

SEED_HAZARD_SCHEMA = T.StructType([
    T.StructField("seq", T.IntegerType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("severity", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("due_date", T.TimestampNTZType(), True),
    T.StructField("reporter_name", T.StringType(), False),
    T.StructField("assignee_name", T.StringType(), True),
])


def seed_users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, u, f, r, True) for s, u, f, r in SEED_USERS], SEED_USER_SCHEMA)


def seed_hazards(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEED_HAZARDS), SEED_HAZARD_SCHEMA)
