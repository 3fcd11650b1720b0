"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables through the register binding and runs
over whole tables; viewers, the clock and filter values are the fixed test
constants of the binding.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import binding as B
from ..sources import schemas as S
from ..operators import dashboard as A
from ..operators import listing as L
from ..operators import scope as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = B.NOW
OFFICER = (B.VIEWER_OFFICER, S.ROLE_SAFETY_OFFICER)
MANAGER = (B.VIEWER_MANAGER, S.ROLE_SITE_MANAGER)
WORKER = (B.VIEWER_WORKER, S.ROLE_FIELD_WORKER)
VIEWERS = (OFFICER, MANAGER, WORKER)


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def reg(spark: SparkSession, sf_dir: str) -> B.Register:
    return B.load(spark, sf_dir)


# S1-S4 ----------------------------------------------------------------------
@query("src_users")
def q_src_users(spark, d):
    return reg(spark, d).users


@query("src_hazards")
def q_src_hazards(spark, d):
    return reg(spark, d).hazards


@query("src_hazard_logs")
def q_src_hazard_logs(spark, d):
    return reg(spark, d).hazard_logs


@query("src_hazard_attachments")
def q_src_hazard_attachments(spark, d):
    return reg(spark, d).hazard_attachments


# V1 -------------------------------------------------------------------------
@query("scope_officer")
def q_scope_officer(spark, d):
    return V.scope(reg(spark, d).hazards, *OFFICER)


@query("scope_manager")
def q_scope_manager(spark, d):
    return V.scope(reg(spark, d).hazards, *MANAGER)


@query("scope_worker")
def q_scope_worker(spark, d):
    return V.scope(reg(spark, d).hazards, *WORKER)


@query("visible_pairs")
def q_visible_pairs(spark, d):
    r = reg(spark, d)
    return V.visible_grants(r.users, r.hazards)


# F1-F7, F10, F11 ------------------------------------------------------------
@query("filter_search")
def q_filter_search(spark, d):
    return L.filter_search(reg(spark, d).hazards, "a_e")


@query("filter_status")
def q_filter_status(spark, d):
    return L.filter_status(reg(spark, d).hazards, "inPROGRESS ")


@query("filter_severity")
def q_filter_severity(spark, d):
    return L.filter_severity(reg(spark, d).hazards, "CRITICAL")


@query("filter_type")
def q_filter_type(spark, d):
    return L.filter_type(reg(spark, d).hazards, "chemical")


@query("filter_assignee")
def q_filter_assignee(spark, d):
    return L.filter_assignee(reg(spark, d).hazards, B.VIEWER_MANAGER)


@query("filter_overdue")
def q_filter_overdue(spark, d):
    return L.filter_overdue(reg(spark, d).hazards, NOW)


@query("filter_created_range")
def q_filter_created_range(spark, d):
    return L.filter_created_range(reg(spark, d).hazards, dt.datetime(1996, 1, 1),
                                  dt.datetime(1996, 6, 30, 23, 59, 59))


@query("filter_title_prefix")
def q_filter_title_prefix(spark, d):
    return L.filter_title_prefix(reg(spark, d).hazards, "demo:")


@query("users_by_role")
def q_users_by_role(spark, d):
    return L.users_by_role(reg(spark, d).users, "sitemanager")


# F8 -------------------------------------------------------------------------
LIST_FILTER = L.HazardFilter.from_form(search_text="  Rail ", overdue_only=True, role=S.ROLE_SITE_MANAGER)


@query("hazard_list")
def q_hazard_list(spark, d):
    r = reg(spark, d)
    return L.hazard_list(r.hazards, r.users, *MANAGER, LIST_FILTER, NOW)


# J1-J3 ----------------------------------------------------------------------
@query("join_reporter")
def q_join_reporter(spark, d):
    r = reg(spark, d)
    return L.join_reporter(r.hazards, r.users).select("hazard_id", "reported_by_user_id", "reported_by_name")


@query("join_assignee")
def q_join_assignee(spark, d):
    r = reg(spark, d)
    return L.join_assignee(r.hazards, r.users).select("hazard_id", "assigned_to_user_id", "assigned_to_name")


@query("join_log_performer")
def q_join_log_performer(spark, d):
    r = reg(spark, d)
    return L.join_log_performer(r.hazard_logs, r.users).select(
        "hazard_log_id", "hazard_id", "performed_by_user_id", "performed_by_name")


# A1-A5 ----------------------------------------------------------------------
@query("kpi_officer")
def q_kpi_officer(spark, d):
    return A.kpi(V.scope(reg(spark, d).hazards, *OFFICER), NOW)


@query("kpi_manager")
def q_kpi_manager(spark, d):
    return A.kpi(V.scope(reg(spark, d).hazards, *MANAGER), NOW)


@query("kpi_worker")
def q_kpi_worker(spark, d):
    return A.kpi(V.scope(reg(spark, d).hazards, *WORKER), NOW)


@query("breakdown_severity")
def q_breakdown_severity(spark, d):
    return A.breakdown(V.scope(reg(spark, d).hazards, *MANAGER), "severity")


@query("breakdown_type")
def q_breakdown_type(spark, d):
    return A.breakdown(V.scope(reg(spark, d).hazards, *MANAGER), "type")


@query("breakdown_percent")
def q_breakdown_percent(spark, d):
    return A.breakdown_percent(A.breakdown(V.scope(reg(spark, d).hazards, *MANAGER), "severity"), "severity")


@query("dashboard")
def q_dashboard(spark, d):
    return A.dashboard(V.scope(reg(spark, d).hazards, *MANAGER), NOW)


# A6 / A7 --------------------------------------------------------------------
@query("dashboard_all_kpi")
def q_dashboard_all_kpi(spark, d):
    r = reg(spark, d)
    return A.dashboard_all_kpi(r.users, r.hazards, NOW)


@query("dashboard_all_severity")
def q_dashboard_all_severity(spark, d):
    r = reg(spark, d)
    return A.dashboard_all_breakdown(r.users, r.hazards, "severity")


@query("dashboard_all_type")
def q_dashboard_all_type(spark, d):
    r = reg(spark, d)
    return A.dashboard_all_breakdown(r.users, r.hazards, "type")


@query("drilldown_consistency")
def q_drilldown_consistency(spark, d):
    r = reg(spark, d)
    return A.drilldown_consistency(r.hazards, r.users, *MANAGER, NOW)


# ---------------------------------------------------------------------------
# Requests and (viewer, hazard) rows derived from the command table: every
# command is one request by its performer for its hazard.
def command_requests(r: B.Register, *extra: str) -> DataFrame:
    # Merged, as hazard states are: the users are a table of their own size.
    u = r.users.select(F.col("user_id").alias("_u"), F.col("role")).hint("merge")
    c = r.hazard_commands
    return (c.join(u, c["performed_by_user_id"] == u["_u"], "left")
            .select(F.col("command_id").alias("request_id"), "hazard_id",
                    F.col("performed_by_user_id").alias("user_id"), "role", *extra))


def policy_rows(r: B.Register) -> DataFrame:
    """(command, viewer role, hazard state) rows for the policy columns."""
    req = command_requests(r, "new_status")
    h = V.hazard_state(r.hazards)
    return (req.join(h, req["hazard_id"] == h["h_hazard_id"], "left")
            .withColumn("h_exists", F.col("h_hazard_id").isNotNull()))


# V2 -------------------------------------------------------------------------
@query("access_flags")
def q_access_flags(spark, d):
    r = reg(spark, d)
    return V.access_flags(command_requests(r), r.hazards)


# J4-J6, J8-J10 --------------------------------------------------------------
@query("semi_eligible_assignee")
def q_semi_eligible_assignee(spark, d):
    r = reg(spark, d)
    c = r.hazard_commands.where(F.col("kind") == "assign").select("command_id", "assign_to_user_id")
    return L.semi_eligible_assignee(c, r.users)


@query("semi_active_reporter")
def q_semi_active_reporter(spark, d):
    r = reg(spark, d)
    c = r.hazard_commands.where(F.col("kind") == "create").select("command_id", "reported_by_user_id")
    return L.semi_active_reporter(c, r.users)


@query("performer_role")
def q_performer_role(spark, d):
    r = reg(spark, d)
    return L.performer_role(r.hazard_commands.select("command_id", "performed_by_user_id"), r.users)


@query("hazard_detail")
def q_hazard_detail(spark, d):
    r = reg(spark, d)
    req = command_requests(r)
    return L.hazard_detail(req, r.hazards_of(req), r.users)


@query("hazard_history")
def q_hazard_history(spark, d):
    r = reg(spark, d)
    logs = L.scoped_logs(r.hazard_logs, r.hazards, r.users, VIEWERS)
    return logs.orderBy("viewer_id", "hazard_id", F.col("created_at").desc(), F.col("hazard_log_id").desc())


@query("user_by_name")
def q_user_by_name(spark, d):
    r = reg(spark, d)
    return L.user_by_name(r.login_events.select("login_id", "user_name"), r.users).select(
        "login_id", "user_id", "found_user_name", "full_name", "role", "is_active")


# W1-W5, P9 ------------------------------------------------------------------
from ..operators import commands as W  # noqa: E402
from ..sources import seed as SEED  # noqa: E402


def _validated(r: B.Register, kind: str) -> DataFrame:
    return W.validate(r.hazard_commands.where(F.col("kind") == kind), r.users, r.hazards)


@query("cmd_create")
def q_cmd_create(spark, d):
    r = reg(spark, d)
    return W.validate_creates(r.hazard_commands, r.users, r.hazards).select("command_id", "result", "new_hazard_id")


@query("cmd_update")
def q_cmd_update(spark, d):
    return _validated(reg(spark, d), W.KIND_UPDATE).select("command_id", "result")


@query("cmd_assign")
def q_cmd_assign(spark, d):
    return _validated(reg(spark, d), W.KIND_ASSIGN).select("command_id", "result")


@query("cmd_change_status")
def q_cmd_change_status(spark, d):
    return _validated(reg(spark, d), W.KIND_STATUS).select("command_id", "result", "action")


@query("cmd_comment")
def q_cmd_comment(spark, d):
    return _validated(reg(spark, d), W.KIND_COMMENT).select("command_id", "result")


@query("effective_edit")
def q_effective_edit(spark, d):
    r = reg(spark, d)
    return W.effective_edit(r.hazard_commands.where(F.col("kind") == W.KIND_UPDATE), r.users, r.hazards)


# W7-W9 ----------------------------------------------------------------------
@query("upsert_users")
def q_upsert_users(spark, d):
    return W.upsert_users(reg(spark, d).users, SEED.seed_users(spark))


@query("purge_demo_hazards")
def q_purge_demo_hazards(spark, d):
    r = reg(spark, d)
    return W.purge(r.hazards, W.demo_ids(r.hazards))


@query("purge_demo_logs")
def q_purge_demo_logs(spark, d):
    r = reg(spark, d)
    return W.purge(r.hazard_logs, W.demo_ids(r.hazards))


@query("purge_demo_attachments")
def q_purge_demo_attachments(spark, d):
    r = reg(spark, d)
    return W.purge(r.hazard_attachments, W.demo_ids(r.hazards))


def _reload(spark, d):
    r = reg(spark, d)
    users = W.upsert_users(r.users, SEED.seed_users(spark))
    return W.reload_demo(r.hazards, r.hazard_logs, users, SEED.seed_hazards(spark), NOW)


@query("reload_demo_hazards")
def q_reload_demo_hazards(spark, d):
    return _reload(spark, d)[0]


@query("reload_demo_logs")
def q_reload_demo_logs(spark, d):
    return _reload(spark, d)[1]


# P1-P8 ----------------------------------------------------------------------
from ..functions import policy as P  # noqa: E402
from ..functions import text as T  # noqa: E402
from ..operators import export as E  # noqa: E402

_PARGS = ("role", "user_id", "h_reporter", "h_assignee", "h_status", "h_exists")


@query("policy_can_view")
def q_policy_can_view(spark, d):
    return policy_rows(reg(spark, d)).select("request_id", P.can_view(*_PARGS).alias("can_view"))


@query("policy_can_edit")
def q_policy_can_edit(spark, d):
    return policy_rows(reg(spark, d)).select("request_id", P.can_edit_details(*_PARGS).alias("can_edit"))


@query("policy_can_self_assign")
def q_policy_can_self_assign(spark, d):
    return policy_rows(reg(spark, d)).select(
        "request_id", P.can_self_assign("role", "h_assignee", "h_status", "h_exists").alias("can_self_assign"))


@query("policy_can_assign_other")
def q_policy_can_assign_other(spark, d):
    return policy_rows(reg(spark, d)).select("request_id", P.can_assign_to_other("role").alias("can_assign_other"))


@query("policy_can_change_status")
def q_policy_can_change_status(spark, d):
    return policy_rows(reg(spark, d)).select(
        "request_id", P.can_change_status(*_PARGS, F.col("new_status")).alias("can_change_status"))


@query("policy_next_statuses")
def q_policy_next_statuses(spark, d):
    nxt = P.allowed_next_statuses("role", "user_id", "h_assignee", "h_status", "h_exists")
    return policy_rows(reg(spark, d)).select("request_id", F.array_join(nxt, ",").alias("next_statuses"))


@query("policy_can_comment")
def q_policy_can_comment(spark, d):
    return policy_rows(reg(spark, d)).select("request_id", P.can_add_comment("role").alias("can_comment"))


@query("row_actions")
def q_row_actions(spark, d):
    acts = P.row_actions(*_PARGS)
    return policy_rows(reg(spark, d)).select("request_id", *[c.alias(n) for n, c in acts.items()])


# T1-T16 ---------------------------------------------------------------------
def _officer_list(r: B.Register) -> DataFrame:
    return L.hazard_list(r.hazards, r.users, *OFFICER, L.HazardFilter(), NOW, ordered=False)


@query("scalar_trim_blank")
def q_scalar_trim_blank(spark, d):
    c = reg(spark, d).hazard_commands
    return c.select("command_id", T.trim_or_empty("details").alias("details_trimmed"),
                    T.is_blank("details").alias("details_blank"))


@query("scalar_canonical")
def q_scalar_canonical(spark, d):
    c = reg(spark, d).hazard_commands
    return c.select("command_id", T.canonical_status("new_status").alias("status_canonical"),
                    T.canonical_severity("severity").alias("severity_canonical"),
                    T.canonical_type("type").alias("type_canonical"))


@query("scalar_type_fallback")
def q_scalar_type_fallback(spark, d):
    return reg(spark, d).hazards.select("hazard_id", "type", T.type_or_general("type").alias("edit_type"))


@query("classify")
def q_classify(spark, d):
    found = reg(spark, d).hazards.select("hazard_id", T.classify("description").alias("found"))
    return found.select("hazard_id", F.col("found.type").alias("suggested_type"),
                        F.col("found.severity").alias("suggested_severity"))


@query("scalar_status_log")
def q_scalar_status_log(spark, d):
    r = reg(spark, d)
    c = r.hazard_commands.where((F.col("kind") == W.KIND_STATUS) & ~T.is_blank("new_status"))
    h = V.hazard_state(r.hazards)
    j = c.join(h, c["hazard_id"] == h["h_hazard_id"], "left")
    return j.select("command_id", T.status_log_text("h_status", F.trim("new_status"), "details").alias("log_text"))


@query("csv_lines")
def q_csv_lines(spark, d):
    return E.csv_lines(_officer_list(reg(spark, d)))


@query("report_lines")
def q_report_lines(spark, d):
    return E.report_lines(_officer_list(reg(spark, d)))


@query("scalar_dates")
def q_scalar_dates(spark, d):
    return reg(spark, d).hazards.select("hazard_id", T.fmt_date("created_at").alias("created_day"),
                                        T.fmt_date("due_date").alias("due_day"),
                                        T.fmt_datetime("created_at").alias("created_minute"))


@query("scalar_overdue_day")
def q_scalar_overdue_day(spark, d):
    return reg(spark, d).hazards.select("hazard_id", T.overdue_ts("due_date", "status", NOW).alias("overdue_ts"),
                                        T.overdue_day("due_date", "status", NOW).alias("overdue_day"))


@query("list_display")
def q_list_display(spark, d):
    return _officer_list(reg(spark, d)).select(
        "hazard_id", T.dash_if_blank("assigned_to_name").alias("assigned_display"),
        T.due_display("due_date").alias("due_display"), T.status_label("status").alias("status_label"))


@query("scalar_comment_valid")
def q_scalar_comment_valid(spark, d):
    c = reg(spark, d).hazard_commands.where(F.col("kind") == W.KIND_COMMENT)
    return c.select("command_id", T.comment_valid("details").alias("comment_valid"))


def _due_text() -> F.Column:
    k = F.col("command_id") % 4
    return (F.when(k == 0, F.date_format("command_ts", "yyyy-MM-dd"))
            .when(k == 1, F.date_format("command_ts", "yyyy-MM-dd HH:mm"))
            .when(k == 2, F.col("description"))
            .otherwise(F.lit("  ")))


@query("scalar_due_parse")
def q_scalar_due_parse(spark, d):
    c = reg(spark, d).hazard_commands.select("command_id", _due_text().alias("due_text"))
    return c.select("command_id", "due_text", T.parse_due("due_text").alias("due_parsed"),
                    T.due_text_valid("due_text").alias("due_valid"))


@query("scalar_header_meta")
def q_scalar_header_meta(spark, d):
    return _officer_list(reg(spark, d)).select(
        "hazard_id", T.header_text("hazard_id", "title").alias("header"),
        T.meta_text("status", "reported_by_name", "assigned_to_name").alias("meta"))


@query("scalar_drill_link")
def q_scalar_drill_link(spark, d):
    b = A.breakdown(V.scope(reg(spark, d).hazards, *OFFICER), "type")
    return b.select("key", T.drill_link("type", F.col("key")).alias("link"),
                    T.export_query(F.lit("csv"), F.lit(None), F.lit(None), F.lit(None), F.col("key"),
                                   F.lit(None).cast("long"), F.lit(True)).alias("export_query"))


@query("scalar_form_valid")
def q_scalar_form_valid(spark, d):
    c = reg(spark, d).hazard_commands.where(F.col("kind") == W.KIND_CREATE)
    return c.select("command_id", T.form_valid("title", "description", T.fmt_date("due_date")).alias("form_valid"))


# E3-E5 ----------------------------------------------------------------------
@query("json_list")
def q_json_list(spark, d):
    """E3 for the viewers the API serves (management roles), one pass."""
    r = reg(spark, d)
    allowed = [v for v in VIEWERS if E.json_api_allowed(v[1])]
    rows = L.for_viewers(r.hazards, allowed)
    named = L.join_assignee(L.join_reporter(rows, r.users), r.users)
    return (named.orderBy("viewer_id", F.col("created_at").desc(), F.col("hazard_id").desc())
            .select("viewer_id", "hazard_id", E.json_item().alias("json")))


@query("json_list_filtered")
def q_json_list_filtered(spark, d):
    """E3 as one request sends it: all five filters, the items envelope."""
    r = reg(spark, d)
    f = E.api_filter("panel", "open", "CRITICAL", "fire", "1")
    return E.json_envelope(L.hazard_list(r.hazards, r.users, *OFFICER, f, NOW, ordered=False))


@query("detail_nested")
def q_detail_nested(spark, d):
    """The whole document of the hazard behind each allowed request."""
    r = reg(spark, d)
    req = command_requests(r)
    named = L.requested_hazards(req, r.hazards_of(req), r.users)
    docs = E.detail_documents(named, L.join_log_performer(r.hazard_logs, r.users))
    return L.answers(req, docs).select("request_id", "json")


@query("detail_lines")
def q_detail_lines(spark, d):
    """E4 as ordered lines: each requested hazard's document once (``detail_requests`` says whose it is)."""
    r = reg(spark, d)
    req = command_requests(r)
    named = L.requested_hazards(req, r.hazards_of(req), r.users)
    return E.detail_lines(L.answered(req, named), L.join_log_performer(r.hazard_logs, r.users))


@query("detail_requests")
def q_detail_requests(spark, d):
    r = reg(spark, d)
    req = command_requests(r)
    return E.detail_requests(L.hazard_detail(req, r.hazards_of(req), r.users))


@query("json_dashboard")
def q_json_dashboard(spark, d):
    """E5 for every test viewer in one pass over the hazards."""
    return E.dashboards_for_viewers(reg(spark, d).hazards, VIEWERS, NOW)


# S5-S7 ----------------------------------------------------------------------
from ..sources import integrity as DQ  # noqa: E402


def _tables(r: B.Register) -> dict[str, DataFrame]:
    return {"users": r.users, "hazards": r.hazards, "hazard_logs": r.hazard_logs,
            "hazard_attachments": r.hazard_attachments}


@query("dq_unique")
def q_dq_unique(spark, d):
    return DQ.check_unique(_tables(reg(spark, d)))


@query("dq_foreign_keys")
def q_dq_foreign_keys(spark, d):
    return DQ.check_foreign_keys(_tables(reg(spark, d)))


@query("dq_row_rules")
def q_dq_row_rules(spark, d):
    return DQ.check_rows(_tables(reg(spark, d)))


# W6, L1 ---------------------------------------------------------------------
from ..operators import apply as AP  # noqa: E402
from ..operators import apply_split as AS  # noqa: E402
from ..operators import lockout as LK  # noqa: E402


def _applied(spark, d):
    r = reg(spark, d)
    return AP.apply(r.hazard_commands, r.users, r.hazards, r.hazard_logs)


@query("apply_commands")
def q_apply_commands(spark, d):
    """Result of every command: the ordered fold per hazard, creates against the snapshot."""
    return _applied(spark, d)[2]


@query("apply_hazards")
def q_apply_hazards(spark, d):
    """The hazards table after all commands."""
    return _applied(spark, d)[0]


@query("apply_logs")
def q_apply_logs(spark, d):
    """The audit log after all commands."""
    return _applied(spark, d)[1]


# V3 and A6 after W6 ------------------------------------------------------------
from ..operators import maintain as M  # noqa: E402

BEFORE = NOW - dt.timedelta(days=30)


def _changed(spark, d):
    r = reg(spark, d)
    return r, *M.changes(r.hazard_commands, r.users, r.hazards)


@query("grants_after_apply")
def q_grants_after_apply(spark, d):
    """The grant table after all commands, from the one before and the touched hazards."""
    r, old, new = _changed(spark, d)
    return M.grants(V.visible_grants(r.users, r.hazards), r.users, old, new)


@query("dashboard_kpi_after_apply")
def q_dashboard_kpi_after_apply(spark, d):
    """KPI rows of all users, counted a month ago, after all commands and that month."""
    r, old, new = _changed(spark, d)
    return M.kpi(A.dashboard_all_kpi(r.users, r.hazards, BEFORE), r.users, old, new, BEFORE, NOW,
                 M.passed_due(r.hazards, old, BEFORE, NOW))


@query("dashboard_type_after_apply")
def q_dashboard_type_after_apply(spark, d):
    r, old, new = _changed(spark, d)
    return M.breakdown(A.dashboard_all_breakdown(r.users, r.hazards, "type"), r.users, old, new, "type")


@query("lockout_batch")
def q_lockout_batch(spark, d):
    """Lockout with the binding's test constants, keyed by user name."""
    ev = reg(spark, d).login_events
    return LK.lockout(ev, LK.user_key(), B.LOCKOUT_MAX_FAILURES, B.LOCKOUT_WINDOW, B.LOCKOUT_BLOCK)


# L2 -------------------------------------------------------------------------
from ..streaming import lockout_stream as LS  # noqa: E402


@query("lockout_stream")
def q_lockout_stream(spark, d):
    """The login events replayed as a file stream (availableNow) through the
    stateful stream operator; equals ``lockout_batch``."""
    ev = reg(spark, d).login_events
    return LS.run_over_files(spark, ev, LK.user_key, 4, B.LOCKOUT_MAX_FAILURES, B.LOCKOUT_WINDOW, B.LOCKOUT_BLOCK)


# W10 ------------------------------------------------------------------------
from ..streaming import commands_stream as CS  # noqa: E402


@query("apply_commands_stream")
def q_apply_commands_stream(spark, d):
    """The command table replayed as a file stream through the stateful
    fold; equals ``apply_commands`` on the non-create commands."""
    r = reg(spark, d)
    return CS.run_over_files(spark, r.hazard_commands, r.users, r.hazards, 4)


# T15 ------------------------------------------------------------------------
@query("login_key")
def q_login_key(spark, d):
    ev = reg(spark, d).login_events
    return ev.select("login_id", LK.login_key().alias("login_key"))
