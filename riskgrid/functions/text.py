"""Scalar column expressions (T1-T16): trimming, canonical values, keyword
classification, log and report text, CSV fields, dates and form checks.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import schemas as S

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results:
# keyword groups of the description classifier, tried in this order; the
# first group with a keyword contained in the lower-cased text wins.
CLASSIFIER_RULES = (
    ("Fire", "High", ("fire", "אש", "smoke", "עשן")),
    ("Electrical", "High", ("electric", "electrical", "חשמל", "קצר")),
    ("Chemical", "Critical", ("chemical", "acid", "gas", "fume", "כימ", "חומצה", "גז", "אדים")),
    ("Equipment", "High", ("machine", "equipment", "forklift", "מכונה", "ציוד", "מלגזה")),
)
CLASSIFIER_DEFAULT = ("General", "Medium")
# Report lines: at most this many characters; longer ones are cut to one less
# and end with an ellipsis.
REPORT_LINE_MAX = 120
REPORT_ELLIPSIS = "…"
# Status log text is held in NVARCHAR(2000).
LOG_DETAILS_MAX = 2000
LINK_PATH = "~/Hazards/HazardList.aspx"
HEADER_LEAD = "Hazard #"
META_REPORTED = " | Reported by "
META_ASSIGNED = " | Assigned to "
LINK_FORMAT, LINK_SEARCH, LINK_STATUS, LINK_SEVERITY, LINK_TYPE, LINK_ASSIGNED, LINK_OVERDUE = (
    "format=", "q", "status", "severity", "type", "assignedTo=", "overdue=1")
# Minimum trimmed comment length.
COMMENT_MIN = 3
# Date formats of the list/CSV and of the log view.
DATE_FORMAT = "yyyy-MM-dd"
DATETIME_FORMAT = "yyyy-MM-dd HH:mm"
# Due-date text formats accepted, tried in order (ISO first).
DUE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss",
               "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "M/d/yyyy", "M/d/yyyy H:mm")
# Form limits.
TITLE_MAX = 200
DESCRIPTION_MAX = 2000
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# T1 -------------------------------------------------------------------------
def trim_or_empty(x) -> Column:
    """LTRIM(RTRIM(ISNULL(x, ''))): spaces only, NULL becomes ''."""
    return F.trim(F.coalesce(_c(x), F.lit("")))


def is_blank(x) -> Column:
    return trim_or_empty(x) == F.lit("")


# T2 / T3 --------------------------------------------------------------------
def canonical(x, domain) -> Column:
    """Canonical spelling of a domain value, ignoring case and outer spaces;
    anything else (including NULL) is returned unchanged."""
    c = _c(x)
    key = F.lower(F.trim(c))
    expr = None
    for v in domain:
        cond = key == F.lit(v.lower())
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(c)


def canonical_role(x) -> Column:
    return canonical(x, S.ROLES)


def canonical_status(x) -> Column:
    return canonical(x, S.STATUSES)


def canonical_severity(x) -> Column:
    return canonical(x, S.SEVERITIES)


def canonical_type(x) -> Column:
    return canonical(x, S.TYPES)


def type_or_general(x) -> Column:
    """Out-of-list (legacy) types fall back to General when edited."""
    c = _c(x)
    return F.when(c.isin(*S.TYPES), c).otherwise(F.lit("General"))


# T4 -------------------------------------------------------------------------
def _rule_index(low: Column) -> Column:
    """Number of the first rule with a keyword in a lower-cased text (null: none). A keyword that holds
    another one of its rule is found with it."""
    expr = None
    for i, rule in enumerate(CLASSIFIER_RULES):
        hit = None
        for kw in rule[2]:
            if any(k != kw and k in kw for k in rule[2]):
                continue
            h = low.contains(F.lit(kw))
            hit = h if hit is None else (hit | h)
        expr = F.when(hit, F.lit(i)) if expr is None else expr.when(hit, F.lit(i))
    return expr


def classify(description) -> Column:
    """struct(type, severity): the text is lower-cased once, and one rule number gives both.

    The lambda binds the lower-cased text; a plain chain of conditions would lower it for every keyword."""
    index = F.transform(F.array(F.lower(_c(description))), _rule_index)[0]
    pairs = F.array(*[F.struct(F.lit(r[0]).alias("type"), F.lit(r[1]).alias("severity")) for r in CLASSIFIER_RULES])
    default = F.struct(F.lit(CLASSIFIER_DEFAULT[0]).alias("type"), F.lit(CLASSIFIER_DEFAULT[1]).alias("severity"))
    return F.coalesce(F.get(pairs, index), default)


def classify_type(description) -> Column:
    return classify(description)["type"]


def classify_severity(description) -> Column:
    return classify(description)["severity"]


# T5 -------------------------------------------------------------------------
def status_log_text(old, new, details, max_len: int | None = None) -> Column:
    """``old -> new`` plus `` | details`` when details are not blank (trailing
    spaces ignored as in T-SQL ``=``); cut to ``max_len`` characters where a limit is given."""
    d = _c(details)
    tail = F.when(d.isNull() | (F.rtrim(d) == F.lit("")), F.lit("")).otherwise(F.concat(F.lit(" | "), d))
    txt = F.concat(F.coalesce(_c(old), F.lit("")), F.lit(" -> "), F.coalesce(_c(new), F.lit("")), tail)
    return txt if max_len is None else F.substring(txt, 1, max_len)


# T6 -------------------------------------------------------------------------
def csv_field(x) -> Column:
    v = F.replace(F.coalesce(_c(x), F.lit("")), F.lit('"'), F.lit('""'))
    return F.when(v.rlike('[,"\r\n]'), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)


# T8 -------------------------------------------------------------------------
def fmt_date(x) -> Column:
    return F.date_format(_c(x), DATE_FORMAT)


def fmt_datetime(x) -> Column:
    return F.date_format(_c(x), DATETIME_FORMAT)


# T7 -------------------------------------------------------------------------
def dash_if_blank(x) -> Column:
    c = _c(x)
    return F.when(is_blank_ws(c), F.lit("-")).otherwise(c)


def is_blank_ws(x) -> Column:
    """NULL or only whitespace (any Unicode white space): no other character is found."""
    return F.coalesce(~_c(x).rlike(r"[^\s\p{Z}]"), F.lit(True))


def cut_line(x, max_len: int | None = None) -> Column:
    """The line, cut to ``max_len`` characters with an ellipsis where a limit is given."""
    c = F.coalesce(_c(x), F.lit(""))
    if max_len is None:
        return c
    return F.when(F.length(c) > max_len,
                  F.concat(F.substring(c, 1, max_len - 1), F.lit(REPORT_ELLIPSIS))).otherwise(c)


def report_line(hazard_id, status, severity, htype, due_date, assigned_name, title,
                max_len: int | None = None) -> Column:
    due = F.coalesce(fmt_date(due_date), F.lit("-"))
    line = F.concat(
        F.lit("#"), _c(hazard_id).cast("string"),
        F.lit(" | "), F.coalesce(_c(status), F.lit("")),
        F.lit(" | "), F.coalesce(_c(severity), F.lit("")),
        F.lit(" | "), F.coalesce(_c(htype), F.lit("")),
        F.lit(" | Due: "), due,
        F.lit(" | Assigned: "), dash_if_blank(assigned_name),
        F.lit(" | "), F.coalesce(_c(title), F.lit("")),
    )
    return cut_line(line, max_len)


# T9 -------------------------------------------------------------------------
def overdue_ts(due_date, status, now: dt.datetime) -> Column:
    """Timestamp form: due < now and not Resolved (NULL due is not overdue)."""
    d = _c(due_date)
    return F.coalesce(d.isNotNull() & (d < F.lit(now).cast("timestamp_ntz"))
                      & (_c(status) != F.lit(S.STATUS_RESOLVED)), F.lit(False))


def overdue_day(due_date, status, now: dt.datetime) -> Column:
    """Day form: date(due) < today and status not Resolved (ignoring case)."""
    d = _c(due_date)
    return F.coalesce(d.isNotNull() & (F.to_date(d) < F.lit(now.date()))
                      & (F.lower(F.coalesce(_c(status), F.lit(""))) != F.lit("resolved")), F.lit(False))


# T10 ------------------------------------------------------------------------
def status_label(status) -> Column:
    c = _c(status)
    expr = None
    for k, v in S.STATUS_LABELS.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    return expr.otherwise(c)


def due_display(due_date) -> Column:
    return F.coalesce(fmt_date(due_date), F.lit("-"))


# T11 ------------------------------------------------------------------------
def trim_ws(x) -> Column:
    """.NET String.Trim(): strips leading/trailing white space of any kind."""
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def comment_valid(x) -> Column:
    return F.length(trim_ws(x)) >= F.lit(COMMENT_MIN)


# T12 ------------------------------------------------------------------------
def parse_due(text) -> Column:
    """Due-date text to TIMESTAMP_NTZ; NULL for blank or unparsable text."""
    t = trim_ws(text)
    parsed = [F.try_to_timestamp(t, F.lit(f)) for f in DUE_FORMATS]
    return F.coalesce(*parsed).cast("timestamp_ntz")


def due_text_valid(text) -> Column:
    return is_blank_ws(text) | parse_due(text).isNotNull()


# T13 ------------------------------------------------------------------------
def header_text(hazard_id, title) -> Column:
    return F.concat(F.lit(HEADER_LEAD), _c(hazard_id).cast("string"), F.lit(" - "),
                    F.coalesce(_c(title), F.lit("")))


def meta_text(status, reporter_name, assignee_name) -> Column:
    return F.concat(F.coalesce(_c(status), F.lit("")), F.lit(META_REPORTED),
                    F.coalesce(_c(reporter_name), F.lit("")), F.lit(META_ASSIGNED),
                    dash_if_blank(assignee_name))


# T14 ------------------------------------------------------------------------
def form_url_encode(x) -> Column:
    """application/x-www-form-urlencoded value (space as '+')."""
    return F.url_encode(_c(x))


def drill_link(query_key: str, value) -> Column:
    return F.concat(F.lit(f"{LINK_PATH}?{query_key}="), form_url_encode(value))


def export_query(fmt, search, status, severity, htype, assigned_to, overdue) -> Column:
    """Query string of the export links; parameters that are blank are left out."""
    def part(name, v):
        return F.when(~is_blank_ws(v), F.concat(F.lit(f"{name}="), form_url_encode(v)))
    return F.concat(F.lit("?"), F.concat_ws(
        "&",
        F.concat(F.lit(LINK_FORMAT), form_url_encode(fmt)),
        part(LINK_SEARCH, search), part(LINK_STATUS, status), part(LINK_SEVERITY, severity), part(LINK_TYPE, htype),
        F.when(_c(assigned_to).isNotNull(), F.concat(F.lit(LINK_ASSIGNED), _c(assigned_to).cast("string"))),
        F.when(F.coalesce(_c(overdue), F.lit(False)), F.lit(LINK_OVERDUE)),
    ))


# T15 ------------------------------------------------------------------------
def login_key(ip, user_name) -> Column:
    u = F.when(is_blank_ws(user_name), F.lit("unknown")).otherwise(F.lower(_c(user_name)))
    return F.concat(F.coalesce(_c(ip), F.lit("unknown")), F.lit("|"), u)


# T16 ------------------------------------------------------------------------
def form_valid(title, description, due_text) -> Column:
    t = trim_ws(title)
    d = trim_ws(description)
    return ((F.length(t) > 0) & (F.length(t) <= TITLE_MAX)
            & (F.length(d) > 0) & (F.length(d) <= DESCRIPTION_MAX)
            & due_text_valid(due_text))
