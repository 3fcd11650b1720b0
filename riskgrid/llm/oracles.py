"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import lexical, mixing, secretscan, urlfilter

_HOST = "translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{u}', '{l}')".format(
    u=urlfilter._LETTERS, l=urlfilter._LETTERS.lower())


def _like(glob: str) -> str:
    """A glob as a full-match regular expression."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append("(.|\\n)*")
            i += 2
            continue
        c = glob[i]
        out.append("[^/]*" if c == "*" else "(.|\\n)" if c == "?" else c if c.isalnum() else "\\" + c)
        i += 1
    return "^" + "".join(out) + "$"


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"


_RULES = sorted(urlfilter.SITE_RULES, key=lambda r: -len(r[1]))
OP2 = f"""
WITH u AS (
  SELECT page_id, coalesce({_HOST}, '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE {' '.join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in _RULES)} END AS rule,
         CASE {' '.join(f"WHEN regexp_matches(host || path, '{_like(g)}') THEN '{g}'" for g in urlfilter.BLOCK_GLOBS)} END AS blocked_by
  FROM u)
SELECT page_id, host, path, rule, blocked_by,
       CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in _RULES)}
            WHEN blocked_by IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

_W = ", ".join(f"{float(w)}" for w in mixing.WEIGHTS)
OP9 = rf"""
WITH d AS (
  SELECT doc_id, text, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('{mixing.SEED}' || '|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT
            ::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
l AS (
  SELECT doc_id, 0.25 + 0.75 * avg(least(greatest(quality, 0), 1)::DOUBLE) AS w
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
k AS (
  SELECT d.*, -ln(u) / coalesce(l.w, 1.0) AS key FROM d LEFT JOIN l USING (doc_id)),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM k GROUP BY source),
s2 AS (
  SELECT *, ([{_W}])[((nth - 1) % {len(mixing.WEIGHTS)} + 1)::INT]::DOUBLE AS weight, source_size * {mixing.CAP}::DOUBLE AS most FROM s),
s3 AS (
  SELECT *, most / weight AS ratio,
         coalesce(sum(most) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS filled,
         sum(weight) OVER (ORDER BY most / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open_weight,
         sum(source_size) OVER ()::DOUBLE * {mixing.SHARE}::DOUBLE AS budget
  FROM s2),
cut AS (
  SELECT (budget - filled) / open_weight AS level, ratio AS cut_ratio, nth AS cut_nth
  FROM s3 WHERE (budget - filled) / open_weight <= ratio ORDER BY ratio, nth LIMIT 1),
goal AS (
  SELECT s3.source, s3.source_size,
         CASE WHEN level IS NULL OR ratio < cut_ratio OR (ratio = cut_ratio AND nth < cut_nth) THEN most
              ELSE least(most, level * weight) END AS target
  FROM s3 LEFT JOIN cut ON true),
goal2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM goal),
p AS (
  SELECT k.*, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM k JOIN goal2 g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       least(epochs + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END, {int(mixing.CAP)})::BIGINT AS copies,
       least(epochs + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END, {int(mixing.CAP)})::BIGINT * size AS taken
FROM p
"""

_TERMS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
OP12 = f"""
WITH i AS (SELECT *, row_number() OVER () AS no FROM (SELECT DISTINCT item_id, text FROM benchmark)),
it AS (SELECT no, term, count(*) AS q FROM (SELECT no, unnest({_TERMS}) AS term FROM i) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS row_no, doc_id, {_TERMS} AS terms FROM documents),
n AS (SELECT row_no, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
tf AS (
  SELECT row_no, term, count(*)::BIGINT AS tf FROM (SELECT row_no, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM it) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, total GROUP BY term, n_docs),
s AS (
  SELECT it.no, n.doc_id, n.row_no,
         sum(it.q * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * n.n * n_docs) // n_terms))))::BIGINT AS score
  FROM tf JOIN it USING (term) JOIN w USING (term) JOIN n USING (row_no), total GROUP BY it.no, n.doc_id, n.row_no),
r AS (
  SELECT no, doc_id, score, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
  FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN i USING (no) WHERE rank <= {lexical.TOP}
"""



def _any_case(pattern: str) -> str:
    """The key words of the assign pattern in either case, ASCII letters only."""
    words, rest = pattern.split(")", 1)
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words) + ")" + rest


def _matches(nth: int, rule: secretscan.Rule) -> str:
    pattern = _any_case(secretscan._ASSIGN) if rule.name == "assign" else rule.pattern
    p = pattern.replace("'", "''")
    return (f"SELECT no, '{rule.name}' AS kind, {nth} AS nth, regexp_extract_all(t, '{p}') AS m, "
            f"regexp_extract_all(t, '{p}', {rule.counted}) AS g, string_split_regex(t, '{p}') AS s, {rule.least} AS least "
            f"FROM d WHERE regexp_matches(t, '{p}')")


_BASE = ", ".join(f"'{r.name}'" for r in secretscan.BASE_RULES)
# A match starts behind the pieces between the matches and the matches before it.
OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS no, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({' UNION ALL '.join(_matches(i, r) for i, r in enumerate(secretscan.RULES))}),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM x),
f AS (
  SELECT no, kind, nth, length(m[i]) AS size,
         list_sum(list_transform(s[1:i], lambda v: length(v)))
           + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS start
  FROM e WHERE length(g[i]) >= least),
r AS (
  SELECT no, kind, nth, start, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM f),
a AS (
  SELECT no, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, nth) FILTER (kind IN ({_BASE})) AS base,
         string_agg(span, ',' ORDER BY start, nth) AS spans
  FROM r GROUP BY no)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (no)
"""

SQL: dict[str, str] = {"op2_url_filter": OP2, "op9_mixing": OP9, "op12_lexical": OP12, "op13_secrets": OP13}
