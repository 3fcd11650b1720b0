"""Secret scans (operator 13): an incremental blob ledger.

1. Every version of every path is addressed by its content (SHA-256 of the UTF-8
   bytes). Versions of equal content, wherever and whenever they stand, are one blob.
2. A ledger, a table in a shared folder, says which rule versions a blob has been
   scanned with and what they found. A blob needs the rules of this run whose
   (name, version) its ledger rows do not have; blobs that need none are not read
   any further.
3. Each remaining blob is scanned once, by the rules it lacks, in Arrow batches. A rule
   first goes over a whole batch with a linear-time matcher; the exact pattern then runs
   on the whole text of those that may hold it. Results are appended to the ledger.
4. The findings of the asked rules are joined back, by content address, to all
   versions of all paths.

A run's ledger rows are one folder, counted only once Spark has committed it, so a lost
run leaves nothing behind. Two runs that scan the same pair write the same findings; a
reader takes distinct ones. A new version of one rule scans all blobs with that rule only.

A rule finds the leftmost non-overlapping matches of its pattern, and drops those whose
``counted`` group is shorter than ``least``. Spans are (rule, start, end) in code points of
the whole text, end exclusive. Letters beyond ASCII never match ASCII ones.

Defined results: a null text is an empty one, and an empty text has no findings; repeated
rows are versions of their own with the same findings; null paths are kept; an empty table
gives no rows; other columns are kept by ``scan_versions`` (the findings go into fresh
names on a clash) and left out by ``scan_documents``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir
from .frames import fresh, map_columns, q, settle


@dataclass(frozen=True)
class Rule:
    """``hint``: a pattern (RE2) that every text with a match holds; ``pattern``: the exact
    one (Python, ASCII)."""

    name: str
    version: int
    pattern: str
    hint: str
    least: int = 0
    counted: int = 0

    @property
    def tag(self) -> str:
        return f"{self.name}@{self.version}"


# The three base patterns and their least lengths, in their order.
_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", 1, f"(?i){_ASSIGN}", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", 20),
    # Maximal runs: a run of fewer digits never starts a match, so the least length can stand in the pattern.
    Rule("hex", 1, r"[0-9a-f]{24,}", r"[0-9a-f]{24}", 24),
)
# Formats that name themselves.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"eyJ[A-Za-z0-9_-]{10}"),
    Rule("login", 1, r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@", r"://[^\s/:@]{1,64}:[^\s/:@]{3}"),
)
RULES = BASE_RULES + MORE_RULES

FINDING = T.StructType([T.StructField("rule", T.StringType()), T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType())])
LEDGER = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("tags", T.ArrayType(T.StringType())),
                       T.StructField("findings", T.ArrayType(FINDING))])


def spans(rule: Rule, text: str, compiled: re.Pattern | None = None) -> list[tuple[int, int]]:
    """(start, end) of the rule's matches in one whole text."""
    pattern = compiled or re.compile(rule.pattern, re.ASCII)
    return [m.span() for m in pattern.finditer(text) if m.end(rule.counted) - m.start(rule.counted) >= rule.least]


class Ledger:
    """What has been scanned: a folder with one committed folder per run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _runs(self) -> list[str]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        found = [s.getPath().toString() for s in fs.listStatus(at) if s.isDirectory()]
        return sorted(p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))

    def rows(self) -> DataFrame:
        """blob, tags (``name@version`` of the rules that were run), findings."""
        runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(*runs)

    def append(self, rows: DataFrame) -> None:
        rows.select("blob", "tags", "findings").write.parquet(f"{self.path}/run-{uuid.uuid4().hex}")


def private_ledger(spark: SparkSession) -> Ledger:
    """An empty ledger in the shared folder that goes with the application."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return Ledger(spark, path)


def address(text: Column) -> Column:
    """Content address: 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def unseen(versions: DataFrame, text_col: str, ledger: Ledger, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, text, lacks: every distinct blob with the tags that its ledger rows do not have.

    A task keeps one row per blob before the shuffle, however many copies it reads."""
    every = F.array(*[F.lit(r.tag) for r in rules])
    blobs = (versions.select(address(q(text_col)).alias("blob"), F.coalesce(q(text_col).cast("string"), F.lit("")).alias("text"))
             .groupBy("blob").agg(F.first("text").alias("text")))
    if not ledger._runs():
        return blobs.withColumn("lacks", every)
    # At most one entry per rule version that was ever run.
    known = (ledger.rows().select("blob", F.explode("tags").alias("tag")).groupBy("blob")
             .agg(F.collect_set("tag").alias("known")))
    lacks = F.when(F.col("known").isNull(), every).otherwise(F.array_except(every, F.col("known")))
    return blobs.join(known, "blob", "left").withColumn("lacks", lacks).drop("known").where(F.size("lacks") > 0)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, tags, findings of (blob, text, lacks): each blob by the rules it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        compiled = {r.tag: re.compile(r.pattern, re.ASCII) for r in rules}
        for b in batches:
            text, lacks = b.column(1), b.column(2)
            wanted = [set(x) for x in lacks.to_pylist()]
            found: list[list] = [[] for _ in range(b.num_rows)]
            for rule in rules:
                maybe = pc.fill_null(pc.match_substring_regex(text, rule.hint), False)
                for i in pc.indices_nonzero(maybe).to_pylist():
                    if rule.tag in wanted[i]:
                        found[i] += [(rule.name, s, e) for s, e in spans(rule, text[i].as_py(), compiled[rule.tag])]
            yield [b.column(0), lacks, pa.array([[{"rule": n, "start": s, "end": e} for n, s, e in x] for x in found],
                                                pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]

    return map_columns(blobs.select("blob", "text", "lacks"), run, LEDGER)


def findings_of(ledger: Ledger, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, findings: blobs with at least one finding of the rules, in order of start, then of rule.

    A rule's findings count only where this version of it was run."""
    tags = {r.tag: r.name for r in rules}
    rows = ledger.rows().where(F.size("findings") > 0)
    names = F.array(*[F.lit(r.name) for r in rules])
    ours = F.transform(F.filter("tags", lambda t: t.isin(list(tags))), lambda t: F.substring_index(t, "@", 1))
    kept = F.filter("findings", lambda x: F.array_contains(ours, x["rule"]))
    ordered = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.array_position(names, x["rule"]).alias("nth"),
                                                   x["end"].alias("end"), x["rule"].alias("rule")))
    # A blob has one ledger row per run that scanned it with rules it lacked.
    merged = rows.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(ordered)))).alias("findings"))
    return merged.where(F.size("findings") > 0).select(
        "blob", F.transform("findings", lambda x: F.struct(x["rule"].alias("rule"), x["start"].alias("start"), x["end"].alias("end")))
        .alias("findings"))


def scan_versions(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Every row of ``versions`` with its content address and findings (columns ``blob``
    and ``findings``, under fresh names on a clash).

    Scans what the ledger lacks, appends that to it, then joins by address."""
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("one version per rule")
    todo = unseen(versions, text_col, ledger, rules)
    ledger.append(scan_blobs(todo, rules))
    blob = "blob" if "blob" not in {c.lower() for c in versions.columns} else fresh(versions, "blob")
    out = "findings" if "findings" not in {c.lower() for c in versions.columns} else fresh(versions, "findings")
    found = findings_of(ledger, rules).toDF("_f_blob_", "_f_findings_")
    rows = versions.withColumn(blob, address(q(text_col)))
    while {c.lower() for c in found.columns} & {c.lower() for c in rows.columns}:
        found = found.toDF(*[f"_{c}" for c in found.columns])
    left, right = found.columns
    none = F.array().cast(T.ArrayType(FINDING))
    return (rows.join(found, q(blob) == q(left), "left").withColumn(out, F.coalesce(q(right), none)).drop(left, right))


def span_text(findings: Column, rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end`` of the rules' findings, comma-joined."""
    kept = F.filter(findings, lambda x: x["rule"].isin([r.name for r in rules]))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(rule: Rule) -> Column:
    return F.size(F.filter("findings", lambda x: x["rule"] == rule.name))


def scan_documents(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the digest of each document's findings."""
    ledger = ledger or private_ledger(docs.sparkSession)
    versions = docs.select(q(id_col).alias("doc_id"), q(text_col).alias("text"))
    found = scan_versions(versions, ledger, rules)
    counts = [_count(r).cast("long").alias(f"n_{r.name}") for r in BASE_RULES]
    base = span_text(F.col("findings"), BASE_RULES)
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                        span_text(F.col("findings"), rules).alias("spans"))
