"""Table sink for register writes.

Parquet files are immutable, so an UPDATE/DELETE/INSERT batch produces new
files for each changed table, under ``<root>/data/<unique>/<table>``; then one
small commit file ``<root>/_commits/<n>.json`` names the path of every table
of version n (unchanged tables keep their earlier path). The commit file is
created exclusively: of two writers that prepare the same version, one
commits and the other gets ``VersionConflict`` and leaves no trace but unused
files. Readers take the newest commit, so a change becomes visible all at
once (the reference wraps its purge-and-reload in one transaction). All file
access goes through the Hadoop file system of the path; any failure to read
a commit is raised, never taken for "no version". ``remove_old`` deletes the
table folders that only old versions (or writers that lost) have left; commit
files stay, so a version number is never given twice.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import schemas as S

COMMITS = "_commits"


class VersionConflict(RuntimeError):
    """Another writer has committed this version."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder when the application ends."""
    fs, at = _fs(spark, path)
    fs.deleteOnExit(at)


def _commit_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/{COMMITS}/{version:010d}.json"


def current_version(spark: SparkSession, root: str) -> int | None:
    """Newest committed version; None only when the commit folder does not exist or is empty."""
    fs, at = _fs(spark, f"{root.rstrip('/')}/{COMMITS}")
    if not fs.exists(at):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=None)


def commit(spark: SparkSession, root: str, version: int) -> dict:
    """The commit of a version: {version, committed_at, tables: {name: path}}."""
    rows = spark.read.text(_commit_path(root, version), wholetext=True).head(1)
    return json.loads(rows[0][0])


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    v = current_version(spark, root) if version is None else version
    if v is None:
        raise FileNotFoundError(f"no committed version under {root}")
    path = commit(spark, root, v)["tables"][name]
    schema = S.TABLES.get(name)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def write_version(tables: dict[str, DataFrame], root: str, expected: int | None = None) -> int:
    """Write the given tables and commit them as the next version.

    ``expected``: the version that the tables were derived from (default: the
    newest when writing begins). Tables not given keep their path."""
    if not tables:
        raise ValueError("nothing to write")
    spark = next(iter(tables.values())).sparkSession
    prev = current_version(spark, root) if expected is None else expected
    paths = {} if prev is None else dict(commit(spark, root, prev)["tables"])
    folder = f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        paths[name] = f"{folder}/{name}"
    v = 0 if prev is None else prev + 1
    now = dt.datetime.now(dt.timezone.utc).replace(microsecond=0, tzinfo=None)
    row = json.dumps({"version": v, "committed_at": now.isoformat(), "tables": paths})
    fs, at = _fs(spark, _commit_path(root, v))
    try:
        out = fs.create(at, False)  # fails if the file exists
    except Exception as e:
        if not fs.exists(at):
            raise
        raise VersionConflict(f"version {v} of {root} is committed already") from e
    try:
        out.write(bytearray(row, "utf-8"))
    finally:
        out.close()
    return v


def remove_old(spark: SparkSession, root: str, keep: int = 10, older_than: dt.timedelta = dt.timedelta(days=7)) -> list[str]:
    """Delete table folders that none of the ``keep`` newest versions names; returns their paths.

    A folder also stays while its last change is less than ``older_than`` ago:
    it may belong to a writer that has not committed yet, or to a version that
    became old under a running reader. Removed versions can no longer be read
    (their commit files remain). No version: nothing is removed."""
    if keep < 1:
        raise ValueError("the newest version must be kept")
    newest = current_version(spark, root)
    if newest is None:
        return []
    named = [set(commit(spark, root, v)["tables"].values()) for v in range(max(0, newest - keep + 1), newest + 1)]
    # Compared by <unique>/<table>: the same folder may be named by paths of different form.
    kept = {"/".join(p.rstrip("/").split("/")[-2:]) for paths in named for p in paths}
    until = (dt.datetime.now(dt.timezone.utc) - older_than).timestamp() * 1000
    fs, data = _fs(spark, f"{root.rstrip('/')}/data")
    removed = []
    for folder in fs.listStatus(data) if fs.exists(data) else []:
        tables = list(fs.listStatus(folder.getPath()))
        for t in tables:
            at = t.getPath()
            if f"{folder.getPath().getName()}/{at.getName()}" not in kept and t.getModificationTime() <= until:
                fs.delete(at, True)
                removed.append(at.toString())
        if folder.getModificationTime() <= until:
            try:
                fs.delete(folder.getPath(), False)  # only where nothing is left in it
            except Exception:
                if not fs.listStatus(folder.getPath()):
                    raise
    return sorted(removed)
