"""Spark session settings used by tests, the bench and the entry points.

On a cluster the session comes from the launcher; ``configure`` only fills in
what is unset so that cluster-wide values (shuffle partitions, checkpoint
folder) always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on for repeatable results.
REQUIRED_CONF = {
    # All timestamps in the register are UTC wall-clock values (TIMESTAMP_NTZ);
    # streaming watermarks need TIMESTAMP, which is interpreted in this zone.
    "spark.sql.session.timeZone": "UTC",
}

# Settings that are defaults only: a cluster may override them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Dimension sides (users, per-group aggregates) are broadcast only when
    # Spark's size estimate or AQE's runtime statistics are under this bound.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # A row may hold a whole document of MBs: Parquet looks at the size of a page and of a row
    # group after two rows, not after a hundred, which it holds and packs in memory at once.
    "parquet.page.size.row.check.min": "2",
    "parquet.block.size.row.check.min": "2",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8,
                  app_name: str = "riskgrid") -> SparkSession:
    """Session for tests and the local bench (no UI, no server ports)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in {**DEFAULT_CONF, **REQUIRED_CONF}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply required settings and fill unset defaults on an existing session."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    for k, v in DEFAULT_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (grouped-map folds).

    Cluster deployments pass a wheel or zip with ``--py-files``. In local
    mode (tests, bench) the package is zipped once per application and added
    with ``addPyFile``."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED or os.environ.get("RISKGRID_SHIPPED") == "1":
        return
    if not sc.master.startswith("local"):
        # On a cluster the package travels with --py-files (or an installed
        # wheel); nothing is staged from the driver's local disk.
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    tmp = tempfile.mkdtemp(prefix="riskgrid-pyfiles-")
    base = os.path.join(tmp, "riskgrid")
    archive = shutil.make_archive(base, "zip", root_dir=os.path.dirname(pkg_dir), base_dir="riskgrid")
    sc.addPyFile(archive)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster). Only when it is
    unset in local mode, as in tests, a private scratch folder is created; on a
    cluster that is an error, because executors would write to their own disks.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="riskgrid-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()
