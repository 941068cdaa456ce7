"""Session settings the library relies on.

Only settings that change *results* are forced (time zone); everything else is
applied only when the session does not set it already, so a cluster's own
configuration (shuffle partitions, checkpoint directory, broadcast threshold)
always wins.
"""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings that change results: epoch seconds -> date depends on the zone.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Sensible defaults, applied only where the session leaves them unset.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the result-relevant settings and make sure a checkpoint dir exists."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in DEFAULT_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory, creating a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, S3, ...)
    and is used as is; without it a cluster run stops with an error. A local
    temporary folder is only taken for ``local[...]`` masters with nothing
    configured, which is the case in tests and local runs.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local"):
            # A driver-local folder is not visible to executors on other hosts.
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...) "
                               "before running reviewlens on a cluster")
        configured = tempfile.mkdtemp(prefix="reviewlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once per application,
    so that functions pickled by name can be imported wherever a task runs."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("reviewlens", os.path.relpath(path, root)))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="reviewlens-src-")), "reviewlens_src.zip")
    with open(target, "wb") as f:
        f.write(buffer.getvalue())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "reviewlens",
                  driver_memory: str = "8g") -> SparkSession:
    """Session for tests and local benchmarks (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    event_dir = os.environ.get("REVIEWLENS_EVENT_LOG_DIR")
    if event_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
