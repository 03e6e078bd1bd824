"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins and partition counts at runtime
# from real shuffle sizes, and splits skewed join partitions.
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The Python call-site capture looks up the session and a conf value on every
    # DataFrame API call (about a quarter of the driver time spent building the report
    # plans); it only adds Python line numbers to error messages.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "shelfcheck",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume.

    On a cluster, leave ``master`` unset so spark-submit decides; tests and the
    bench pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make the package importable on the executors, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_shelfcheck_shipped", None) is None:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="shelfcheck-ship-"), "shelfcheck_pkg.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(package):
                for n in names:
                    if n.endswith(".py"):
                        path = os.path.join(folder, n)
                        z.write(path, os.path.relpath(path, os.path.dirname(package)))
        sc.addPyFile(archive)
        sc._shelfcheck_shipped = archive


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and published datasets.

    Read from ``spark.checkpoint.dir`` as the cluster names it. Only a local master may
    leave it unset; then a scratch folder is created and registered.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="shelfcheck-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder."""
    return os.path.join(checkpoint_root(spark), *parts)
