"""Spark sessions for local runs; on a cluster the session that is there is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, name: str = "millrace") -> SparkSession:
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(n)).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package: from where the driver has it, in local modes; elsewhere as an archive of its
    sources that Spark hands to every executor, once for a session. Where it is installed, either changes nothing."""
    package = os.path.dirname(os.path.abspath(__file__))
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        root = os.path.dirname(package)
        have = sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
        if root not in have.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    elif not getattr(sc, "_millrace_shipped", False):
        import shutil
        import tempfile

        # the driver's own folder: Spark copies the archive from there
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace"), "zip", os.path.dirname(package), os.path.basename(package))
        sc.addPyFile(made)
        sc._millrace_shipped = True
