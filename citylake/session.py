"""Session settings the engine is written for.

Jobs receive a SparkSession; this builder is for scripts and tests. Nothing in the
library depends on it, except that ``spark.checkpoint.dir`` is read from the session.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder that all nodes see, as the session names it in ``spark.checkpoint.dir``. A session on one machine
    may go without and gets a folder of its own; any other is an error."""
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        found = tempfile.mkdtemp(prefix="citylake-")
        spark.conf.set(key, found)
    return found


def local_session(app: str = "citylake", cpus: int | None = None, partitions: int = 8) -> SparkSession:
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
