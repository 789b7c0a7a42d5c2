"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Settings the operators are written for. Shuffle partition counts are left to the
# cluster: adaptive execution coalesces small partitions and splits skewed ones.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Recording the caller of every column expression doubles the time that plans take to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

CHECKPOINT_CONF = "spark.checkpoint.dir"


def configure(builder: SparkSession.Builder, **extra: str) -> SparkSession.Builder:
    """Apply the recommended settings (and any extra ones) to a session builder."""
    for key, value in {**CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and hand-over tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only in local mode, where all tasks
    see the same disk, a temporary folder is made if that is unset, one per application.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_CONF} to a folder that all executors share.")
    return _own_dir(spark.sparkContext.applicationId)


@cache
def _own_dir(application: str) -> str:
    folder = tempfile.mkdtemp(prefix=f"rolltally-{application}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
