"""Make the package importable in Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def reach_workers(spark: SparkSession) -> SparkSession:
    """Add the package's folder to the workers' path, wherever the driver was started.

    That serves workers that see the same file system; elsewhere submit with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="orbitlake-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = f"file://{root}"
    return f"{root.rstrip('/')}/orbitlake-{uuid.uuid4().hex}"
