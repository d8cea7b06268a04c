"""New folders for files that a job writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession) -> str:
    """A folder under ``spark.checkpoint.dir``, which driver and executors share. Where the session names none, one of the driver's
    disk that goes with its process, which a local master alone can use."""
    if named := spark.conf.get("spark.checkpoint.dir", ""):
        return f"{named}/fathomlake-{uuid.uuid4().hex}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="fathomlake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"
