"""Session helpers shared by the whole package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package: on this machine from where the driver has it, on others from an archive that goes with the job."""
    context = spark.sparkContext
    env = context.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    if context.master.startswith("local[") or context.master == "local" or context.applicationId in _shipped:
        return
    # the driver hands the archive to the executors; no other machine looks at this folder
    archive = os.path.join(tempfile.mkdtemp(prefix="statloom-"), "statloom.zip")
    package = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("statloom", os.path.relpath(path, package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
