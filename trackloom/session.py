"""Executors get the package with the job, so that nothing has to be installed on them."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a session. Workers on one machine that start where the package lies find it without."""
    sc = spark.sparkContext
    if getattr(sc, "_trackloom_shipped", False):
        return
    sc._trackloom_shipped = True
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    near = root in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if near and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="trackloom-"), "trackloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    sc.addPyFile(path)
