"""This package on Python workers."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile

from pyspark.sql import SparkSession

from spanloom.sources.shared import shared_dir

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def send_package(spark: SparkSession) -> None:
    """Sends the package's modules to the workers, once a session, by way of the shared folder. Nothing is sent where it was imported from a
    package that has been sent already."""
    root = os.path.dirname(TOP)
    files = sorted(os.path.join(folder, name) for folder, _, names in os.walk(TOP) for name in names if name.endswith(".py"))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, os.path.relpath(f, root))
    name = f"spanloom-{hashlib.sha256(packed.getvalue()).hexdigest()[:16]}.zip"
    sc = spark.sparkContext
    if not files or any(f.endswith(name) for f in sc.listFiles):
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(path.toString())
