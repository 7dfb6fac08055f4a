"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per Spark context.

    Local workers that find it by themselves, through PYTHONPATH or the working folder, are left alone.
    """
    context = spark.sparkContext
    if getattr(context, "_tesserae_shipped", False):
        return
    root = os.path.dirname(PACKAGE)
    seen = [os.path.abspath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    if not (context.master.startswith("local") and "cluster" not in context.master and root in seen):
        path = os.path.join(tempfile.mkdtemp(prefix="tesserae-"), "tesserae.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in sorted(os.walk(PACKAGE)):
                for name in sorted(n for n in names if n.endswith(".py")):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.relpath(file, root))
        context.addPyFile(path)
    context._tesserae_shipped = True
