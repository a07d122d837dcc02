"""Making the package importable in Python workers."""

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> None:
    """Where the workers' PYTHONPATH lacks this package, send it to them as --py-files would."""
    if _ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sent = getattr(spark.sparkContext, "_quarry_shipped", False)
    if not sent:
        base = os.path.join(tempfile.mkdtemp(), "quarry_src")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", _ROOT, "quarry"))
        spark.sparkContext._quarry_shipped = True
