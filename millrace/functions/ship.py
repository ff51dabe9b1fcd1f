"""Make this package importable in the executors' Python workers."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package along with the context, once.

    Only modules are sent; on a cluster whose image has the package this is harmless.
    """
    context = spark.sparkContext
    if getattr(context, "_millrace_package", False):
        return
    top = pathlib.Path(__file__).resolve().parent.parent
    if top.is_dir():
        path = pathlib.Path(tempfile.mkdtemp(prefix="millrace-pkg-")) / "millrace-package.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(top.rglob("*.py")):
                out.write(file, file.relative_to(top.parent))
        context.addPyFile(str(path))
    context._millrace_package = True
