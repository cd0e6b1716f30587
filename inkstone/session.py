"""What a session needs: the package on its executors, and a folder that all of them share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's modules to the executors once per application, as --py-files would."""
    context = spark.sparkContext
    if not getattr(context, "_inkstone_shipped", False):
        package = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="inkstone-")) / "inkstone.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for module in sorted(package.rglob("*.py")):
                archive.write(module, module.relative_to(package.parent))
        context.addPyFile(str(target))
        context._inkstone_shipped = True
    return spark


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share. Where that is unset it is set to a folder of this machine, but
    only if all of Spark runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="inkstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/inkstone/{label}-{uuid.uuid4().hex}"
