"""Making the package known to Python workers."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the session's executors, once for each application, so that workers need no path to it.

    The archive is made on the driver, which serves it to the executors; none of
    them reads the driver's folder.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:12]
    path = Path(tempfile.mkdtemp(prefix="tessella-")) / f"tessella-{digest}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in files:
            z.write(f, f.relative_to(root.parent).as_posix())
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)
