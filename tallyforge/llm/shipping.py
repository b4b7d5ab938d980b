"""What a session needs before it runs these operators in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of an Arrow batch: texts are long, and both sides hold a batch whole.
BATCH_ROWS = 500
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and once an application this package for workers on which it isn't installed."""
    if int(spark.conf.get(_ROWS_SETTING)) > BATCH_ROWS:
        spark.conf.set(_ROWS_SETTING, BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.realpath(os.path.join(tempfile.mkdtemp(prefix="tallyforge-"), "tallyforge_package.zip"))
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
