"""Gives the Python workers this package where the cluster was not started with it, and small Arrow batches."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import evidex

_SHIPPED: set[str] = set()
#: Spark's setting of the rows of an Arrow batch, its default, and what whole texts take instead.
BATCH, DEFAULT_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def ship(spark: SparkSession) -> None:
    """Send the package through Spark's own file distribution, once for each application.

    A batch of whole texts is held several times over, by the executor and its worker, so
    a session that has Spark's own default takes fewer rows at a time.
    """
    if spark.conf.get(BATCH) == DEFAULT_ROWS:
        spark.conf.set(BATCH, ROWS)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(evidex.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="evidex-"), "evidex.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("evidex", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
