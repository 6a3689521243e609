"""Making the package importable in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import endcap

#: Most bytes of a batch of rows for Python; a row more is never parted.
BATCH_BYTES = "4m"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application, and bound batches of long rows.

    Batches for Python hold a number of rows by default; of long reads that is far too much.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(endcap.__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "endcap")
        sc.addPyFile(shutil.make_archive(base, "zip", root, "endcap"))
        _shipped.add(sc.applicationId)
    return spark
