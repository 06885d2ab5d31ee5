"""What a session needs before jobs run Python code of this package on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Bytes of a batch between the JVM and Python; both sides hold whole batches, and long texts count by their length.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """For applications (registered queries, the pipeline): ship the package and bound the session's Arrow batches.

    Operators themselves change no setting of a caller's session.
    """
    ship(spark)
    if spark.conf.get(_BATCH, "64m") in ("64m", "67108864", "67108864b"):  # Spark's default; a caller's own value stays
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that they can import it from any folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="splitaudit-")
    archive = os.path.join(folder, "splitaudit.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
