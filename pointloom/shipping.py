"""The package's own code for executors that do not find it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Rows handed to a Python worker at once end at so many bytes, unless the session says otherwise.
BATCH_BYTES, _BATCH = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Once for each application, hand a zip of this package to the executors; bound the batches of Python workers."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).parent
    at = Path(tempfile.mkdtemp()) / "pointloom_code.zip"
    with zipfile.ZipFile(at, "w") as out:
        for p in sorted(home.rglob("*.py")):
            out.write(p, p.relative_to(home.parent).as_posix())
    context.addPyFile(str(at))
    _shipped.add(context.applicationId)
