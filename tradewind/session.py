"""Session settings the operators are tuned for; none of them changes a result."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    # Wall-clock timestamps carry no zone; this keeps zoned input comparable with them.
    "spark.sql.session.timeZone": "UTC",
    # Runtime plans: merge small partitions, split skewed ones, broadcast what proves small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Join by hashing instead of sorting where every partition of one side is at most this large.
    # Joins with folded tables are of that kind; Spark checks it once the shuffle is written.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Do not look up the Python line behind every column expression for error messages.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """``builder`` with the settings above; later ``config`` calls still override them."""
    return builder.config(map=SETTINGS)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the tasks, once per application; functions in tasks import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tradewind-")) / "tradewind.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))


_SHIPPED: set[str] = set()
