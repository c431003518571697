"""Session defaults, and getting the package to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}
_BATCH, _BATCH_UNSET = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def build_session(app: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this engine's defaults; ``conf`` overrides them (dots written as is, via ``**{...}``)."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once for each application.

    Functions of an installed package are pickled by reference, so each worker must be able to import it.
    Rows here are whole texts, so a session that has Spark's own batch size for Arrow gets a smaller one, which bounds
    what a worker holds; any other setting stays.
    """
    if spark.conf.get(_BATCH) == _BATCH_UNSET:
        spark.conf.set(_BATCH, DEFAULTS[_BATCH])
    sc = spark.sparkContext
    if getattr(ship, "done", None) != sc.applicationId:
        root = Path(__file__).resolve().parent
        out = os.path.join(tempfile.mkdtemp(prefix="quarry-"), "quarry.zip")
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(out)
        ship.done = sc.applicationId
    return spark
