"""Session construction shared by tests, bench and the command line."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "veilspan", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution; ``master`` is left to the launcher when None."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "8g").config("spark.driver.host", "127.0.0.1")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per context.

    Functions that run in workers are pickled by module name, so every worker must be able to import them,
    whatever folder the driver was started in.
    """
    sc = spark.sparkContext
    if getattr(sc, "_veilspan_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="veilspan-")
    path = f"{folder}/veilspan_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._veilspan_shipped = True
