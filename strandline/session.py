"""Session with the settings that the operators assume."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "strandline", **conf) -> SparkSession:
    """UTC, ANSI arithmetic, adaptive execution. conf: further settings, with _ for dots."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_strandline_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), "strandline.zip")  # the driver serves it to the executors
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(path)
    sc._strandline_shipped = True
