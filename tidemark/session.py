"""Session helpers: one place for the settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()

#: Settings every pipeline assumes. ANSI mode stays at its default (on); code is safe under it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application, unless they find it on their path."""
    context = spark.sparkContext
    home = Path(__file__).resolve().parents[1]
    on_path = any(Path(p or ".").resolve() == home for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)])
    if on_path or context.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((home / "tidemark").rglob("*.py")):
            out.write(file, file.relative_to(home))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
