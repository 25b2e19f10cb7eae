"""Sessions, and shipping this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, once for each application, through Spark's own file distribution."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="package-")) / f"{here.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"{here.name}/{p.relative_to(here)}")
    spark.sparkContext.addPyFile(str(target))


def local(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine, with the settings that results depend on."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    b = b.config("spark.sql.shuffle.partitions", "8").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
