"""Sessions, and the package's own code on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(app: str = "skein", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and last-wins maps, which upserts into maps need."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_top(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as the session names it. Only a local master, as in tests, gets a
    folder of its own where none is named."""
    top = spark.conf.get(CHECKPOINT_KEY, None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors see")
        top = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set(CHECKPOINT_KEY, top)
    return top.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python finds it wherever it started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="skein-"), "skein.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("skein", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
