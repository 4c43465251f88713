"""Session factory: adaptive execution, UTC, Arrow transfer."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

#: Folders of local sessions without spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder if driver and executors are one process."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: a folder that the driver and all executors share is needed")
        base = _OWN.get(sc.applicationId) or _OWN.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="emberline-"))
    return base.rstrip("/")


def session(app: str = "emberline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine's plans are written for; ``conf`` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
