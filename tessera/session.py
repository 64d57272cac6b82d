"""Session profile: settings every query of this package expects or tolerates."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Non-ANSI arithmetic (wrap, NULL on x/0 and on bad casts) and NULL for size(NULL).
PROFILE = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "false",
    "spark.sql.legacy.sizeOfNull": "false",
    "spark.sql.storeAssignmentPolicy": "LEGACY",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with PROFILE; conf takes dots written as double underscores."""
    b = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ:
        b = b.master(master or "local[*]")
    extra = {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=PROFILE | extra).getOrCreate()
