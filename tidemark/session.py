"""A session with the settings that the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | None = None, memory: str = "8g") -> SparkSession:
    cores = cores or os.cpu_count() or 4
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
