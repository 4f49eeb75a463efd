"""Spark sessions for tests, the bench and scripts; on a cluster the caller brings its own."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = ":".join(x for x in (root, os.environ.get("PYTHONPATH", "")) if x)
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    builder = SparkSession.builder.master(f"local[{cores}]").appName("pricegrain")
    own = {
        "spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in own.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
