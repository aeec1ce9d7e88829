"""What a session needs before Python runs on its executors."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def workers_path(spark: SparkSession) -> None:
    """Put the folder that holds this package on the path of Python workers, wherever the driver was started."""
    here, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH")) if x)
