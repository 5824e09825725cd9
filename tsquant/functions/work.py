"""Where intermediate tables and stream state go."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared folder the session names for checkpoints.

    A session without that setting is refused: only its owner knows a folder that
    all nodes see.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder all nodes share")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
