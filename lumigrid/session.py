"""The session and settings of the engine."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """shuffle_partitions should follow the data: about one for each 100 to 200 MB that a shuffle moves."""

    master: str | None = None
    app_name: str = "lumigrid"
    shuffle_partitions: int = 200
    checkpoint_dir: str | None = None
    driver_memory: str | None = None

    @classmethod
    def from_env(cls) -> Settings:
        env = os.environ
        return cls(env.get("LUMIGRID_MASTER"), env.get("LUMIGRID_APP", "lumigrid"), int(env.get("LUMIGRID_SHUFFLE_PARTITIONS", "200")), env.get("LUMIGRID_CHECKPOINT_DIR"), env.get("LUMIGRID_DRIVER_MEMORY"))


def session(settings: Settings | None = None) -> SparkSession:
    s = settings or Settings.from_env()
    b = SparkSession.builder.appName(s.app_name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.shuffle.partitions", s.shuffle_partitions)
    for key, value in (("spark.checkpoint.dir", s.checkpoint_dir), ("spark.driver.memory", s.driver_memory)):
        if value:
            b = b.config(key, value)
    if s.master:
        b = b.master(s.master)
    return b.getOrCreate()


def health(spark: SparkSession) -> dict[str, str]:
    return {"status": "ok", "spark": spark.version, "engine": "lumigrid"}
