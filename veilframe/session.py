"""Session settings that matter here, and the folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Settings the projections gain from.

    A release of many columns compiles to one long method. HotSpot never compiles methods
    above 8000 bytes of bytecode, so such a stage runs twice as fast when Spark splits it.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder all executors can reach: below spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own machine, which is
    removed at exit.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/veilframe-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="veilframe-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def table_store(spark: SparkSession):
    """A function that writes a table below the shared folder and reads it again."""
    folder = scratch_dir(spark)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return stored
