"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder in local mode; on a cluster an error."""
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _OWN[context.applicationId]


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table and read back: lineage ends there, it is computed once, and lost executors cost nothing."""
    place = new_folder(df.sparkSession, "cut")
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def fresh(taken: list[str], name: str) -> str:
    """``name``, or a variant of it that no column in ``taken`` has (case-insensitively)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"{name}_"
    return name
