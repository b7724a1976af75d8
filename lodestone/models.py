"""Models on disk: Parquet tables and a JSON sidecar with what they depend on."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def save(df: DataFrame, path: str, name: str, dependencies: list[str] | None = None, **facts) -> str:
    """Write a table and its sidecar; gives the model's id. A bag of words must name its vocabulary."""
    if name == "bow" and not dependencies:
        raise ValueError("a bag of words depends on a document frequency model")
    own = str(uuid.uuid4())
    df.write.parquet(f"{path}/table")
    meta = json.dumps({"uuid": own, "name": name, "dependencies": dependencies or [], **facts})
    df.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")
    return own


def load(spark: SparkSession, path: str, name: str | None = None) -> tuple[DataFrame, dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    if name is not None and meta["name"] != name:
        raise ValueError(f"{path} holds {meta['name']}, not {name}")
    return spark.read.parquet(f"{path}/table"), meta


def exists(spark: SparkSession, path: str) -> bool:
    meta = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    return meta.getFileSystem(spark._jsc.hadoopConfiguration()).exists(meta)


def check_depends(meta: dict, on: dict) -> None:
    if on["uuid"] not in meta["dependencies"]:
        raise ValueError(f"{meta['name']} {meta['uuid']} was not made with {on['name']} {on['uuid']}")
