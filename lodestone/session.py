"""Sessions with settings for large inputs."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def memory_settings(sizes: str) -> dict[str, str]:
    """Settings from "executor,driver,results", for example "4G,10G,8G"."""
    parts = [p.strip() for p in sizes.split(",")]
    if len(parts) != 3 or not all(parts):
        raise ValueError(f"expected executor, driver and result sizes, got {sizes!r}")
    return dict(zip(("spark.executor.memory", "spark.driver.memory", "spark.driver.maxResultSize"), parts))


def create_session(name: str, master: str | None = None, memory: str | None = None, settings: dict[str, str] | None = None, log_level: str = "WARN") -> SparkSession:
    """The session of this process, made if there is none."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | (memory_settings(memory) if memory else {}) | (settings or {})).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(log_level)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    own = tempfile.mkdtemp(prefix="ship-")
    shutil.copytree(root, Path(own, "tree", root.name), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(own, f"{root.name}_pkg"), "zip", Path(own, "tree")))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share, as ``spark.checkpoint.dir`` names it.

    Where that setting is unset, a temporary folder of this machine becomes the checkpoint folder, if all tasks run on this machine; a cluster fails.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if not at:
        if now.isDefined():
            at = now.get()
        elif sc.master.startswith("local[") or sc.master == "local":
            at = "file:" + tempfile.mkdtemp(prefix="spark-")
        else:
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not now.isDefined():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def portions(df: DataFrame, rows: int) -> int:
    """How many partitions hold ``df`` at ``rows`` rows each; one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once: written to the folder that executors share and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the folders of a table that ``stored`` wrote; nothing that reads it may follow."""
    spark = df.sparkSession
    for uri in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
