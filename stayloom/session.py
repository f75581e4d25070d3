"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Run-time SQL settings every plan here relies on. Sizes and partition counts stay with the cluster's own
# configuration; AQE coalesces or splits from there.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot admission is split even where that costs one more exchange before the aggregate above the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # What crosses between the JVM and a Python worker at a time; one longer row still goes whole.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}

_local_scratch: str | None = None
_shipped: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session that was created elsewhere."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "stayloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session for scripts and tests; on a cluster ``master`` is left to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package's code to the Python workers, once per application, by way of the shared scratch folder.

    Needed where the workers can't import it otherwise: a driver started from another folder, or executors without the package.
    """
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        root, packed = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent).as_posix())
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{_application_folder(spark)}/stayloom.zip")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(packed.getvalue()))
        out.close()
        spark.sparkContext.addPyFile(target.toString())
        _shipped.add(application)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _local_scratch is None or not os.path.isdir(_local_scratch):
        _local_scratch = tempfile.mkdtemp(prefix="stayloom-")
        atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
    return _local_scratch


def _application_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/stayloom-{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, label: str) -> str:
    """A path in the scratch folder that no earlier stage has used."""
    return f"{_application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and continue from the files (runs a job).

    Parquet in the shared folder outlives any executor, and later reads still prune columns and push filters.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The records of ``df`` dealt evenly over as many tasks as run at once, for tables that many jobs read."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


class LoopState:
    """The state of an iterative operator: each round is written, then the round before it is removed."""

    def __init__(self, label: str):
        self.label = label
        self._path: str | None = None

    def advance(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path, previous = stage_path(spark, self.label), self._path
        df.write.parquet(path)
        self._path = path
        if previous is not None:
            delete_path(spark, previous)
        return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove every stage this application has written; frames that still read them become invalid."""
    delete_path(spark, _application_folder(spark))
