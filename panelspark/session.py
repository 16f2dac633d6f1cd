"""Session defaults and the shared folder for stage tables."""

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_SHIPPED: set[tuple[str, str]] = set()


def get_spark(app: str = "panelspark", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution, Arrow and UTC; `conf` keys use `__` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder for stage tables: `spark.checkpoint.dir`, shared by all executors.

    Only a local-mode session may fall back to a temporary folder; on a cluster
    a machine-local folder would be lost with its machine, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[sc.applicationId] = tempfile.mkdtemp(prefix="panelspark-")
    return _LOCAL_SCRATCH[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, name: str = "stage", path: str | None = None) -> DataFrame:
    """Write `df` once as Parquet and continue from the written table.

    Later jobs re-read the table instead of recomputing its history, also after
    executors are lost.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession, *sources: str) -> None:
    """Send Python packages (folders) to all workers, this library by default, once for each application.

    Functions that run in workers import their modules there; without this, only workers started beside the
    library or with it on their path could.
    """
    sc = spark.sparkContext
    for source in sources or (os.path.dirname(os.path.abspath(__file__)),):
        if (sc.applicationId, source) in _SHIPPED:
            continue
        name, parent = os.path.basename(source), os.path.dirname(source)
        path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{name}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(source):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.relpath(full, parent))
        sc.addPyFile(path)
        _SHIPPED.add((sc.applicationId, source))
