"""Session helpers: the shared scratch folder and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_shipped: set[tuple[str, str]] = set()


def local_session(cores: str = "8", name: str = "softseek") -> SparkSession:
    """A session for tests and the bench, with a scratch folder of its own where none is set; on a cluster
    the caller brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    if not (session.conf.get(_SETTING, None) or session.sparkContext.getConf().get(_SETTING)):
        session.conf.set(_SETTING, tempfile.mkdtemp(prefix="softseek-"))
    return session


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; unset is an error, as executors would not see
    the driver's disk."""
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not root:
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    return root.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/softseek-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def release_scratch(spark: SparkSession) -> None:
    """Delete the tables that this application keeps in the shared folder.

    Results that were returned before may still read them: write or collect these first.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage, keeps columnar pruning, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession, folder: str | Path) -> None:
    """Give the executors a package folder, whatever their working directory; once per application."""
    folder = Path(folder)
    key = (spark.sparkContext.applicationId, str(folder))
    if key in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="softseek-code-")) / f"{folder.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(folder.rglob("*.py")):
            archive.write(source, source.relative_to(folder.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(key)
