"""Session settings and tables kept between the jobs of one operator."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lumenfold", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may go without that setting: it gets a folder of its own.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenfold-"))
    return sc.getCheckpointDir()


#: Shuffle files of a query go when it has ended, not when the driver happens to collect its garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below :func:`shared_dir` and read it back.

    Cuts the lineage, so that a lost executor costs a re-read and no recomputation, and drops the
    shuffle files of the write. The table goes with :func:`discard`, at last when the driver's JVM ends.
    ``codec``: a Parquet compression other than the session's, for large tables of text.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenfold/{uuid.uuid4().hex}/{label}"
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)
    _file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenfold_stash = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`stash` gave and whose last reader is done."""
    for df in tables:
        path = getattr(df, "_lumenfold_stash", None)
        if path is not None:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            _file_system(df.sparkSession, path).delete(place.getParent(), True)


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, which may not have the driver's path."""
    sc = spark.sparkContext
    if getattr(sc, "_lumenfold_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lumenfold-")) / "lumenfold.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    sc.addPyFile(str(target))
    sc._lumenfold_shipped = True
