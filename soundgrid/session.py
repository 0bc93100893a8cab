"""Session builder and materialised intermediates."""
from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "soundgrid") -> SparkSession:
    """A session for tests and the benchmark; on a cluster use spark-submit's own."""
    return ship(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small local tables: keep all cores busy in the kernels instead of one large task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SOUNDGRID_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per application, so that tasks import it wherever they start."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="spark-soundgrid-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names.

    Only a local session without one (tests) gets a scratch folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-soundgrid-")


#: Spark's switch that removes an execution's shuffle files when it ends; a task that still needs some computes them again.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate table once and continue from it.

    Used where a reduced table (cells, regions, onsets) feeds several branches, so
    that the raw scan behind it runs once and a lost executor costs no re-scan. The
    shuffle files behind it go as soon as the table stands; the table itself stays
    until discard() or the folder's own rule removes it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/soundgrid-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def discard(*tables: DataFrame) -> None:
    """Removes tables that materialise() wrote, once nothing will read them again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
