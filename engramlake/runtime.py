"""Session defaults and lineage cuts shared by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def session(cores: str = "*", shuffle_partitions: int = 8, app: str = "engramlake") -> SparkSession:
    """A local session with the settings the queries assume (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a session, in case it is not installed where they run."""
    context = spark.sparkContext
    if getattr(context, "_engramlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    name = f"{tempfile.mkdtemp(prefix='engramlake-')}/engramlake.zip"  # the driver serves it from here
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(name)
    context._engramlake_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(df: DataFrame, each: int = 4 << 20) -> int:
    """How many tasks df's data deserve, by the size its plan is estimated at (no job): one for each so many bytes, and
    no fewer than the session's shuffle partitions, so that what a task reads stays as it is when the data grow.
    Plans over rows of unknown size are estimated at exabytes; they get the session's number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = shuffle_partitions(df.sparkSession)
    return least if size > 1 << 55 else max(least, -(-size // each))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session without spark.checkpoint.dir gets a folder of its own; on a
    cluster the setting is required, since a machine-local folder would be lost with
    its machine.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="engramlake-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back (runs a job).

    Later steps start from the files, so a lost executor costs a read and not the
    whole lineage, and several readers do not compute df several times. The files go
    when the driver's process ends, as results may read them until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/engramlake-cut/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            return


atexit.register(_clean)
