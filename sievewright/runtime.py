"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="sievewright-"), "sievewright.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A named table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where the session names none, only a session whose executors are threads
    of this process gets a local folder; on a cluster that would be a folder
    that the executors don't share, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sievewright-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_written: dict[str, list[str]] = {}


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; runs a job.

    Cuts the lineage in a way that survives the loss of executors, and lets
    several consumers read one result. What an application wrote is deleted
    by ``release``, at the latest when Python ends.
    """
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/{application}/{label}-{uuid.uuid4().hex}"
    if application not in _written:
        _written[application] = []
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), _written[application])
    _written[application].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` wrote in this application; frames
    that read them can't be used any more."""
    _delete(spark._jvm, spark._jsc.hadoopConfiguration(), _written.get(spark.sparkContext.applicationId, []))


def _delete(jvm, configuration, paths: list[str]) -> None:
    while paths:
        try:
            path = jvm.org.apache.hadoop.fs.Path(paths.pop())
            path.getFileSystem(configuration).delete(path, True)
        except Exception:  # the JVM may be gone when Python ends
            return


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", max_rows: int = 50_000, salts: int = 32) -> DataFrame:
    """Join with a dimension that is small as a rule but not by contract.

    The right side is read up to ``max_rows``, which runs a job: within it, it
    is broadcast; beyond it, the join is salted, so that a key that holds a
    third of the left rows is still spread over ``salts`` tasks. Both ways give
    the same rows.
    """
    rows = right.limit(max_rows + 1).toArrow()
    if rows.num_rows <= max_rows:
        return left.join(F.broadcast(left.sparkSession.createDataFrame(rows, right.schema)), on, how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns[:4]], F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    return spread.join(salted, [*on, "_salt"], how).drop("_salt")
