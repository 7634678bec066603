"""Session settings the operators depend on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written copies.

    The one the session names (``spark.checkpoint.dir``), else a folder in the
    session's warehouse, which executors and driver share as well. A warehouse on
    a local disk is taken on local masters only; a folder that the session names is
    taken as it is, since a mounted share is ``file:`` too.
    """
    context = spark.sparkContext
    active = context._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return active.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        warehouse = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"))
        scheme = warehouse.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
        if scheme == "file" and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = f"{warehouse.toString().rstrip('/')}/_checkpoints"
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession) -> str:
    """The path of a folder of one's own in the shared one; it is made by what is first written there."""
    return f"{checkpoint_dir(spark).rstrip('/')}/paceline-{uuid.uuid4().hex}"


#: Files of a narrow table: this many shuffle partitions to one, but so many at least.
NARROW_SHARE, NARROW_FILES = 8, 8


def cut_lineage(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and go on from the written copy.

    The copy outlives the executors that made it, can be read by column, and
    tells the planner its true size. ``release`` deletes it once it is superseded.
    ``narrow`` says that the rows are a few numbers or digests each and come out of
    a shuffle that was laid out for whole texts: fewer and larger files do then.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(NARROW_FILES, int(spark.conf.get("spark.sql.shuffle.partitions")) // NARROW_SHARE))
    path = new_folder(spark)
    df.write.parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy._paceline_path = path
    return copy


def release(*copies: DataFrame) -> None:
    """Delete copies made by ``cut_lineage`` that nothing reads any more."""
    for copy in copies:
        spark = copy.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(copy._paceline_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch to a Python worker, about. Spark's own limit is 10,000 rows, which is tens of MB of texts.
BATCH_BYTES = 2 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Batches to the Python workers are bounded by size, unless the session names a limit itself.

    Executor and worker both hold a batch while it is sent, and neither gives the
    memory back to the system; no result depends on where a batch ends.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per session, wherever the driver was started."""
    bound_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_paceline_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="paceline-package-")  # the driver's own copy; Spark hands it to the executors
    archive = os.path.join(folder, "paceline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(path, name)
                    out.write(full, os.path.join("paceline", os.path.relpath(full, top)))
    context.addPyFile(archive)
    context._paceline_shipped = True
