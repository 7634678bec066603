"""Folders and workers: where written copies lie, and whether executors find the package."""

import os
import subprocess
import sys

import pyarrow as pa

from paceline import session

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "1g").config("spark.driver.host", "127.0.0.1").config("spark.executor.memory", "1g")
         .config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {folder!r}).getOrCreate())
sys.path.remove({repo!r})
print("rows", entry.queries()["iou_tracker"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo, folder=str(tmp_path / "warehouse"))], cwd=tmp_path, env=env,
        capture_output=True, text=True, timeout=240)
    # the JVM tells why it ended before Python does
    assert "rows 1000" in out.stdout, out.stderr[:3000] + "\n...\n" + out.stderr[-1500:]


def test_release_deletes_a_copy(spark):
    df = session.cut_lineage(spark.range(5))
    folder = df._paceline_path.removeprefix("file:")
    assert os.path.isdir(folder) and df.count() == 5
    session.release(df)
    assert not os.path.exists(folder)


def _sizes(spark, rows, length):
    """Rows and bytes of each batch that a worker gets."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    texts = spark.range(rows, numPartitions=1).selectExpr(f"repeat(char(65 + id % 26), {length}) AS notes")
    return [tuple(r) for r in texts.mapInArrow(run, "n bigint, size bigint").collect()]


def test_batches_to_workers_are_bounded_by_size(spark):
    spark.conf.unset(session._BATCH_BYTES)
    session.ship_package(spark)
    long = _sizes(spark, 2_000, 5_000)
    assert sum(n for n, _ in long) == 2_000 and max(size for _, size in long) < session.BATCH_BYTES + 100_000
    # a text beyond the limit is a batch by itself, and short ones are bounded by their number as before
    assert [n for n, _ in _sizes(spark, 3, 2 * session.BATCH_BYTES)] == [1, 1, 1]
    assert [n for n, _ in _sizes(spark, 10_000, 10)] == [10_000]


def test_a_limit_of_the_session_stays(spark):
    spark.conf.set(session._BATCH_BYTES, "1m")
    try:
        session.ship_package(spark)
        assert max(size for _, size in _sizes(spark, 1_000, 5_000)) < 1_200_000
    finally:
        spark.conf.unset(session._BATCH_BYTES)
