"""Exact copies among the notes of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import spread_join, without_spaces
from paceline.session import cut_lineage, release

#: Runs that meet in one run at each round.
FAN_IN = 8
#: Rows of the input that one leaf run is made from, on average.
ROWS_PER_RUN = 20_000

ENTRY = ["slice", "digest", "text_sha256", "norm_chars"]


def _digests(alerts: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("notes"), F.lit(""))
    bare = alerts.select("id", F.length(text).cast("long").alias("n_chars"), without_spaces(text).alias("bare"))
    return bare.select(
        "id", "n_chars", F.xxhash64("bare").alias("digest"), F.sha2("bare", 256).alias("text_sha256"),
        F.length("bare").cast("long").alias("norm_chars"))


def _merged(runs: DataFrame, run: Column) -> DataFrame:
    """One run for each value of ``run`` and slice: entries of one text become one, the better keeper stays.

    Entries meet on digest, SHA-256 and length together, so that two texts that
    share a digest are told apart at every level.
    """
    best = F.min(F.struct((-F.col("n_chars")).alias("neg"), F.col("keep_id").isNull().alias("none"), "keep_id"))
    return runs.groupBy(run.alias("run"), *ENTRY).agg(best.alias("best"), F.sum("n").alias("n")).select(
        "run", *ENTRY, (-F.col("best.neg")).alias("n_chars"), F.col("best.keep_id").alias("keep_id"), "n")


def merge_runs(entries: DataFrame, leaves: int, slices: int, fan_in: int = FAN_IN) -> DataFrame:
    """The last run of a merge tree over digests: one row per text with keeper and number of copies.

    Leaves are runs over groups of rows, each with one entry per text at most;
    in round r the runs whose numbers agree but for their last r digits (to the
    base ``fan_in``) meet. The digests are cut into ``slices`` ranges with a tree
    for each, so that also the last run is spread over tasks and each of them
    holds a bounded part. Each level is a written table, sorted by digest.
    """
    runs, level = entries, None
    while True:
        merged = _merged(runs, F.col("run"))
        written = cut_lineage(merged.sortWithinPartitions("slice", "run", "digest"), narrow=True)
        if level is not None:
            release(level)
        level = written
        if leaves == 1:
            return level
        leaves = -(-leaves // fan_in)
        runs = level.withColumn("run", F.floor(F.col("run") / F.lit(fan_in)).cast("long"))


def exact_duplicates(
    alerts: DataFrame, rows_per_run: int = ROWS_PER_RUN, fan_in: int = FAN_IN,
) -> DataFrame:
    """Which notes of the alert log are the same, and which row of each group stays.

    ``alerts`` has ``id`` and ``notes``, as the violation and the density alert
    logs do; other columns are not read. Two notes are the same when they are
    identical without ``[\\x20\\x09-\\x0D]``. Of equal notes the longest original
    (code points) stays, of these the row with the smallest id.

    Returns a row per alert: ``id, keep_id, group_size, kept, text_sha256``. Null
    notes count as empty; a row without id is kept only if no row of its group
    has one, and rows that repeat an id are copies like others, of which ``kept``
    marks every row with the kept id and length. An empty log gives no rows.
    """
    rows = cut_lineage(_digests(alerts))
    total = rows.count()
    leaves = max(1, -(-total // rows_per_run))
    slices = leaves
    entries = rows.select(
        F.pmod(F.xxhash64("id", "n_chars"), F.lit(leaves)).cast("long").alias("run"),
        F.pmod(F.shiftrightunsigned("digest", 32), F.lit(slices)).cast("long").alias("slice"),
        "digest", "text_sha256", "norm_chars", "n_chars", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    last = merge_runs(entries, leaves, slices, fan_in).select(
        "digest", "text_sha256", "norm_chars", F.col("n_chars").alias("keep_chars"), "keep_id",
        F.col("n").alias("group_size"))
    return spread_join(
        rows, last, ["digest", "text_sha256", "norm_chars"], "group_size", ["keep_chars", "keep_id", "group_size"],
        F.col("id"),
    ).select(
        "id", "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("kept"),
        "text_sha256")
