"""Lines that many notes share, found with levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import lower_ascii, spread_join, strip_spaces
from paceline.session import cut_lineage, release

#: Batches that the log is taken in, highest ids first.
BATCHES = 5
#: Runs of a level that are compacted to one run of the next level.
FAN_IN = 3


def _lines(notes: Column) -> Column:
    return F.split(F.coalesce(notes, F.lit("")), "\n")


def line_keys(alerts: DataFrame, min_chars: int) -> DataFrame:
    """``id, text, pos, line``: hash of every line whose key has ``min_chars`` code points at least."""
    lines = alerts.select("id", "text", F.posexplode(_lines(F.col("notes"))).alias("pos", "raw"))
    keyed = lines.select("id", "text", "pos", lower_ascii(strip_spaces(F.col("raw"))).alias("key"))
    return keyed.filter(F.length("key") >= min_chars).select("id", "text", "pos", F.unhex(F.md5("key")).alias("line"))


class LineRuns:
    """Runs of line hashes in levels: ``line``, how many alerts hold it, and the alert that owns it.

    A run is a written table sorted by line. Each batch is merged against the
    runs there are: lines that none of them has (a merge anti-join) are owned by
    their largest id in the batch, for the others only the number is added. The
    batch becomes a run of level 0. ``fan_in`` runs of a level are compacted to
    one of the next, so a line hash is rewritten once per level, and the number
    of runs to look through grows with the logarithm of the batches.

    Batches have to come with falling ids, and an alert has to be in one batch.
    """

    def __init__(self, fan_in: int = FAN_IN):
        self.fan_in, self.levels = fan_in, [[]]

    @staticmethod
    def _run(rows: DataFrame) -> DataFrame:
        return cut_lineage(rows.sortWithinPartitions("line"), narrow=True)

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        together = runs[0]
        for run in runs[1:]:
            together = together.unionByName(run)
        return together

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        if len(runs) == 1:
            return runs[0]
        return self._union(runs).groupBy("line").agg(
            F.max("owner_id").alias("owner_id"), F.sum("n_alerts").alias("n_alerts"))

    def add(self, batch: DataFrame) -> None:
        """Take in ``id, line`` of one batch, each pair once."""
        own = batch.groupBy("line").agg(F.max("id").alias("owner_id"), F.count(F.lit(1)).alias("n_alerts"))
        runs = [run for level in self.levels for run in level]
        if runs:
            known = self._union(runs).filter("owner_id is not null").select("line")
            fresh = own.join(known.hint("merge"), "line", "left_anti")
            again = own.join(known.hint("merge"), "line", "left_semi")
            new = self._run(fresh.unionByName(again.withColumn("owner_id", F.lit(None).cast("bigint"))))
        else:
            new = self._run(own)
        self.levels[0].append(new)
        self._compact()

    def _compact(self) -> None:
        at = 0
        while len(self.levels[at]) >= self.fan_in:
            full = self.levels[at]
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(self._run(self._merged(full)))
            release(*full)
            self.levels[at] = []
            at += 1

    def repeated(self, min_alerts: int) -> DataFrame:
        """``line, owner_id, n_alerts`` of the lines in ``min_alerts`` alerts or more, over all runs, which become one."""
        runs = [run for level in self.levels for run in level]
        if len(runs) > 1:
            self.levels = [[self._run(self._merged(runs))]]
            release(*runs)
            runs = self.levels[0]
        return runs[0].filter(F.col("n_alerts") >= min_alerts)

    def close(self) -> None:
        release(*[run for level in self.levels for run in level])


def _kept_lines(notes: Column, dropped: Column) -> Column:
    """The lines of ``notes`` that are not at one of the ``dropped`` places (ascending), in time linear in both."""
    lines = _lines(notes)
    ends = F.concat(dropped, F.array(F.size(lines)))
    befores = F.concat(F.array(F.lit(-1)), dropped)
    stays = F.slice(
        F.flatten(F.zip_with(ends, befores, lambda end, before: F.concat(
            F.array_repeat(F.lit(True), end - before - 1), F.array(F.lit(False))))),
        F.lit(1), F.size(lines))
    return F.array_join(F.zip_with(lines, stays, lambda line, stay: F.when(stay, line)), "\n")


def drop_repeated_lines(
    alerts: DataFrame, min_chars: int = 20, min_alerts: int = 3, batches: int = BATCHES, fan_in: int = FAN_IN,
) -> DataFrame:
    """Take lines out of the alerts' notes that ``min_alerts`` alerts or more have; the largest id keeps them.

    ``alerts`` has ``id`` (a number) and ``notes``, as the violation and density
    alert logs do; all other columns are handed on. Notes are split at line feeds
    (null or empty: one empty line). A line's key is the line without
    ``[\\x20\\x09-\\x0D]`` at both ends, ASCII upper case lowered; keys under
    ``min_chars`` code points are left alone. Of a key in ``min_alerts`` alerts all
    lines go except those in the alert with the largest id.

    Returns the alerts with ``notes`` of the lines that stay, joined by line
    feeds, and with ``n_lines`` (before) and ``n_dropped``; columns of these two
    names in the input are replaced. Rows that repeat an id count as one alert
    when a key's alerts are counted, and each of them keeps or loses its own lines,
    whether their notes are the same or not: all rows of the largest id keep them.
    Rows without an id are one alert, below all others. An empty log gives no rows.

    The log is taken in ``batches`` of falling ids by ``LineRuns``; then every
    line looks up its hash once. Lines of a frequent key are pre-aggregated per
    alert, and spread over all tasks in the look-up.
    """
    # rows of one id are told apart by their text: those of equal text lose the same lines
    whole = alerts.withColumns({
        "__id": F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))),
        "__text": F.unhex(F.md5(F.coalesce("notes", F.lit("")).cast("binary")))})
    keys = line_keys(whole.select(F.col("__id").alias("id"), F.col("__text").alias("text"), "notes"), min_chars)
    ends = alerts.agg(F.min(F.col("id").cast("long")), F.max(F.col("id").cast("long"))).first()
    low, high = ends if ends[0] is not None else (0, 0)
    # in doubles, which never fall where ids rise and do not overflow
    width = max(1.0, (float(high) - float(low) + 1.0) / batches)
    batch = F.least(F.lit(batches - 1), F.floor((F.lit(float(high)) - F.col("id").cast("double")) / F.lit(width)))
    once = cut_lineage(
        keys.groupBy("id", "text", "line").agg(F.collect_set("pos").alias("at"))
        .withColumn("batch", F.when(F.col("id") < low, batches - 1).otherwise(batch).cast("int")), narrow=True)
    runs = LineRuns(fan_in)
    for k in range(batches):
        runs.add(once.filter(F.col("batch") == k).select("id", "line").distinct())
    repeated = runs.repeated(min_alerts)
    lost = spread_join(once, repeated, ["line"], "n_alerts", ["owner_id"], F.col("id")).filter(
        F.col("owner_id").isNotNull() & (F.col("owner_id") != F.col("id")))
    places = cut_lineage(lost.groupBy(F.col("id").alias("__lost_id"), F.col("text").alias("__lost_text")).agg(
        F.sort_array(F.flatten(F.collect_list("at"))).alias("__dropped")), narrow=True)
    release(once)
    runs.close()
    joined = whole.join(places, (F.col("__id") == F.col("__lost_id")) & (F.col("__text") == F.col("__lost_text")), "left")
    dropped = F.coalesce("__dropped", F.expr("cast(array() as array<int>)"))
    return joined.withColumns({
        "n_lines": F.size(_lines(F.col("notes"))).cast("long"),
        "n_dropped": F.size(dropped).cast("long"),
        "notes": F.when(F.col("__dropped").isNull(), F.coalesce("notes", F.lit(""))).otherwise(
            _kept_lines(F.col("notes"), dropped)),
    }).drop("__id", "__text", "__lost_id", "__lost_text", "__dropped")
