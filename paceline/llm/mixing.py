"""Mixing cameras' records to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import spread_join
from paceline.session import cut_lineage

SEED = 42
#: Hexadecimal digits of a digest that make a number between 0 and 1: 52 bits, exact in a double.
DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: 52 bits of their MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") / F.lit(float(1 << (4 * DIGITS)))


def poisson_steps(rate: Column) -> Column:
    """Distribution function of the Poisson law at 0, 1, ... as an array, far enough that nothing a double shows is left.

    Terms are taken from sums of logarithms, so that also large rates do not underflow.
    """
    most = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(60.0)).cast("int")
    start = F.struct(
        F.lit(0.0).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate / k.cast("double"))
        total = acc["sum"] + F.exp(log - rate)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["steps"], F.array(total)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step)["steps"]


def tempered_weights(alerts: DataFrame, power: float = 0.5) -> DataFrame:
    """``stream_id, weight``: each camera's number of rows to a ``power``; between 1 (as they are) and 0 (all the same)."""
    return alerts.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n")).select(
        "stream_id", F.pow(F.col("n").cast("double"), F.lit(power)).alias("weight"))


def source_rates(alerts: DataFrame, weights: DataFrame | None, total: float | None = None) -> DataFrame:
    """``stream_id, n, rate``: how often a row of each camera is repeated on average.

    ``weights`` has ``stream_id, weight``; cameras that it does not list weigh
    nothing, and None gives all cameras the same weight. Weights are positive or
    zero and are taken relative to their sum over the cameras that have rows.
    ``total`` is the number of rows wanted, by default as many as there are.
    """
    counts = alerts.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        given = weights.select(F.col("stream_id").alias("__stream"), F.col("weight").cast("double").alias("weight"))
        weighed = counts.join(given, F.col("stream_id").eqNullSafe(F.col("__stream")), "left").select(
            "stream_id", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighed = cut_lineage(weighed, narrow=True)
    sums = weighed.agg(F.sum("weight"), F.sum("n")).first()
    all_weight, all_rows = float(sums[0] or 0.0), float(sums[1] or 0)
    wanted = all_rows if total is None else float(total)
    if all_weight <= 0.0:
        return weighed.select("stream_id", "n", F.lit(0.0).alias("rate"))
    return weighed.select(
        "stream_id", "n",
        (F.lit(wanted) * F.col("weight") / F.lit(all_weight) / F.col("n").cast("double")).alias("rate"))


def mix_streams(
    alerts: DataFrame, weights: DataFrame | None = None, total: float | None = None, seed: int = SEED,
    shuffle: bool = True, distinct_by: Sequence[str] = (),
) -> DataFrame:
    """Repeat or leave out rows so that each camera has its target share of them, and put all into random order.

    ``alerts`` has ``id`` and ``stream_id`` (alert logs; any table with these
    two), and all its columns are handed on. A camera's rate is its share of the
    rows wanted by the rows it has; each row is repeated as often as a Poisson
    law with that mean says at a number made of ``seed`` and ``id``. So a row's
    copies do not depend on other rows of its camera but through the rate, and
    half a table drawn anew gives the same rows. Rows whose number comes out as 0
    are left out: that is the sampling this operator is for.

    Adds ``copy`` (from 0) and ``mix_key`` (a number in [0, 1) made of seed, id
    and copy, by which rows are ordered over all partitions if ``shuffle``);
    columns of these names in the input are replaced. A null camera is a camera,
    a null id is hashed as one value. Rows that repeat an id get the same number
    of copies unless ``distinct_by`` names columns to be hashed besides. A rate
    of 0 gives no rows, an empty table none.

    The rates are one row per camera; a camera with a large share of all rows is
    dealt over all tasks by id, never by camera.
    """
    rates = source_rates(alerts, weights, total)
    table = cut_lineage(rates.select(
        F.coalesce(F.concat(F.lit("="), F.col("stream_id").cast("string")), F.lit("")).alias("__stream"), "n",
        F.when(F.col("rate") > 0, poisson_steps(F.col("rate"))).otherwise(F.array(F.lit(1.0))).alias("__steps")), narrow=True)
    keyed = alerts.drop("copy", "mix_key").withColumn(
        "__stream", F.coalesce(F.concat(F.lit("="), F.col("stream_id").cast("string")), F.lit("")))
    more = [F.col(c) for c in distinct_by]
    place = uniform(F.lit(seed), F.col("id"), *more)
    counted = spread_join(keyed, table, ["__stream"], "n", ["__steps"], F.col("id")).withColumn("__u", place)
    # the first place whose step is above u: how many steps are at or below it
    repeats = F.size(F.filter("__steps", lambda s: s <= F.col("__u")))
    copies = counted.withColumn("__n", repeats).filter("__n > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n", "__u", "__steps", "__stream")
    mixed = copies.withColumn("mix_key", uniform(F.lit(f"{seed}+"), F.col("id"), F.col("copy"), *more))
    if not shuffle:
        return mixed
    return mixed.repartitionByRange("mix_key", "id", "copy").sortWithinPartitions("mix_key", "id", "copy")
