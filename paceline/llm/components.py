"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.session import cut_lineage, release


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _least(links: DataFrame) -> DataFrame:
    """For each ``a`` the least of itself and its ``b``, as a written table so that a hub can be split in the join."""
    return cut_lineage(links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select(
        "u", F.least("u", "m").alias("m")), narrow=True)


def _round(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both)
    # every neighbour above u is hung on the least one
    large = cut_lineage(
        both.join(least, F.col("a") == F.col("u")).filter("b > u").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct(), narrow=True)
    # then u and all neighbours below it
    below = _least(large)
    small = cut_lineage(
        large.join(below, F.col("a") == F.col("u"))
        .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                  F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        .select("e.*").filter("a > b").distinct(), narrow=True)
    return small, [least, large, below]


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``: two numbers each); ``root`` is the least node it reaches.

    Alternating large and small stars: each round hangs neighbours on the least
    neighbour, so depth falls by a factor. Rounds grow with the logarithm of the
    longest chain, each one is a written table, and superseded ones are deleted.
    """
    now = cut_lineage(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), narrow=True)
    state = _state(now)
    while state[0]:
        after, done = _round(now)
        release(now, *done)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
