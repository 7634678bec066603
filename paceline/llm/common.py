"""What several of the corpus operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of all text rules here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key with more than this share of the rows is handled as a hot one; at most ``1 / HOT_SHARE`` keys can be.
HOT_SHARE = 0.001
SALTS = 1024


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def strip_spaces(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def without_spaces(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def spread_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], count: str, payload: Sequence[str], spread_by: Column,
) -> DataFrame:
    """``left`` with the ``payload`` of the row of ``right`` that has its keys; null where there is none.

    ``right`` is a written table with one row per key, and ``count`` is how many
    rows of ``left`` hold the key, at least. Keys above ``HOT_SHARE`` of the rows
    are broadcast, as there are at most ``1 / HOT_SHARE`` of them whatever the
    data; the rows that they match take no part in the shuffle by key. They are
    dealt over all tasks by ``spread_by`` instead.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > F.lit(max(1.0, total * HOT_SHARE))
    first = right.filter(hot).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.struct(*payload).alias("__hot"))
    rest = right.filter(~hot).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.lit(0).alias("__k_salt"), F.struct(*payload).alias("__cold"))
    met = left.join(F.broadcast(first), [F.col(k) == F.col(f"__k_{k}") for k in keys], "left").drop(
        *[f"__k_{k}" for k in keys])
    # a row already served, or with a null key, looks for a key that does not exist, each with a salt of its own
    open_ = F.col("__hot").isNull()
    for k in keys:
        open_ = open_ & F.col(k).isNotNull()
    asking = met.withColumn(
        "__salt", F.when(open_, 0).otherwise(1 + F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    ).withColumns({f"__ask_{k}": F.when(open_, F.col(k)) for k in keys})
    joined = asking.join(
        rest,
        [F.col("__salt") == F.col("__k_salt")] + [F.col(f"__ask_{k}") == F.col(f"__k_{k}") for k in keys], "left")
    return joined.withColumns(
        {p: F.coalesce(F.col("__hot")[p], F.col("__cold")[p]) for p in payload}
    ).drop("__hot", "__cold", "__salt", "__k_salt", *[f"__k_{k}" for k in keys], *[f"__ask_{k}" for k in keys])
