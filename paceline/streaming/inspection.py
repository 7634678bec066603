"""What a running or stopped stream remembers, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the processors keep by key: rows that wait, what the rule remembers, when the key was last worked on.
VARIABLES = ("waiting", "memory", "latest")


def state_rows(spark: SparkSession, checkpoint: str, variable: str = "memory", operator: int = 0) -> DataFrame:
    """The state ``variable`` of a stream after its last batch, a row for each key: ``key``, ``body``, ``characters``.

    ``checkpoint`` is the stream's checkpoint folder; ``operator`` tells several
    stateful operators of one query apart, 0 being the first. For the map of access
    decisions (``book``) there is a row for each page.
    """
    found = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable).load(checkpoint)
    if "user_map_key" in found.columns:
        kept = found.select(F.struct("key.*", "user_map_key.*").alias("key"), F.col("user_map_value.*"))
    elif "list_element" in found.columns:
        kept = found.select("key", "list_element.*")
    else:
        kept = found.select("key", "value.*")
    body = F.col("body") if "body" in kept.columns else F.to_json(F.struct(*[c for c in kept.columns if c != "key"]))
    return kept.select("key", body.alias("body"), F.length(body).alias("characters"))


def state_sizes(spark: SparkSession, checkpoint: str, variable: str = "memory", operator: int = 0) -> DataFrame:
    """Keys and characters that a state variable holds: ``keys``, ``characters``, ``largest`` (null without keys)."""
    rows = state_rows(spark, checkpoint, variable, operator)
    return rows.agg(
        F.countDistinct("key").alias("keys"), F.coalesce(F.sum("characters"), F.lit(0)).alias("characters"),
        F.max("characters").alias("largest"))
