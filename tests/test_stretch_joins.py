"""Tables with a row per stretch grow with the recording, so none of them goes through the driver into all tasks."""

import pytest
from pyspark.sql import functions as F

from paceline.operators import density, stretches
from paceline.plans import catalog

KEY, ORDER = ["k"], ["f"]


def rows(spark):
    return spark.range(400).select((F.col("id") % 2).alias("k"), F.expr("id div 2").alias("f"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("step", [
    lambda df, cut: stretches.previous_row(df, KEY, ORDER, ["f"], cut, "v"),
    lambda df, cut: stretches.last_known(df, KEY, ORDER, F.col("f"), cut, "v"),
    lambda df, cut: stretches.running_number(df, KEY, ORDER, cut, "v"),
    lambda df, cut: stretches.running_max(df, KEY, ORDER, F.col("f"), cut, "v"),
    lambda df, cut: stretches.trailing_rows(df, KEY, ORDER, F.col("f"), 3, cut, "v"),
])
def test_ordered_steps(spark, step):
    assert "Broadcast" not in plan(step(rows(spark), stretches.by_frames(F.col("f"), 10)))


def test_accepted_rows(spark, monkeypatch):
    plans, write = [], stretches.cut_lineage

    def noted(df, narrow=False):
        plans.append(plan(df))
        return write(df, narrow)

    monkeypatch.setattr(stretches, "cut_lineage", noted)
    out = stretches.accepted_rows(
        rows(spark), KEY, ORDER, [], stretches.by_frames(F.col("f"), 10), lambda last, row, m: row["f"] - last["f"] >= 7)
    assert sorted(map(tuple, out.collect())) == [(k, f) for k in (0, 1) for f in range(0, 200, 7)]
    assert len(plans) > 5 and not any("Broadcast" in p for p in [*plans, plan(out)])


def test_crowded_runs(spark):
    seen = rows(spark).select(
        F.lit("c").alias("stream_id"), F.concat(F.lit("z"), "k").alias("zone_id"), F.col("f").cast("double").alias("ts"),
        F.lit(5).alias("count"))
    out = density.density_runs(density.constant_rule(seen, 2, 1.0, 5.0), 20.0)
    assert "Broadcast" not in plan(out) and {r["run_start"] for r in out.collect()} == {0.0}


def test_people_of_decisions(spark, tmp_path):
    events = spark.range(2000).select(
        F.col("id").alias("event_id"), (F.col("id") % 13).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "purchase").otherwise("view").alias("event_type"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    out = catalog._by_person(spark, str(tmp_path))
    assert "Broadcast" not in plan(out)
    assert out.count() == catalog.decisions(spark, str(tmp_path)).count() > 0
