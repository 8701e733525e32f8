"""Bounded groups: chunks with transition functions against one fold over all alerts."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import SparseConfig
from tidemark.operators import sparse

SECOND = sparse.SECOND


def fold(alerts, gap, span):
    """first detection of each alert's group."""
    out, market, first, last = {}, None, 0, 0
    for m, t, name in sorted(alerts):
        if m != market or t - last > gap * SECOND or t - first > span * SECOND:
            first = t
        market, last = m, t
        out[name] = first
    return out


@pytest.mark.parametrize(("gap", "span"), [(60, 600), (30, 100), (600, 600), (1, 90)])
def test_groups_equal_a_fold(spark, gap, span):
    rng = random.Random(gap + span)
    alerts = []
    for market, step in (("dense", 30), ("sparse", 900), ("bursts", 20)):
        t = rng.choice([-1, 1]) * 10**6
        for k in range(1500):
            t += 0 if rng.random() < 0.05 else step * rng.choice([1, 1, 2, 3] if rng.random() < 0.97 else [50, 400])
            alerts.append((market, t * SECOND, f"{market}{k:05d}"))
    alerts.append(("one", 7, "one0"))
    df = spark.createDataFrame([(m, t, name, t - 5) for m, t, name in alerts], "market_id string, detected_us long, alert_id string, start_us long").repartition(4)
    cfg = SparseConfig(bin_seconds=30, horizons_seconds=(30,), news_merge_seconds=gap, news_max_span_seconds=span)
    got = {r.alert_id: r.first_us for r in sparse.placed_alerts(df, cfg).collect()}
    assert got == fold(alerts, gap, span)
    groups = sparse.bounded_groups(df, cfg).collect()
    assert sorted(x for g in groups for x in g.alert_ids) == sorted(got) and len(groups) == len({(name[:3], first) for name, first in got.items()})
    assert sparse.bounded_groups(df.limit(0), cfg).count() == 0


def test_a_market_of_many_alerts_takes_many_tasks(spark):
    """1e6 alerts of one market, one a bin, without a gap: groups of a span each, and no task places more than its share."""
    cfg = SparseConfig(news_merge_seconds=60, news_max_span_seconds=3600)
    n, width = 1_000_000, 30 * SECOND
    alerts = spark.range(n, numPartitions=8).select(F.lit("m").alias("market_id"), (F.col("id") * width).alias("detected_us"), F.format_string("%08d", "id").alias("alert_id"), (F.col("id") * width).alias("start_us"))
    placed = sparse.placed_alerts(alerts, cfg).withColumn("task", F.spark_partition_id())
    rows = placed.groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.col("first_us") != F.col("detected_us") - F.col("detected_us") % (121 * width)).alias("wrong")).collect()
    assert sum(r.n for r in rows) == n and not any(r.wrong for r in rows)
    assert len(rows) > 1 and max(r.n for r in rows) < 0.6 * n
