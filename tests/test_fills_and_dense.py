"""Fills and the dense detector: validation, identity, future and partition invariance, gap safety."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import DenseConfig, SparseConfig
from tidemark.operators import dense, fills
from tidemark.operators.chunks import asof_before, earlier_totals

RAW = "market_id string, timestamp string, price string, token_amount string, usd_amount string, nonusdc_side string, transaction_hash string, log_index long, maker string, taker string, contract string"
CFG = DenseConfig(min_baseline_bins=8, baseline_hours=2)
T0 = 1_735_689_600


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def one(t="1735689600", price="0.25", shares="10", usd="2.5", side="token1", tx="t", log=1, market="m", maker="a", taker="b", contract="c"):
    return (market, t, price, shares, usd, side, tx, log, maker, taker, contract)


def test_validation_and_times(spark):
    rows = [
        one(), one("2025-01-01T00:00:00Z", log=2), one("2025-01-01T02:00:00+02:00", log=3), one("2025-01-01T00:00:00", log=4), one("2025-01-01", log=5), one(None, log=6), one("x", log=7),
        one(price="1.2", log=8), one(price="NaN", log=9), one(shares="0", log=10), one(shares="Infinity", log=11), one(usd="-1", log=12), one(side="yes", log=13), one(market="nan", log=14), one(side="token2", log=15),
    ]
    kept, audit = fills.normalize(raw(spark, rows))
    got = {r.log_index: r for r in kept.select("*", F.unix_micros("timestamp").alias("us")).collect()}
    assert sorted(got) == [1, 2, 3, 15] and len({r.us for r in got.values()}) == 1
    assert got[15].price_outcome1 == 0.75 and got[15].price_observed == 0.25
    assert audit.first().asDict() == {"input_rows": 15, "invalid_rows_removed": 11, "duplicate_logs_removed": 0, "valid_rows": 4}


def test_log_identity(spark):
    kept, audit = fills.normalize(raw(spark, [one(), one(), one(log=2)]))
    assert kept.count() == 2 and audit.first().duplicate_logs_removed == 1
    with pytest.raises(ValueError, match="conflicting"):
        fills.normalize(raw(spark, [one(), one(price="0.3")]))
    missing, audit = fills.normalize(raw(spark, [one(), one(), one(log=None)]))
    assert missing.count() == 3 and audit.first().duplicate_logs_removed == 0
    assert fills.log_conflicts(fills.valid_fills(raw(spark, [one(), one(price="0.3", contract=None), one(contract=None)]))).count() == 0


def test_log_summary(spark):
    rows = [one(), one(), one(price="0.3"), one(price="2"), one(log=2), one(log=2, usd="3", contract=None), one(log=2, contract=None), one(log=None), one(log=None, shares="0"), one(log=3), one(log=3)]
    assert fills.log_summary(raw(spark, rows)).first().asDict() == {"input_rows": 11, "valid_rows": 9, "unnamed": 1, "repeated": 4, "conflicts": 1}
    unkeyed = fills.log_summary(raw(spark, rows).drop("log_index")).first()
    assert (unkeyed.input_rows, unkeyed.valid_rows, unkeyed.unnamed, unkeyed.repeated, unkeyed.conflicts) == (11, 9, 0, 0, 0)
    assert fills.log_summary(raw(spark, rows).limit(0)).first().asDict() == dict.fromkeys(("input_rows", "valid_rows", "unnamed", "repeated", "conflicts"), 0)
    kept, audit = fills.normalize(raw(spark, rows[:0]))
    assert kept.count() == 0 and tuple(audit.first()) == (0, 0, 0, 0)


def test_guards_and_participants(spark):
    with pytest.raises(ValueError, match="kind"):
        fills.guard(raw(spark, [one()]), "users")
    with pytest.raises(ValueError, match="users"):
        fills.guard(raw(spark, [one()]).withColumn("role", F.lit("x")), "trades")
    with pytest.raises(ValueError, match="nonusdc_side"):
        fills.guard(raw(spark, [one()]).drop("nonusdc_side"), "trades")
    rows = [one(maker="C", contract="c"), one(taker="0X" + "0" * 40), one(maker=None, taker="x", contract=None), one(taker="other")]
    assert fills.participant_fills(raw(spark, rows)).count() == 2
    assert fills.participant_fills(raw(spark, rows).drop("maker", "contract")).count() == 3


def bars_of(spark, prices, market="m", cfg=CFG, step=300):
    rows = [one(str(T0 + i * step), str(p), market=market, tx=f"{market}{i}", log=i) for i, p in enumerate(prices) if p is not None]
    return dense.dense_bars(fills.valid_fills(raw(spark, rows)), cfg)


def scored(spark, prices, **kw):
    return {r.bin_us: r for r in dense.movements(bars_of(spark, prices, **kw), CFG).collect()}


def walk(seed, n=120):
    rng, p, out = random.Random(seed), 0.5, []
    for _ in range(n):
        p = min(0.95, max(0.05, p + rng.gauss(0, 0.004)))
        out.append(round(p, 4))
    return out


def test_bars_are_dense_and_not_filled(spark):
    rows = bars_of(spark, [0.5, None, None, 0.6]).orderBy("bin_us").collect()
    assert [r.price for r in rows] == [0.5, None, None, 0.6] and [r.record_count for r in rows] == [1, 0, 0, 1]
    assert [r.thin_bin for r in rows] == [True, False, False, True] and rows[0].bin_us == (T0 + 300) * 1_000_000


def test_future_and_partition_invariance(spark):
    prices = walk(3)
    base = scored(spark, prices)
    changed = scored(spark, prices[:100] + [0.9] * 20)
    cut = sorted(base)[99]
    assert all(base[t] == changed[t] for t in base if t <= cut)
    both = dense.movements(bars_of(spark, prices).unionByName(bars_of(spark, walk(4), "n")), CFG).where("market_id = 'm'").collect()
    assert {r.bin_us: r for r in both} == base


def test_gaps_break_horizons(spark):
    prices = walk(5, 40)
    prices[20] = None
    rows = [r for _, r in sorted(scored(spark, prices).items())]
    assert all(r.displacement_pp is None for r in rows[20:24]) and rows[24].displacement_pp is not None and rows[19].displacement_pp is not None


def test_episodes_merge_and_equal_sessions(spark):
    prices = walk(6, 200)
    prices[100:] = [min(0.97, p + 0.2) for p in prices[100:]]
    prices[150:] = [p - 0.15 for p in prices[150:]]
    rows = dense.movements(bars_of(spark, prices), CFG)
    found = dense.episodes(rows, CFG).orderBy("detected_us").collect()
    assert len(found) >= 2 and sum(e.alert_bins for e in found) == rows.where("alert").count()
    assert {(e.detected_us, e.end_us) for e in found} == {(r.first_us, r.last_us) for r in dense.session_clusters(rows, CFG).collect()}
    assert all(e.start_us == e.detected_us - 20 * 60_000_000 for e in found)


def test_asof_is_strict_and_carries_over_chunks(spark):
    state = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 2.0), ("b", 5, 9.0)], "k string, us long, v double")
    probe = spark.createDataFrame([("a", 10, 1), ("a", 11, 2), ("a", 20, 3), ("a", 5000, 4), ("c", 7, 5)], "k string, us long, id int")
    got = {r.id: r.state_v for r in asof_before(probe, state, "k", "us", ["v"], 100).collect()}
    assert got == {1: None, 2: 1.0, 3: 1.0, 4: 2.0, 5: None}


def test_earlier_totals_exclude_equal_times(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 300), float(rng.randint(1, 9)), i) for i in range(200)]
    got = {r.id: (r.prior_count, r.prior_amount) for r in earlier_totals(spark.createDataFrame(rows, "k string, us long, v double, id int"), "k", "us", "v", 50).collect()}
    for k, t, _, i in rows:
        past = [v for q, u, v, _ in rows if q == k and u < t]
        assert got[i] == (len(past), sum(past))


def test_settings_are_validated():
    for bad in ({"bin_minutes": 7}, {"bin_minutes": True}, {"z_threshold": 0}):
        with pytest.raises(ValueError):
            DenseConfig(**bad)
    for bad in ({"horizons_seconds": (45,)}, {"horizons_seconds": ()}, {"horizons_seconds": (30, 30)}, {"min_coverage": 1.5}, {"bin_seconds": True}):
        with pytest.raises(ValueError):
            SparseConfig(**bad)
    assert SparseConfig().fingerprint != dataclasses.replace(SparseConfig(), z_threshold=5.0).fingerprint
