"""Order statistics of frames, and the detectors that use them, against sorting each frame."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import DenseConfig, SparseConfig
from tidemark.functions.order_statistics import FrameOrder
from tidemark.operators import dense, sparse

SECOND = 1_000_000


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 500])
@pytest.mark.parametrize("kind", ["reals", "ties", "equal"])
def test_frames_equal_sorting(n, kind):
    rng = np.random.default_rng(n)
    values = {"reals": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "equal": np.full(n, 2.5)}[kind]
    order = FrameOrder(values)
    a = rng.integers(0, n, 300)
    b = np.array([rng.integers(x + 1, n + 1) for x in a])
    k = np.array([rng.integers(0, y - x) for x, y in zip(a, b, strict=True)])
    frames = [values[x:y] for x, y in zip(a, b, strict=True)]
    assert (order.kth(a, b, k) == [np.sort(f)[j] for f, j in zip(frames, k, strict=True)]).all()
    middle = order.median(a, b)
    assert (middle == [np.median(f) for f in frames]).all()
    assert (order.count_below(a, b, middle) == [(f < m).sum() for f, m in zip(frames, middle, strict=True)]).all()
    for m in (middle, middle + 0.3, np.full(300, -9.0), np.full(300, 9.0)):
        assert np.allclose(order.deviation(a, b, m), [np.median(np.abs(f - x)) for f, x in zip(frames, m, strict=True)], rtol=0, atol=1e-14)
    for p in (0, 0.25, 0.75, 1):
        assert np.allclose(order.quantile(a, b, p), [np.quantile(f, p) for f in frames], rtol=0, atol=1e-12)


def test_no_frames():
    order = FrameOrder(np.zeros(0))
    nothing = np.zeros(0, np.int64)
    assert len(order.kth(nothing, nothing, nothing)) == len(order.median(nothing, nothing)) == len(order.deviation(nothing, nothing, np.zeros(0))) == 0


def test_past_baseline_over_chunk_borders(spark):
    """Random bars over many chunks, two horizons, nulls and ineligible rows: z-scores as from each frame on its own."""
    cfg = SparseConfig(bin_seconds=60, horizons_seconds=(60, 300), baseline_hours=1, min_baseline_samples=5)
    rng = np.random.default_rng(4)
    rows = []
    for market in ("a", "b"):
        for t in np.flatnonzero(rng.random(1500) < 0.6):
            for h in cfg.horizons_seconds:
                change = None if rng.random() < 0.1 else float(np.round(rng.normal(), 2))
                rows.append((market, int(t) * 60 * SECOND, h, change, None if rng.random() < 0.1 else float(rng.normal()), float(rng.random()) if rng.random() < 0.9 else None, bool(rng.random() < 0.8) if rng.random() < 0.95 else None))
    df = spark.createDataFrame(rows, "market_id string, bin_us long, horizon_seconds int, change_pp double, log_odds_change double, variation_pp double, eligible boolean").repartition(3)
    got = {(r.market_id, r.bin_us, r.horizon_seconds): r for r in sparse.baselines(df, cfg).collect()}
    assert len(got) == len(rows)
    floors = {"jump": cfg.pp_scale_floor, "logit": cfg.logit_scale_floor, "variation": cfg.pp_scale_floor}
    scored = 0
    for market in ("a", "b"):
        for h in cfg.horizons_seconds:
            mine = [r for r in rows if r[0] == market and r[2] == h]
            us = np.array([r[1] for r in mine])
            for metric, column in (("jump", 3), ("logit", 4), ("variation", 5)):
                values = np.array([np.nan if r[column] is None else abs(r[column]) for r in mine])
                usable = ~np.isnan(values) & np.array([bool(r[6]) for r in mine])
                for r, t, x in zip(mine, us, values, strict=True):
                    frame = values[usable & (us >= t - (h + 60 + 3600) * SECOND) & (us <= t - (h + 60) * SECOND)]
                    z = getattr(got[market, r[1], h], f"{metric}_z")
                    if len(frame) < 5 or np.isnan(x):
                        assert z is None
                    else:
                        low, middle, high = np.quantile(frame, [0.25, 0.5, 0.75])
                        assert abs(z - (x - middle) / max((high - low) / 1.349, floors[metric])) < 1e-9
                        scored += 1
    assert scored > 2000


def test_rolling_median_and_deviation_over_chunk_borders(spark):
    cfg = DenseConfig(bin_minutes=5, horizon_minutes=10, baseline_hours=1, min_baseline_bins=3)
    rng = np.random.default_rng(5)
    n = 400
    price = np.where(rng.random(n) < 0.97, np.round(rng.random(n), 2), np.nan)
    bars = spark.createDataFrame(
        [("m", k * dense.MINUTE * 5, None if np.isnan(p) else float(p), not np.isnan(p), False) for k, p in enumerate(price)], "market_id string, bin_us long, price double, observed boolean, thin_bin boolean"
    ).withColumn("bin_end", F.timestamp_micros("bin_us"))
    got = sorted(dense.movements(bars, cfg).collect(), key=lambda r: r.bin_us)
    assert len(got) == n
    scored = 0
    for name, values in (("jump_z", [None if r.displacement_pp is None else abs(r.displacement_pp) for r in got]), ("rv_z", [r.rv_pp for r in got])):
        for k, r in enumerate(got):
            frame = np.array([x for x in values[max(0, k - (cfg.steps + cfg.window - 1)) : max(0, k - cfg.steps + 1)] if x is not None])
            if values[k] is None or len(frame) < 3:
                assert r[name] is None
            else:
                middle = np.median(frame)
                assert abs(r[name] - (values[k] - middle) / max(1.4826 * np.median(np.abs(frame - middle)), cfg.scale_floor_pp)) < 1e-9
                scored += 1
    assert scored > 200
