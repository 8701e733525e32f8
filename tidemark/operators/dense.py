"""Dense bars and the rolling median/MAD detector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.config import DenseConfig
from tidemark.functions.columns import floor_micros, iso, micros, short_hash
from tidemark.functions.order_statistics import FrameOrder
from tidemark.operators.chunks import CHUNK, OWN, chunk_window, with_halo

MINUTE = 60_000_000


def dense_bars(fills: DataFrame, cfg: DenseConfig) -> DataFrame:
    """One row for each bin from a market's first to its last, also empty ones; bins are left-closed and labelled by their end."""
    width = cfg.bin_minutes * MINUTE
    end = floor_micros(micros(F.col("timestamp")), width) + F.lit(width)
    sums = fills.groupBy("market_id", end.alias("bin_us")).agg(
        F.sum(F.col("price_outcome1") * F.col("token_amount")).alias("weighted"),
        F.sum("token_amount").alias("token_amount"),
        F.sum("usd_amount").alias("recorded_notional_usd"),
        F.count("price_outcome1").alias("record_count"),
        F.min("price_outcome1").alias("low"),
        F.max("price_outcome1").alias("high"),
    )
    span = fills.groupBy("market_id").agg(F.min(end).alias("a"), F.max(end).alias("b"))
    # The grid is cut into stretches first, so a long series is dealt out before it is expanded.
    stretch = width * 4096
    grid = span.withColumn("s", F.explode(F.sequence("a", "b", F.lit(stretch)))).select("market_id", F.explode(F.sequence(F.col("s"), F.least("b", F.col("s") + F.lit(stretch - width)), F.lit(width))).alias("bin_us"))
    count = F.coalesce("record_count", F.lit(0))
    return grid.join(sums, ["market_id", "bin_us"], "left").select(
        "market_id", "bin_us", F.timestamp_micros("bin_us").alias("bin_end"), F.try_divide("weighted", "token_amount").alias("price"), F.coalesce("token_amount", F.lit(0.0)).alias("token_amount"),
        F.coalesce("recorded_notional_usd", F.lit(0.0)).alias("recorded_notional_usd"), count.alias("record_count"), "low", "high", (count > 0).alias("observed"), ((count > 0) & (count < 3)).alias("thin_bin"),
    )


def _robust_z(values: pa.ChunkedArray, own: np.ndarray, first: np.ndarray, end: np.ndarray, cfg: DenseConfig) -> pa.Array:
    """(value - median) / max(1.4826 MAD, floor) of the rows [first, end) before each own row; null under min_baseline_bins values."""
    given = np.asarray(values.is_valid())
    numbers = np.asarray(values.cast("double").fill_null(np.nan))
    before = np.concatenate([[0], np.cumsum(given)])
    a, b = before[first], before[end]
    ask = np.flatnonzero(own & given & (b - a >= max(1, cfg.min_baseline_bins)))
    out, known = np.zeros(len(numbers)), np.zeros(len(numbers), bool)
    if len(ask):
        order = FrameOrder(numbers[given])
        middle = order.median(a[ask], b[ask])
        out[ask] = (numbers[ask] - middle) / np.maximum(1.4826 * order.deviation(a[ask], b[ask], middle), cfg.scale_floor_pp)
        known[ask] = True
    return pa.array(out, mask=~known)


def _robust_scores(table: pa.Table, cfg: DenseConfig) -> pa.Table:
    """Own rows of one (market, chunk) with jump_z and rv_z."""
    table = table.sort_by("bin_us")
    at = np.arange(table.num_rows)
    first, end = np.maximum(0, at - (cfg.steps + cfg.window - 1)), np.maximum(0, at - cfg.steps + 1)
    own = table[OWN].to_numpy()
    for metric, name in (("jump", "jump_z"), ("rv_pp", "rv_z")):
        table = table.append_column(name, _robust_z(table[metric], own, first, end, cfg))
    return table.filter(table[OWN]).drop_columns([CHUNK, OWN, "jump"])


def displacement(bars: DataFrame, cfg: DenseConfig) -> DataFrame:
    """displacement_pp and rv_pp over the horizon, only where every bin of it is observed; bars of (market, chunk) with halo."""
    k, w = cfg.steps, chunk_window(["market_id"], "bin_us")
    observed = F.sum(F.col("observed").cast("int")).over(w.rowsBetween(-k, 0)) == k + 1
    step = (F.col("price") - F.lag("price", 1).over(w)) * 100
    moved = (F.col("price") - F.lag("price", k).over(w)) * 100
    with_steps = bars.withColumn("step2", step * step).withColumn("complete", observed).withColumn("moved", moved)
    with_steps = with_steps.withColumn("thin_bins_before", F.sum(F.col("thin_bin").cast("long")).over(w.rowsBetween(-k, 0)))
    total, n = F.sum("step2").over(w.rowsBetween(-(k - 1), 0)), F.count("step2").over(w.rowsBetween(-(k - 1), 0))
    return with_steps.withColumn("rv_pp", F.when(F.col("complete") & (n == k), F.sqrt(total))).withColumn("displacement_pp", F.when(F.col("complete"), F.col("moved"))).drop("step2", "complete", "moved")


def movements(bars: DataFrame, cfg: DenseConfig) -> DataFrame:
    """bars with displacement, variation, robust z-scores against past-only baselines, flags and score."""
    width = cfg.bin_minutes * MINUTE
    k, halo = cfg.steps, (2 * cfg.steps + cfg.window + 1) * width
    cut = displacement(with_halo(bars, "bin_us", 4 * halo, halo), cfg).withColumn("jump", F.abs("displacement_pp"))
    schema = StructType([*cut.drop(CHUNK, OWN, "jump").schema.fields, StructField("jump_z", DoubleType()), StructField("rv_z", DoubleType())])
    # Medians and deviations of all frames of a chunk come from one wavelet matrix; a frame is never sorted.
    scored = cut.groupBy("market_id", CHUNK).applyInArrow(lambda table: _robust_scores(table, cfg), schema)
    return scored.withColumns({
        "baseline_ready": F.col("jump_z").isNotNull() & F.col("rv_z").isNotNull(),
        "jump_alert": F.coalesce((F.abs("displacement_pp") >= cfg.jump_pp) & (F.col("jump_z") >= cfg.z_threshold), F.lit(False)),
        "volatility_alert": F.coalesce((F.col("rv_pp") >= cfg.rv_pp) & (F.col("rv_z") >= cfg.z_threshold), F.lit(False)),
        "score": F.greatest("jump_z", "rv_z"),
    }).withColumn("alert", F.col("jump_alert") | F.col("volatility_alert"))


def episodes(scored: DataFrame, cfg: DenseConfig) -> DataFrame:
    """Alerts merged while gaps are at most merge_minutes. Only alerts, a small part of all bars, pass the per-market window."""
    w = Window.partitionBy("market_id").orderBy("bin_us")
    flagged = scored.where("alert")
    gap = F.col("bin_us") - F.lag("bin_us").over(w)
    marked = flagged.withColumn("starts", F.when(gap.isNull() | (gap > cfg.merge_minutes * MINUTE), 1).otherwise(0))
    numbered = marked.withColumn("cluster", F.sum("starts").over(w))
    at, first = F.col("bin_us"), F.struct("bin_us", "displacement_pp", "price", "thin_bins_before")
    peak = F.struct(F.col("score"), (-at).alias("neg"), F.col("displacement_pp"), F.col("rv_pp"))
    found = numbered.groupBy("market_id", "cluster").agg(
        F.min(first).alias("f"), F.max("bin_us").alias("last_us"), F.max(peak).alias("p"), F.bool_or("jump_alert").alias("j"), F.bool_or("volatility_alert").alias("v"), F.count("*").alias("alert_bins")
    )
    moment = lambda us: iso(F.timestamp_micros(us))
    back = (cfg.horizon_minutes + cfg.bin_minutes) * MINUTE
    return found.select(
        short_hash(16, F.col("market_id"), moment(F.col("f.bin_us"))).alias("episode_id"), "market_id", moment(F.col("f.bin_us") - back).alias("window_start"), moment(F.col("f.bin_us")).alias("detected_at"),
        moment(F.col("last_us")).alias("window_end"), moment(-F.col("p.neg")).alias("peak_at"), F.col("p.score").alias("score"), F.col("f.displacement_pp").alias("initial_displacement_pp"),
        F.col("p.displacement_pp").alias("peak_displacement_pp"), F.col("p.rv_pp").alias("peak_rv_pp"), F.col("f.price").alias("marker_price"),
        F.when(F.col("j") & F.col("v"), "jump_and_volatility").when(F.col("j"), "jump").otherwise("volatility").alias("kind"), "alert_bins", F.col("f.thin_bins_before").alias("thin_bins_in_first_window"),
        (F.col("f.bin_us") - back).alias("start_us"), F.col("f.bin_us").alias("detected_us"), F.col("last_us").alias("end_us"),
        F.lit("Coarse trade-bin window, not an identified information-arrival time.").alias("timing_note"),
    )


def top_episodes(found: DataFrame, n: int) -> DataFrame:
    """The n best episodes of each market by score, then id."""
    w = Window.partitionBy("market_id").orderBy(F.desc("score"), "episode_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def session_clusters(scored: DataFrame, cfg: DenseConfig) -> DataFrame:
    """The same clusters through session_window: gaps of exactly merge_minutes merge."""
    grouped = scored.where("alert").groupBy("market_id", F.session_window("bin_end", f"{cfg.merge_minutes} minutes")).agg(F.min("bin_us").alias("first_us"), F.max("bin_us").alias("last_us"), F.count("*").alias("alert_bins"))
    return grouped.drop("session_window")
