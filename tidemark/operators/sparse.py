"""Sparse bars with corroboration and the multi-horizon detector."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.config import SparseConfig
from tidemark.functions.columns import floor_micros, iso, logit, micros, require_columns, short_hash
from tidemark.functions.order_statistics import FrameOrder
from tidemark.operators.chunks import CHUNK, OWN, chunk_window, own_rows, with_halo

SECOND = 1_000_000


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, name: str = "median_price") -> DataFrame:
    """For each key the smallest value whose cumulative weight reaches half the total."""
    per_value = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys).orderBy(value)
    run = per_value.withColumn("_run", F.sum("_w").over(w)).withColumn("_all", F.sum("_w").over(Window.partitionBy(*keys)))
    # Sums in another order may differ in the last digits: half is taken with that tolerance.
    return run.where(F.col("_run") >= F.col("_all") / 2 - F.col("_all") * 1e-12).groupBy(*keys).agg(F.min(value).alias(name))


def sparse_bars(fills: DataFrame, cfg: SparseConfig) -> DataFrame:
    """Only bins with fills; several logs of one transaction count once as support."""
    require_columns(fills, ["market_id", "timestamp", "price_outcome1", "token_amount", "usd_amount", "transaction_hash"])
    width = cfg.bin_seconds * SECOND
    at = fills.withColumn("us", micros(F.col("timestamp")))
    at = at.withColumn("bin_us", floor_micros(F.col("us"), width) + F.lit(width))
    keys = ["market_id", "bin_us"]
    middle = weighted_median(at, keys, "price_outcome1", "token_amount")
    near = F.abs(F.col("price_outcome1") - F.col("median_price")) <= cfg.corroboration_pp / 100 + 1e-12
    bars = at.join(middle, keys).groupBy(*keys).agg(
        (F.sum(F.col("price_outcome1") * F.col("token_amount")) / F.sum("token_amount")).alias("price"), F.first("median_price").alias("median_price"), F.countDistinct(F.when(near, F.col("transaction_hash"))).alias("corroborating_transactions"),
        F.min("price_outcome1").alias("low"), F.max("price_outcome1").alias("high"), F.sum("token_amount").alias("shares"), F.sum("usd_amount").alias("recorded_notional_usd"), F.count("*").alias("fill_count"),
        F.countDistinct("transaction_hash").alias("transaction_count"), F.min("us").alias("first_fill_us"), F.max("us").alias("last_fill_us"),
    )
    return bars.withColumn("supported", (F.col("corroborating_transactions") >= cfg.min_transactions) & (F.col("shares") >= cfg.min_shares))


def references(bars: DataFrame, cfg: SparseConfig) -> DataFrame:
    """bars once for each horizon, with the bar that ends exactly a horizon earlier (or nulls)."""
    each = bars.withColumn("horizon_seconds", F.explode(F.array(*[F.lit(h) for h in cfg.horizons_seconds])))
    each = each.withColumn("ref_us", F.col("bin_us") - F.col("horizon_seconds").cast("long") * SECOND)
    old = bars.select("market_id", F.col("bin_us").alias("ref_us"), F.col("median_price").alias("ref_price"), F.col("supported").alias("ref_supported"))
    return each.join(old, ["market_id", "ref_us"], "left").drop("ref_us")


def stepped(bars: DataFrame, cfg: SparseConfig) -> DataFrame:
    """step2: squared change in pp from the bin just before, where both are supported. For rows with _chunk."""
    w = chunk_window(["market_id"], "bin_us")
    adjacent = (F.col("bin_us") - F.lag("bin_us").over(w) == cfg.bin_seconds * SECOND) & F.col("supported") & F.lag("supported").over(w)
    step = (F.col("median_price") - F.lag("median_price").over(w)) * 100
    return bars.withColumn("step2", F.when(adjacent, step * step))


def coverage_and_variation(bars: DataFrame, cfg: SparseConfig) -> DataFrame:
    """(market_id, bin_us, horizon_seconds, coverage, variation_pp) from wall-clock frames."""
    b = cfg.bin_seconds
    longest = (max(cfg.horizons_seconds) + 2 * b) * SECOND
    cut = stepped(with_halo(bars, "bin_us", max(8 * longest, 3600 * SECOND), longest), cfg)
    w = chunk_window(["market_id"], "bin_us")
    parts = []
    for h in cfg.horizons_seconds:
        seen = F.count(F.lit(1)).over(w.rangeBetween(-(h + b) * SECOND + 1, 0)) / F.lit(float(h // b + 1))
        inside = w.rangeBetween(-h * SECOND + 1, 0)
        variation = F.when(F.count("step2").over(inside) == h // b, F.sqrt(F.sum("step2").over(inside)))
        parts.append(F.struct(F.lit(h).alias("horizon_seconds"), seen.alias("coverage"), variation.alias("variation_pp")))
    named = cut.select("market_id", "bin_us", "_chunk", "_own", *[p.alias(f"h{k}") for k, p in enumerate(parts)])
    return own_rows(named).select("market_id", "bin_us", F.explode(F.array(*[f"h{k}" for k in range(len(parts))])).alias("h")).select("market_id", "bin_us", "h.*")


def measured(bars: DataFrame, cfg: SparseConfig) -> DataFrame:
    """Change, log-odds change, variation, coverage and eligibility for each bar and horizon."""
    clip = cfg.logit_clip
    joined = references(bars, cfg).join(coverage_and_variation(bars, cfg), ["market_id", "bin_us", "horizon_seconds"])
    ends = F.col("supported") & F.coalesce("ref_supported", F.lit(False))
    return joined.withColumns({
        "change_pp": (F.col("median_price") - F.col("ref_price")) * 100, "log_odds_change": logit(F.col("median_price"), clip) - logit(F.col("ref_price"), clip),
        "endpoints_supported": ends, "eligible": ends & (F.col("coverage") >= cfg.min_coverage - 1e-9),
    })


METRICS = {"jump": "abs(change_pp)", "logit": "abs(log_odds_change)", "variation": "variation_pp"}


def _past_scores(table: pa.Table, horizons: tuple[int, ...], lag: int, day: int, least: int, floors: dict[str, float]) -> pa.Table:
    """Own rows of one (market, chunk), all horizons, with their z-scores. Every frame is a range of the horizon's eligible values in time order."""
    column = lambda name: table[name].to_numpy()
    us, horizon, own = column("bin_us"), column("horizon_seconds"), column(OWN)
    eligible = np.asarray(table["eligible"].fill_null(False))
    values = {name: np.asarray(table[f"_{name}"].cast("double").fill_null(np.nan)) for name in METRICS}
    given = {name: np.asarray(table[f"_{name}"].is_valid()) for name in METRICS}
    scores = {name: np.zeros(table.num_rows) for name in METRICS}
    known = {name: np.zeros(table.num_rows, bool) for name in METRICS}
    for h in horizons:
        rows = np.flatnonzero(horizon == h)
        rows = rows[np.argsort(us[rows], kind="stable")]
        for name in METRICS:
            past = rows[eligible[rows] & given[name][rows]]
            if not len(past):
                continue
            ask = rows[own[rows] & given[name][rows]]
            behind = us[ask] - (h * SECOND + lag)
            a, b = np.searchsorted(us[past], behind - day, "left"), np.searchsorted(us[past], behind, "right")
            enough = b - a >= least
            ask, a, b = ask[enough], a[enough], b[enough]
            if len(ask):
                order = FrameOrder(values[name][past])
                low, middle, high = (order.quantile(a, b, p) for p in (0.25, 0.5, 0.75))
                scores[name][ask] = (values[name][ask] - middle) / np.maximum((high - low) / 1.349, floors[name])
                known[name][ask] = True
    for name in METRICS:
        table = table.append_column(f"{name}_z", pa.array(scores[name], mask=~known[name]))
    return table.filter(table[OWN]).drop_columns([CHUNK, OWN, *[f"_{name}" for name in METRICS]])


def baselines(rows: DataFrame, cfg: SparseConfig) -> DataFrame:
    """rows with z-scores against eligible values that ended in [t-h-b-baseline, t-h-b].

    One pass serves all horizons: rows are dealt out by (market, chunk) once, with the longest horizon's halo, and a wavelet matrix of each horizon's values answers the
    quartiles of every frame in logarithmic time. Median, quartiles and floor as before: z = (metric - median) / max(IQR / 1.349, floor), null under min_baseline_samples values.
    """
    day, lag = cfg.baseline_hours * 3600 * SECOND, cfg.bin_seconds * SECOND
    longest = day + lag + max(cfg.horizons_seconds) * SECOND
    cut = with_halo(rows.withColumns({f"_{name}": F.expr(m) for name, m in METRICS.items()}), "bin_us", 4 * longest, longest)
    floors = {name: cfg.logit_scale_floor if name == "logit" else cfg.pp_scale_floor for name in METRICS}
    score = partial(_past_scores, horizons=tuple(cfg.horizons_seconds), lag=lag, day=day, least=max(1, cfg.min_baseline_samples), floors=floors)
    schema = StructType([*rows.schema.fields, *[StructField(f"{name}_z", DoubleType()) for name in METRICS]])
    return cut.groupBy("market_id", CHUNK).applyInArrow(lambda table: score(table), schema)


def signals(rows: DataFrame, cfg: SparseConfig) -> DataFrame:
    """jump_size, tail, variation_size, candidate and unusual. Net change, log-odds and variation limits grow with the horizon's square root."""
    grows = F.sqrt(F.greatest(F.lit(1.0), F.col("horizon_seconds") / 60))
    yes = lambda c: F.coalesce(c, F.lit(False))
    change, p, ref = F.abs("change_pp"), F.col("median_price"), F.col("ref_price")
    edge = (p <= 0.1) | (p >= 0.9) | (ref <= 0.1) | (ref >= 0.9)
    out = rows.withColumns({
        "jump_size": yes(change >= cfg.min_change_pp * grows - 1e-9),
        "tail": yes(edge & (change >= cfg.min_tail_change_pp - 1e-9) & (F.abs("log_odds_change") >= cfg.min_log_odds_change * grows - 1e-12)),
        "variation_size": yes(F.col("variation_pp") >= cfg.min_variation_pp * grows - 1e-9),
    })
    out = out.withColumn("candidate", F.col("eligible") & (F.col("jump_size") | F.col("tail") | F.col("variation_size")))
    high = lambda size, z: F.col(size) & yes(F.col(z) >= cfg.z_threshold)
    return out.withColumn("unusual", F.col("candidate") & (high("jump_size", "jump_z") | high("tail", "logit_z") | high("variation_size", "variation_z")))


def diagnostics(bars: DataFrame, cfg: SparseConfig) -> DataFrame:
    return signals(baselines(measured(bars, cfg), cfg), cfg)


def alerts(found: DataFrame, cfg: SparseConfig) -> DataFrame:
    """One row for each market and time with a candidate, its horizons in an array."""
    back = F.col("bin_us") - (F.col("horizon_seconds") + cfg.bin_seconds).cast("long") * SECOND
    names = F.array_compact(F.array(F.when(F.col("jump_size"), F.lit("net_change")), F.when(F.col("tail"), F.lit("tail_log_odds")), F.when(F.col("variation_size"), F.lit("variation"))))
    one = F.struct(
        "horizon_seconds", iso(F.timestamp_micros(back)).alias("window_start"), F.col("ref_price").alias("reference_price"), "change_pp", "log_odds_change", "variation_pp", "coverage", names.alias("signals"),
        "jump_z", "logit_z", "variation_z", "unusual",
    )
    grouped = found.where("candidate").withColumn("_start", back).groupBy("market_id", "bin_us").agg(
        F.min("_start").alias("start_us"), F.first("price").alias("price"), F.first("median_price").alias("median_price"), F.first("transaction_count").alias("transaction_count"),
        F.first("corroborating_transactions").alias("corroborating_transactions"), F.first("shares").alias("shares"), F.bool_or("unusual").alias("u"), F.max(F.col("jump_z").isNotNull()).alias("r"), F.array_sort(F.collect_list(one)).alias("signals"),
    )
    seen = iso(F.timestamp_micros("bin_us"))
    return grouped.select(
        short_hash(20, F.lit("fine-v2"), F.lit(cfg.fingerprint), F.col("market_id"), seen).alias("alert_id"), "market_id", seen.alias("detected_at"), iso(F.timestamp_micros("start_us")).alias("window_start"), "price", "median_price",
        "transaction_count", "corroborating_transactions", "shares", F.when(F.col("u"), "unusual_change").otherwise("supported_change").alias("tier"),
        F.when(F.col("r"), "past_only_reference").otherwise("insufficient_history_size_only").alias("baseline_note"), F.col("signals.horizon_seconds").alias("horizons_seconds"), "signals",
        F.lit("not_established").alias("causal_attribution"), F.lit(cfg.fingerprint).alias("config_fingerprint"), F.col("bin_us").alias("detected_us"), "start_us",
    )


#: Alerts are dealt out in chunks of so many longest groups.
GROUPS_A_CHUNK = 64
_PLACED = "market_id string, detected_us long, alert_id string, start_us long, first_us long"


def _transitions(key, frame: pd.DataFrame, gap: int, span: int, chunk: int) -> pd.DataFrame:
    """How a chunk passes an open group on: `times`, the alerts at which its first new group may begin, and for each the group that is then open at the chunk's end."""
    t = np.sort(frame["detected_us"].to_numpy())
    n = len(t)
    breaks = np.flatnonzero(np.diff(t) > gap) + 1
    after_gap = np.append(breaks, n)[np.searchsorted(breaks, np.arange(n), "right")]
    follows = np.minimum(after_gap, np.searchsorted(t, t + span, "right"))  # the next group's first alert, if one begins here
    open_at_end = np.arange(n)
    for k in range(n - 1, -1, -1):
        if follows[k] < n:
            open_at_end[k] = open_at_end[follows[k]]
    # An open group began before the chunk, so it ends within the first span: candidates are the alerts there and one more.
    some = min(n, int(np.searchsorted(t, (key[1]) * chunk + span, "right")) + 1)
    first_break = int(breaks[0]) if len(breaks) and breaks[0] < some else -1
    return pd.DataFrame({"market_id": [key[0]], "chunk": [key[1]], "first_us": [t[0]], "last_us": [t[-1]], "break_at": [first_break], "times": [t[:some]], "exits": [t[open_at_end[:some]]]})


def _entries(frames: Iterator[pd.DataFrame], gap: int, span: int) -> Iterator[pd.DataFrame]:
    """The group that is open where each chunk begins (first_us, last_us; null at a market's start). Chunks come by market and time, one row each."""
    market, first, last = object(), 0, 0
    for frame in frames:
        opened = []
        for row in frame.itertuples(index=False):
            fresh = row.market_id != market
            opened.append((None, None) if fresh else (first, last))
            at = 0 if fresh or row.first_us - last > gap else int(np.searchsorted(row.times, first + span, "right"))
            at = min(at, row.break_at) if row.break_at >= 0 else at
            if at < len(row.times):
                first = int(row.exits[at])
            market, last = row.market_id, row.last_us
        yield pd.DataFrame({"market_id": frame["market_id"], "chunk": frame["chunk"], "open_first": pd.array([f for f, _ in opened], "Int64"), "open_last": pd.array([x for _, x in opened], "Int64")})


def _group_starts(frame: pd.DataFrame, gap: int, span: int) -> pd.DataFrame:
    """first_us, the time at which a row's group began, from the group that was open when the chunk began."""
    frame = frame.sort_values(["detected_us", "alert_id"])
    first, last = frame["open_first"].iloc[0], frame["open_last"].iloc[0]
    starts, known = [], not pd.isna(first)
    for t in frame["detected_us"].tolist():
        if not known or t - last > gap or t - first > span:
            first, known = t, True
        last = t
        starts.append(int(first))
    return frame.assign(first_us=starts)[["market_id", "detected_us", "alert_id", "start_us", "first_us"]]


def placed_alerts(found: DataFrame, cfg: SparseConfig) -> DataFrame:
    """Alerts with the time at which their group began.

    That depends on all alerts before, but through the open group's start only. So each chunk of a market is summed up as a function from an open start to the start that is open at its end, in parallel; the
    functions of a market, one row a chunk with the alerts of one span, are applied one after the other; then all chunks are placed in parallel, each from the start it was handed.
    """
    gap, span = cfg.news_merge_seconds * SECOND, cfg.news_max_span_seconds * SECOND
    chunk = GROUPS_A_CHUNK * max(span, 1)
    rows = found.select("market_id", "detected_us", "alert_id", "start_us", F.floor(F.col("detected_us") / F.lit(chunk)).alias("chunk"))
    steps = rows.select("market_id", "chunk", "detected_us").groupBy("market_id", "chunk").applyInPandas(
        lambda key, frame: _transitions(key, frame, gap, span, chunk), "market_id string, chunk long, first_us long, last_us long, break_at int, times array<long>, exits array<long>"
    )
    steps = steps.repartition("market_id").sortWithinPartitions("market_id", "chunk")
    entries = steps.mapInPandas(partial(_entries, gap=gap, span=span), "market_id string, chunk long, open_first long, open_last long")
    return rows.join(entries, ["market_id", "chunk"]).groupBy("market_id", "chunk").applyInPandas(lambda frame: _group_starts(frame, gap, span), _PLACED)


def bounded_groups(found: DataFrame, cfg: SparseConfig) -> DataFrame:
    """Alerts grouped in time order; a group ends at a gap over news_merge_seconds or a span over news_max_span_seconds, so it is no longer than the span."""
    placed = placed_alerts(found, cfg)
    item = F.struct(F.col("detected_us").alias("t"), F.col("alert_id").alias("id"))
    out = placed.groupBy("market_id", "first_us").agg(F.array_sort(F.collect_list(item)).alias("xs"), F.max("detected_us").alias("last_us"), F.min("start_us").alias("start_us"))
    moment = lambda c: iso(F.timestamp_micros(c))
    return out.select(
        F.concat(F.lit("group-"), F.col("xs")[0]["id"]).alias("group_id"), "market_id", moment(F.col("first_us")).alias("first_detection"), moment(F.col("last_us")).alias("last_detection"), moment(F.col("start_us")).alias("window_start"),
        F.col("xs.id").alias("alert_ids"), "start_us", "first_us", "last_us", F.lit("retrieval_deduplication_not_independent_event").alias("purpose"),
    )


def market_summary(bars: DataFrame, found: DataFrame, alert_rows: DataFrame, cfg: SparseConfig) -> DataFrame:
    """Coverage of each market: slots from first to last bar, empty slots, supported bars, eligible windows, alerts by tier."""
    slots = ((F.max("bin_us") - F.min("bin_us")) / F.lit(cfg.bin_seconds * SECOND) + 1).cast("long")
    one = bars.groupBy("market_id").agg(slots.alias("slots"), F.count("*").alias("observed_bins"), F.count_if("supported").alias("supported_bins"))
    two = found.groupBy("market_id").agg(F.count_if("eligible").alias("eligible_windows"))
    three = alert_rows.groupBy("market_id").agg(F.count("*").alias("alerts"), F.count_if(F.col("tier") == "unusual_change").alias("unusual_alerts"))
    return one.join(two, "market_id", "left").join(three, "market_id", "left").select("market_id", "slots", (F.col("slots") - F.col("observed_bins")).alias("empty_bins"), "observed_bins", "supported_bins", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("eligible_windows", "alerts", "unusual_alerts")])


def top_in_window(alert_rows: DataFrame, start_us: int, end_us: int, n: int = 100, tier: str | None = None, longest: int | None = None) -> DataFrame:
    """The first n alerts with start < time <= end, of a tier or with a horizon up to `longest` where given."""
    out = alert_rows.where((F.col("detected_us") > start_us) & (F.col("detected_us") <= end_us))
    if tier:
        out = out.where(F.col("tier") == tier)
    if longest:
        out = out.where(F.array_min("horizons_seconds") <= longest)
    return out.orderBy("detected_us", "market_id").limit(n)


def gap_line(bars: DataFrame, width_us: int, column: str) -> DataFrame:
    """(market_id, us, value) with a null point behind each bar that another bin should have followed. A line drawn of it breaks at gaps."""
    # Whether a bar follows within a width is asked in chunks of a mirrored time line, whose halo holds the bars behind a chunk's end.
    cut = with_halo(bars.withColumn("_neg", -F.col("bin_us")), "_neg", 4096 * width_us, width_us)
    followed = F.count(F.lit(1)).over(chunk_window(["market_id"], "_neg").rangeBetween(-width_us, -1)) > 0
    ends = bars.groupBy("market_id").agg(F.max("bin_us").alias("_end"))
    rows = own_rows(cut.withColumn("_followed", followed)).join(ends, "market_id")
    own = F.struct(F.col("bin_us").alias("us"), F.col(column).cast("double").alias("value"))
    hole = F.struct((F.col("bin_us") + width_us).alias("us"), F.lit(None).cast("double").alias("value"))
    broken = ~F.col("_followed") & (F.col("bin_us") < F.col("_end"))
    return rows.withColumn("p", F.explode(F.when(broken, F.array(own, hole)).otherwise(F.array(own)))).select("market_id", "p.*")
