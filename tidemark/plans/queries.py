"""Registered queries over the benchmark tables, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import aware_time, floor_micros, iso, micros, relevant_pairs
from tidemark.functions.text import canonical_url, paragraphs
from tidemark.operators import capture, charts, decisions, dense, fills, news, sparse
from tidemark.plans import fixtures as fx
from tidemark.plans.fixtures import CONTEXT, DENSE, MARKETS, NEWS, SPARSE, iso_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def _fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills.valid_fills(fx.event_fills(spark, sf_dir))


def _dense(spark, sf_dir):
    return dense.dense_bars(_fills(spark, sf_dir), DENSE)


def _scored(spark, sf_dir):
    return dense.movements(_dense(spark, sf_dir), DENSE)


def _episodes(spark, sf_dir):
    return dense.episodes(_scored(spark, sf_dir), DENSE)


def _sparse(spark, sf_dir):
    return sparse.sparse_bars(_fills(spark, sf_dir), SPARSE)


def _diagnostics(spark, sf_dir):
    return sparse.diagnostics(_sparse(spark, sf_dir), SPARSE)


def _alerts(spark, sf_dir):
    return sparse.alerts(_diagnostics(spark, sf_dir), SPARSE)


def _links(spark, sf_dir):
    return news.match_candidates(_episodes(spark, sf_dir), fx.news_documents(spark, sf_dir), MARKETS, NEWS)


# Fills


@query(f"""with {fx.FE} select event_id, market_id, us, price as price_observed, round(p1, 6) as price_outcome1, token_amount, round(price * token_amount, 6) as usd_amount from f
where event_id % 97 <> 0 and event_id % 83 <> 0""")
def q_normalize_fills(spark, sf_dir):
    out = fills.valid_fills(fx.messy_fills(spark, sf_dir))
    return out.select("event_id", "market_id", micros(F.col("timestamp")).alias("us"), "price_observed", *r6("price_outcome1"), "token_amount", *r6("usd_amount"))


@query("""select count(*)::bigint as input_rows, sum((event_id % 97 = 0 or event_id % 83 = 0)::bigint)::bigint as invalid_rows_removed, 0::bigint as duplicate_logs_removed, sum((event_id % 97 <> 0 and event_id % 83 <> 0)::bigint)::bigint as valid_rows from events""")
def q_normalize_audit(spark, sf_dir):
    return fills.normalize(fx.messy_fills(spark, sf_dir))[1]


@query(f"""with {fx.FL} select transaction_hash, log_index, count(*)::bigint as n_rows from g group by 1, 2
having count(distinct market_id) > 1 or count(distinct us) > 1 or count(distinct p1) > 1 or count(distinct token_amount) > 1 or count(distinct usd_amount) > 1""")
def q_log_conflicts(spark, sf_dir):
    return fills.log_conflicts(fills.valid_fills(fx.order_fills(spark, sf_dir)))


@query(f"""with {fx.FL}, n as (select *, row_number() over (partition by transaction_hash, log_index order by us, market_id, p1, token_amount, usd_amount, maker, nonusdc_side, price, taker, taker_direction) as n from g)
select transaction_hash, log_index, market_id, round(p1, 6) as price_outcome1, token_amount, round(usd_amount, 6) as usd_amount from n where n = 1""")
def q_log_dedup(spark, sf_dir):
    out = fills.dedup_logs(fills.valid_fills(fx.order_fills(spark, sf_dir)), check=False)
    return out.select("transaction_hash", "log_index", "market_id", *r6("price_outcome1"), "token_amount", *r6("usd_amount"))


@query(f"""with {fx.FL} select market_id, count(*)::bigint as n, round(sum(token_amount), 6) as shares from fl where maker not in (select 's' || l_suppkey from lineitem where l_suppkey % 10 = 0) group by 1""")
def q_participant_filter(spark, sf_dir):
    raw = fx.order_fills(spark, sf_dir)
    raw = raw.withColumn("contract", F.when(F.col("maker").rlike("0$"), F.upper("maker")))
    return fills.participant_fills(raw).groupBy("market_id").agg(F.count("*").alias("n"), F.round(F.sum("token_amount"), 6).alias("shares"))


@query(f"with {fx.FE} select market_id, count(*)::bigint as fills, round(sum(usd_amount), 6) as usd, min(us) as first_us, max(us) as last_us from f group by 1")
def q_extract_summary(spark, sf_dir):
    us = micros(F.col("timestamp"))
    return _fills(spark, sf_dir).groupBy("market_id").agg(F.count("*").alias("fills"), F.round(F.sum("usd_amount"), 6).alias("usd"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


# Dense bars and their detector


@query(f"with {fx.DENSE_SQL} select market_id, bin_us, round(price, 6) as price, token_amount, round(usd, 6) as recorded_notional_usd, n::bigint as record_count, round(low, 6) as low, round(high, 6) as high, observed, thin as thin_bin from bars")
def q_bars_dense(spark, sf_dir):
    return _dense(spark, sf_dir).select("market_id", "bin_us", *r6("price"), "token_amount", *r6("recorded_notional_usd"), "record_count", *r6("low", "high"), "observed", "thin_bin")


@query(f"with {fx.MOVES_SQL} select market_id, bin_us, round(disp, 6) as displacement_pp, round(rv, 6) as rv_pp from mv")
def q_displacement_rv(spark, sf_dir):
    """Hourly bars with gap-safe displacement and realised variation."""
    from tidemark.operators.chunks import own_rows, with_halo

    width = 3_600_000_000
    cut = with_halo(_dense(spark, sf_dir), "bin_us", 512 * width, 8 * width)
    return own_rows(dense.displacement(cut, DENSE)).select("market_id", "bin_us", *r6("displacement_pp", "rv_pp"))


@query(f"with {fx.FLAGS_SQL} select market_id, bin_us, round(jump_z, 6) as jump_z, round(rv_z, 6) as rv_z from z where jump_z is not null or rv_z is not null")
def q_rolling_median_mad(spark, sf_dir):
    return _scored(spark, sf_dir).where("jump_z is not null or rv_z is not null").select("market_id", "bin_us", *r6("jump_z", "rv_z"))


@query(f"with {fx.FLAGS_SQL} select market_id, bin_us, jump_alert, vol_alert as volatility_alert, jump_z is not null and rv_z is not null as baseline_ready, round(score, 6) as score from fl0")
def q_alert_flags(spark, sf_dir):
    return _scored(spark, sf_dir).select("market_id", "bin_us", "jump_alert", "volatility_alert", "baseline_ready", *r6("score"))


_EPISODE = f"""episode_id, market_id, {iso_sql('start_us')} as window_start, {iso_sql('detected_us')} as detected_at, {iso_sql('end_us')} as window_end, {iso_sql('peak_us')} as peak_at, round(score, 6) as score,
round(d0, 6) as initial_displacement_pp, round(pd, 6) as peak_displacement_pp, round(pr, 6) as peak_rv_pp, round(p0, 6) as marker_price, kind, alert_bins::bigint as alert_bins, th::bigint as thin_bins_in_first_window"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select(
        "episode_id", "market_id", "window_start", "detected_at", "window_end", "peak_at", *r6("score", "initial_displacement_pp", "peak_displacement_pp", "peak_rv_pp", "marker_price"), "kind", "alert_bins", "thin_bins_in_first_window"
    )


@query(f"with {fx.EPISODES_SQL} select {_EPISODE} from ee")
def q_episodes(spark, sf_dir):
    return _shown(_episodes(spark, sf_dir))


@query(f"with {fx.EPISODES_SQL} select {_EPISODE} from ee qualify row_number() over (partition by market_id order by score desc, episode_id) <= 3")
def q_topk_episodes(spark, sf_dir):
    return _shown(dense.top_episodes(_episodes(spark, sf_dir), NEWS.max_episodes_per_market))


@query(f"with {fx.EPISODES_SQL} select market_id, detected_us as first_us, end_us as last_us, alert_bins::bigint as alert_bins from ee")
def q_session_clusters(spark, sf_dir):
    return dense.session_clusters(_scored(spark, sf_dir), DENSE)


@query(f"with {fx.FLAGS_SQL} select market_id, min(bin_us) as first_us, max(bin_us) as last_us, count(*)::bigint as bars, sum((jump_z is not null and rv_z is not null)::int)::bigint as baseline_ready from fl0 group by 1")
def q_manifest_coverage(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("market_id").agg(F.min("bin_us").alias("first_us"), F.max("bin_us").alias("last_us"), F.count("*").alias("bars"), F.count_if("baseline_ready").alias("baseline_ready"))


# Sparse bars and their detector


@query(f"""with {fx.SPARSE_SQL} select market_id, bin_us, round(price, 6) as price, round(median_price, 6) as median_price, corr::bigint as corroborating_transactions, round(low, 6) as low, round(high, 6) as high, shares,
round(usd, 6) as recorded_notional_usd, fills::bigint as fill_count, txs::bigint as transaction_count, first_us as first_fill_us, last_us as last_fill_us, supported from bars""")
def q_bars_sparse(spark, sf_dir):
    return _sparse(spark, sf_dir).select(
        "market_id", "bin_us", *r6("price", "median_price"), "corroborating_transactions", *r6("low", "high"), "shares", *r6("recorded_notional_usd"), "fill_count", "transaction_count", "first_fill_us", "last_fill_us", "supported"
    )


@query(f"with {fx.SPARSE_SQL} select market_id, bin_us, round(median_price, 6) as median_price from med")
def q_weighted_median(spark, sf_dir):
    at = _fills(spark, sf_dir).withColumn("bin_us", floor_micros(micros(F.col("timestamp")), fx.B) + F.lit(fx.B))
    return sparse.weighted_median(at, ["market_id", "bin_us"], "price_outcome1", "token_amount").select("market_id", "bin_us", *r6("median_price"))


@query(f"with {fx.REFERENCE_SQL} select market_id, bin_us, h::int as horizon_seconds, round(ref_price, 6) as ref_price, coalesce(ref_supported, false) as ref_supported from ref")
def q_reference_self_join(spark, sf_dir):
    return sparse.references(_sparse(spark, sf_dir), SPARSE).select("market_id", "bin_us", "horizon_seconds", *r6("ref_price"), F.coalesce("ref_supported", F.lit(False)).alias("ref_supported"))


@query(f"with {fx.STEP_SQL} select market_id, bin_us, h::int as horizon_seconds, round(coverage, 6) as coverage from cv")
def q_coverage(spark, sf_dir):
    return sparse.coverage_and_variation(_sparse(spark, sf_dir), SPARSE).select("market_id", "bin_us", "horizon_seconds", *r6("coverage"))


@query(f"with {fx.STEP_SQL} select market_id, bin_us, h::int as horizon_seconds, round(variation, 6) as variation_pp from cv where variation is not null")
def q_supported_variation(spark, sf_dir):
    return sparse.coverage_and_variation(_sparse(spark, sf_dir), SPARSE).where("variation_pp is not null").select("market_id", "bin_us", "horizon_seconds", *r6("variation_pp"))


@query(f"with {fx.BASE_SQL} select market_id, bin_us, h::int as horizon_seconds, round(jump_z, 6) as jump_z, round(logit_z, 6) as logit_z, round(variation_z, 6) as variation_z from zz")
def q_past_baseline(spark, sf_dir):
    return sparse.baselines(sparse.measured(_sparse(spark, sf_dir), SPARSE), SPARSE).select("market_id", "bin_us", "horizon_seconds", *r6("jump_z", "logit_z", "variation_z"))


@query(f"""with {fx.SIGNALS_SQL} select market_id, bin_us, h::int as horizon_seconds, round(change, 6) as change_pp, round(logc, 6) as log_odds_change, ends as endpoints_supported, eligible, js as jump_size, tl as tail, vs as variation_size, candidate, unusual from sg""")
def q_multi_horizon_flags(spark, sf_dir):
    return _diagnostics(spark, sf_dir).select("market_id", "bin_us", "horizon_seconds", *r6("change_pp", "log_odds_change"), "endpoints_supported", "eligible", "jump_size", "tail", "variation_size", "candidate", "unusual")


_ALERT = f"alert_id, market_id, {iso_sql('detected_us')} as detected_at, {iso_sql('start_us')} as window_start, round(price, 6) as price, round(median_price, 6) as median_price, txs::bigint as transaction_count, shares, tier, note as baseline_note, horizons"


def _alert_rows(rows: DataFrame) -> DataFrame:
    """Flat form of alerts: signals dropped, horizons joined."""
    return rows.select("alert_id", "market_id", "detected_at", "window_start", *r6("price", "median_price"), "transaction_count", "shares", "tier", "baseline_note", F.concat_ws(",", F.col("horizons_seconds").cast("array<string>")).alias("horizons"))


@query(f"with {fx.ALERTS_SQL} select {_ALERT} from aa")
def q_alerts_consolidated(spark, sf_dir):
    return _alert_rows(_alerts(spark, sf_dir))


@query(f"with {fx.ALERTS_SQL} select {_ALERT} from aa where detected_us > 1705276800000000 and detected_us <= 1705968000000000 and tier = 'unusual_change' order by detected_us, market_id limit 100")
def q_top100_window(spark, sf_dir):
    return _alert_rows(sparse.top_in_window(_alerts(spark, sf_dir), 1_705_276_800_000_000, 1_705_968_000_000_000, 100, "unusual_change"))


@query(f"""with recursive {fx.ALERTS_SQL}, o as (select *, row_number() over (partition by market_id order by detected_us) as n from aa),
w as (select market_id, n, detected_us, alert_id, start_us, detected_us as first_us from o where n = 1 union all
  select o.market_id, o.n, o.detected_us, o.alert_id, o.start_us, case when o.detected_us - w.detected_us > 14400000000 or o.detected_us - w.first_us > 86400000000 then o.detected_us else w.first_us end from w join o on o.market_id = w.market_id and o.n = w.n + 1)
select 'group-' || arg_min(alert_id, detected_us) as group_id, market_id, {iso_sql('first_us')} as first_detection, {iso_sql('max(detected_us)')} as last_detection, {iso_sql('min(start_us)')} as window_start, string_agg(alert_id, ',' order by detected_us) as alert_ids
from w group by market_id, first_us""")
def q_bounded_groups(spark, sf_dir):
    out = sparse.bounded_groups(_alerts(spark, sf_dir), SPARSE)
    return out.select("group_id", "market_id", "first_detection", "last_detection", "window_start", F.concat_ws(",", "alert_ids").alias("alert_ids"))


@query(f"""with {fx.ALERTS_SQL}, b as (select market_id, (max(bin_us) - min(bin_us)) // {fx.B} + 1 as slots, count(*) as n, sum(supported::int) as s from bars group by 1), e as (select market_id, sum(eligible::int) as e from sg group by 1),
a as (select market_id, count(*) as n, sum((tier = 'unusual_change')::int) as u from aa group by 1)
select b.market_id, slots::bigint as slots, (slots - b.n)::bigint as empty_bins, b.n::bigint as observed_bins, s::bigint as supported_bins, coalesce(e, 0)::bigint as eligible_windows, coalesce(a.n, 0)::bigint as alerts, coalesce(u, 0)::bigint as unusual_alerts from b left join e using (market_id) left join a using (market_id)""")
def q_market_summary(spark, sf_dir):
    bars, found = _sparse(spark, sf_dir), _diagnostics(spark, sf_dir)
    return sparse.market_summary(bars, found, sparse.alerts(found, SPARSE), SPARSE)


@query(f"""with {fx.SPARSE_SQL}, n as (select *, lead(bin_us) over (partition by market_id order by bin_us) as nx from bars)
select market_id, bin_us as us, round(median_price, 6) as value from n union all select market_id, bin_us + {fx.B}, null from n where nx - bin_us > {fx.B}""")
def q_gap_line(spark, sf_dir):
    return sparse.gap_line(_sparse(spark, sf_dir), fx.B, "median_price").select("market_id", "us", *r6("value"))


@query(f"""with {fx.SPARSE_SQL}, n as (select *, lead(bin_us) over (partition by market_id order by bin_us) as nx from bars),
l as (select market_id, bin_us as us, median_price as value from n union all select market_id, bin_us + {fx.B}, null from n where nx - bin_us > {fx.B}),
e as (select market_id, min(us) as low, max(us) as high from l group by 1),
c as (select l.*, floor((us - low) * 40.0::double / (high - low + 1)) as col from l join e using (market_id)),
r as (select *, row_number() over (partition by market_id, col, value is null order by us) as r1, row_number() over (partition by market_id, col, value is null order by us desc) as r2,
row_number() over (partition by market_id, col, value is null order by value, us) as r3, row_number() over (partition by market_id, col, value is null order by value desc, us) as r4 from c)
select market_id, us, round(value, 6) as value from r where r1 = 1 or value is not null and (r2 = 1 or r3 = 1 or r4 = 1)""")
def q_line_columns(spark, sf_dir):
    line = sparse.gap_line(_sparse(spark, sf_dir), fx.B, "median_price")
    return charts.line_columns(line, 40).select("market_id", "us", *r6("value"))


# Decisions and context

_BUNDLES = f"""{fx.FL}, bu as (select transaction_hash, market_id, lower(taker) as taker, nonusdc_side, taker_direction, min(us) as us, sum(token_amount) as shares, sum(usd_amount) as usd, count(*) as n, sum(price * token_amount) / sum(token_amount) as xp, sum(p1 * token_amount) / sum(token_amount) as xp1 from g group by all),
bd as (select *, substr(sha256(transaction_hash || '|' || market_id || '|' || taker || '|' || nonusdc_side || '|' || taker_direction), 1, 24) as decision_id, case when nonusdc_side = 'token1' then taker_direction when taker_direction = 'BUY' then 'SELL' else 'BUY' end as d1 from bu)"""


@query(f"""with {_BUNDLES} select decision_id, market_id, taker, us, shares, round(usd, 6) as recorded_notional_usd, n::bigint as fill_count, round(xp, 6) as execution_price, round(xp1, 6) as outcome1_equivalent_price, d1 as direction_outcome1 from bd""")
def q_decision_bundles(spark, sf_dir):
    out = decisions.bundles(fills.valid_fills(fx.order_fills(spark, sf_dir)))
    return out.select("decision_id", "market_id", "taker", "us", "shares", *r6("recorded_notional_usd"), "fill_count", *r6("execution_price", "outcome1_equivalent_price"), "direction_outcome1")


@query(f"with {fx.FL} select maker as transaction_hash, count(distinct us)::bigint as n_times from fl group by 1 having count(distinct us) > 1")
def q_tx_conflicts(spark, sf_dir):
    """Here makers stand for transactions, so that there are conflicts."""
    return decisions.transaction_conflicts(fx.order_fills(spark, sf_dir).withColumn("transaction_hash", F.col("maker")))


_EVENT_BUNDLES = f"{fx.MOVES_SQL}, q as (select event_id, transaction_hash, market_id, taker, us, usd_amount from f)"


def _event_bundles(spark, sf_dir):
    return decisions.bundles(_fills(spark, sf_dir))


@query(f"""with {_EVENT_BUNDLES}, o as (select * from mv where observed),
j as (select q.*, o.bin_us, o.price, o.disp, o.rv, o.n, (q.us - o.bin_us) / 1e6::double as age from q asof left join o on q.market_id = o.market_id and q.us > o.bin_us)
select transaction_hash, coalesce(bin_us, -1) as last_bar_us, round(age, 6) as price_age_seconds, not coalesce(age <= 3600, false) as stale_or_missing, case when age <= 3600 then round(price, 6) end as price_outcome1,
case when age <= 3600 then round(disp, 6) end as displacement_pp, case when age <= 3600 then round(rv, 6) end as rv_pp, case when age <= 3600 then n::bigint else -1 end as prior_bar_record_count from j""")
def q_asof_market_state(spark, sf_dir):
    out = decisions.market_state(_event_bundles(spark, sf_dir), _scored(spark, sf_dir), CONTEXT)
    s = out.select("transaction_hash", "market_state.*")
    at = micros(aware_time(F.col("last_observed_bar_end")))
    none = F.lit(-1)
    return s.select("transaction_hash", F.coalesce(at, none).alias("last_bar_us"), *r6("price_age_seconds"), "stale_or_missing", *r6("price_outcome1", "displacement_pp", "rv_pp"), F.coalesce("prior_bar_record_count", none).alias("prior_bar_record_count"))


@query(f"""with {_BUNDLES} select decision_id, count(*) over w::bigint as observed_prior_bundles, round(coalesce(sum(usd) over w, 0), 6) as recorded_prior_notional_usd from bd window w as (partition by taker order by us range between unbounded preceding and 1 preceding)""".replace("count(*) over w::bigint", "(count(*) over w)::bigint"))
def q_actor_history(spark, sf_dir):
    out = decisions.actor_history(decisions.bundles(fills.valid_fills(fx.order_fills(spark, sf_dir))))
    return out.select("decision_id", "observed_prior_bundles", *r6("recorded_prior_notional_usd"))


@query(f"with {fx.DOCS_SQL} select document_id, market_id, round(relevance, 6) as relevance from rel")
def q_doc_relevance(spark, sf_dir):
    docs = fx.news_documents(spark, sf_dir)
    return relevant_pairs(docs, news.headline(docs), MARKETS).select("document_id", "market_id", *r6("relevance"))


_CONTEXT = """{docs}, it as (select market_id, document_id, url, t_us from rel where relevance = 1 and {gate}),
jn as (select q.transaction_hash, it.* from q join it on q.market_id = it.market_id and it.t_us < q.us and it.t_us >= q.us - 21600000000),
u1 as (select * from jn qualify row_number() over (partition by transaction_hash, url order by t_us desc, document_id desc) = 1),
u2 as (select * from u1 qualify row_number() over (partition by transaction_hash order by t_us desc, document_id desc) <= 3)
select transaction_hash, count(*)::bigint as items, string_agg(document_id, ',' order by t_us desc, document_id desc) as document_ids from u2 group by 1"""


def _news_query(spark, sf_dir, strict: bool) -> DataFrame:
    items = decisions.news_items(fx.news_documents(spark, sf_dir), MARKETS, strict)
    out = decisions.listed_before(_event_bundles(spark, sf_dir), items, CONTEXT)
    return out.where(F.size("news") > 0).select("transaction_hash", F.size("news").cast("long").alias("items"), F.concat_ws(",", "news.document_id").alias("document_ids"))


@query("with " + fx.FE + ", q as (select transaction_hash, market_id, us from f), " + _CONTEXT.format(docs=fx.DOCS_SQL, gate="dated"))
def q_context_asof(spark, sf_dir):
    return _news_query(spark, sf_dir, False)


@query("with " + fx.FE + ", q as (select transaction_hash, market_id, us from f), " + _CONTEXT.format(docs=fx.DOCS_SQL, gate="dated and verified and doc_id % 2 = 0 and text <> ''"))
def q_context_verified(spark, sf_dir):
    return _news_query(spark, sf_dir, True)


@query(f"with {fx.DOCS_SQL} select document_id, url, {iso_sql('t_us')} as available_at from rel where market_id = 'click' and relevance = 1 and dated and verified and text <> '' and t_us < 1705276800000000")
def q_context_before_cutoff(spark, sf_dir):
    return news.context_asof(fx.news_documents(spark, sf_dir), MARKETS[0], 1_705_276_800_000_000).drop("text")


_MATCH = f"""{fx.EPISODES_SQL}, {fx.DOCS_SQL}, c0 as (select e.episode_id, e.market_id, e.start_us, e.end_us, e.detected_us, r.document_id, r.url, case when dated then t_us end as t, dated and verified and text <> '' as checked
  from ee e join rel r on r.market_id = e.market_id and relevance = 1 and (not dated or (t_us >= start_us - 86400000000 and t_us <= end_us + 7200000000))),
c1 as (select *, case when t is null then 'unknown_time' when t < start_us then 'pre_window' when t <= end_us then 'within_window_timing_ambiguous' else 'after_window' end as temporal_role from c0),
c2 as (select *, 1.0::double + case temporal_role when 'pre_window' then 2.0 when 'within_window_timing_ambiguous' then 1.0 else 0.0 end::double + case when checked then 0.5 else 0.0 end::double as rank_score from c1),
lk as (select * from c2 qualify row_number() over (partition by episode_id, url order by rank_score desc, document_id) = 1)"""


@query(f"with {_MATCH} select episode_id, market_id, document_id, temporal_role, checked as timestamp_verified, round(rank_score, 6) as rank_score from lk")
def q_match_candidates(spark, sf_dir):
    return _links(spark, sf_dir).select("episode_id", "market_id", "document_id", "temporal_role", "timestamp_verified", *r6("rank_score"))


@query(f"""with {_MATCH}, lb as (select doc_id::varchar as document_id, case when toxic = 1 then 'rejected' when quality = 1 then 'plausible_context' else 'background' end as label from labels)
select episode_id, document_id, coalesce(label, 'unreviewed') as review_label from lk left join lb using (document_id)""")
def q_review_labels(spark, sf_dir):
    links = _links(spark, sf_dir).drop("review_label", "review_note")
    label = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "plausible_context").otherwise("background")
    rated = fx.read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("document_id"), label.alias("label"))
    reviews = links.select("episode_id", "document_id").join(rated, "document_id")
    return news.review(links, reviews).select("episode_id", "document_id", "review_label")


def _esc(text: str) -> str:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        text = f"replace({text}, '{sign}', '{entity}')"
    return text


@query(f"""with {_MATCH}, pl as (select *, row_number() over (partition by episode_id order by rank_score desc, document_id) as place, count(*) over (partition by episode_id) as n from lk),
en as (select episode_id, any_value(n) as n, string_agg('<li><a href="' || {_esc('url')} || '">' || {_esc('text')} || '</a> <small>' || {_esc(f"temporal_role || ', unreviewed, published ' || coalesce({iso_sql('t')}, 'unknown')")} || '</small></li>', '' order by place) as items
  from pl join dc using (document_id, url) where place <= 10 group by 1)
select market_id, episode_id, coalesce(n, 0)::bigint as candidates, '<details id="episode-' || episode_id || '"><summary>' || {iso_sql('detected_us')} || ' | ' || kind || ' | ' || case when d0 > 0 then 'rise' else 'fall or still' end || ' | ' || coalesce(n, 0) || ' candidates</summary><p>'
  || {iso_sql('start_us')} || ' to ' || {iso_sql('end_us')} || '</p>' || coalesce('<ol>' || items || '</ol>', '<p>No candidate found; that is no proof of absence.</p>') || '</details>' as html from ee left join en using (episode_id)""")
def q_episode_cards(spark, sf_dir):
    return news.episode_cards(_episodes(spark, sf_dir), _links(spark, sf_dir)).drop("detected_us")


@query(f"with {_MATCH} select episode_id, document_id, 'unreviewed' as label, '' as note from lk")
def q_review_template(spark, sf_dir):
    return news.review_template(_links(spark, sf_dir))


@query(f"with {_MATCH} select episode_id, market_id from ee where episode_id not in (select episode_id from lk)")
def q_unattributed(spark, sf_dir):
    found = _episodes(spark, sf_dir)
    return news.unattributed(found, news.match_candidates(found, fx.news_documents(spark, sf_dir), MARKETS, NEWS)).select("episode_id", "market_id")


_ALERT_TAIL = fx.ALERTS_SQL[len(fx.FE) + 2 :].replace("bars as", "sbars as").replace("from bars", "from sbars").replace("join bars", "join sbars")


@query(f"""with {_MATCH}, {_ALERT_TAIL},
k as (select a.alert_id, a.market_id, a.detected_us, a.start_us as a_start, lk.document_id, lk.episode_id, lk.t, row_number() over (partition by a.alert_id, lk.document_id order by ee.detected_us, ee.episode_id) as n
  from aa a join ee on ee.market_id = a.market_id and a.detected_us between ee.start_us and ee.end_us join lk on lk.episode_id = ee.episode_id)
select alert_id, market_id, document_id, episode_id as legacy_episode_id, case when t is null then 'unknown_ordering_date_only' when t < a_start then 'before_window_claim_only' when t >= detected_us then 'after_detection' else 'within_window_ambiguous' end as temporal_role from k where n = 1""")
def q_interval_context(spark, sf_dir):
    found = _episodes(spark, sf_dir)
    links = news.match_candidates(found, fx.news_documents(spark, sf_dir), MARKETS, NEWS)
    return news.known_context(_alerts(spark, sf_dir), found, links).select("alert_id", "market_id", "document_id", "legacy_episode_id", "temporal_role")


_MARKET_QUERIES = ", ".join(f"('{m.market_id}', {n}, '{q}')" for m in MARKETS for n, q in enumerate(m.search_queries))


_PLACES = f"with {fx.EPISODES_SQL} select episode_id, row_number() over (partition by market_id order by score desc, episode_id) as place from ee"


@query(f"""with {fx.DENSE_SQL}, qs(market_id, q, query) as (values {_MARKET_QUERIES}), sp as (select market_id, min(bin_us) - min(bin_us) % 86400000000 - 86400000000 as a, max(bin_us) - max(bin_us) % 86400000000 + 86400000000 as z from bars group by 1),
st as (select market_id, z, unnest(range(a, z, 604800000000)) as start_us from sp), e as (select *, least(start_us + 604800000000, z) as end_us from st)
select market_id, query, start_us, end_us, strftime(make_timestamp(start_us), '%Y-%m-%d') as start_date, strftime(make_timestamp(end_us), '%Y-%m-%d') as end_date from e join qs using (market_id) where q = 0""")
def q_calendar_jobs(spark, sf_dir):
    return news.calendar_jobs(_dense(spark, sf_dir), MARKETS, NEWS).select("market_id", "query", "start_us", "end_us", "start_date", "end_date")


@query(f"""with {fx.EPISODES_SQL}, qs(market_id, q, query) as (values {_MARKET_QUERIES}), t as (select * from ee qualify row_number() over (partition by market_id order by score desc, episode_id) <= 3)
select market_id, episode_id, query, start_us - 86400000000 as start_us, end_us + 7200000000 as end_us, strftime(make_timestamp(start_us - 172800000000), '%Y-%m-%d') as start_date, strftime(make_timestamp(end_us + 93600000000), '%Y-%m-%d') as end_date from t join qs using (market_id) where q < 2""")
def q_spike_jobs(spark, sf_dir):
    return news.spike_jobs(_episodes(spark, sf_dir), MARKETS, NEWS).select("market_id", "episode_id", "query", "start_us", "end_us", "start_date", "end_date")


@query("with ca as (" + ORACLES["q_calendar_jobs"] + "), sp as (" + ORACLES["q_spike_jobs"] + f"""), qs(market_id, q, query) as (values {_MARKET_QUERIES}), pl as ({_PLACES}),
j as (select market_id, null as episode_id, 'calendar' as discovery_mode, query, start_us, end_us, start_date, end_date, row_number() over (partition by market_id order by start_us) - 1 as turn, 0 as stream from ca
union all select sp.market_id, sp.episode_id, 'spike', sp.query, start_us, end_us, start_date, end_date, row_number() over (partition by sp.market_id order by place, q) - 1, 1 from sp join pl using (episode_id) join qs on qs.market_id = sp.market_id and qs.query = sp.query)
select market_id, episode_id, discovery_mode, query, start_us, end_us, start_date, end_date, turn::integer as turn, stream::integer as stream from j order by turn, market_id, stream""")
def q_job_queue(spark, sf_dir):
    """Calendar and spike jobs of all markets in round-robin order; turn and stream give the order."""
    found = _episodes(spark, sf_dir)
    return news.interleaved([news.calendar_jobs(_dense(spark, sf_dir), MARKETS, NEWS), news.spike_jobs(found, MARKETS, NEWS)])


_ALERT_GROUPS = ORACLES["q_bounded_groups"]


@query(f"""with g as ({_ALERT_GROUPS}), qs(market_id, q, query) as (values {_MARKET_QUERIES})
select group_id, market_id, query, epoch_us(first_start) - 1800000000 as start_us, epoch_us(last_at) + 600000000 as end_us
from (select group_id, market_id, window_start::timestamptz as first_start, last_detection::timestamptz as last_at from g) join qs using (market_id)""")
def q_fine_jobs(spark, sf_dir):
    return news.fine_jobs(sparse.bounded_groups(_alerts(spark, sf_dir), SPARSE), MARKETS)


@query(f"""with {_MATCH}, s as (select lk.*, document_id::bigint % 5 = 0 as report from lk where t is not null)
select episode_id, document_id, case when report then 'aftermath_report_not_pre_move_evidence' else temporal_role end as temporal_role, round(case when report then 0.5 else rank_score end, 6)::double as rank_score,
  case when report then 'retrospective_match_report' else 'candidate' end as context_type from s
union all select episode_id, document_id, case when document_id::bigint % 5 = 0 then 'aftermath_report_not_pre_move_evidence' else 'date_only_timing_ambiguous' end, case when document_id::bigint % 5 = 0 then 0.5 else 1.0 end::double,
  case when document_id::bigint % 5 = 0 then 'retrospective_match_report' else 'candidate' end from lk where t is null and document_id::bigint % 2 = 0""")
def q_match_seed(spark, sf_dir):
    """Supplied documents: even undated ones list all episodes, odd ones none."""
    links = _links(spark, sf_dir).drop("review_label", "review_note")
    n = F.col("document_id").cast("long")
    listed = links.where((n % 2 == 0) & F.col("published_at_claimed").isNull()).groupBy("document_id").agg(F.array_sort(F.collect_set("episode_id")).alias("candidate_episode_ids"))
    docs = fx.news_documents(spark, sf_dir).select("document_id", F.when(n % 5 == 0, "retrospective_match_report").alias("context_type"), F.lit(None).cast("string").alias("publication_date_claimed"), F.lit("note").alias("timing_evidence"), F.lit("event").alias("information_event_id"))
    return news.match_seed(links, docs.join(listed, "document_id", "left")).select("episode_id", "document_id", "temporal_role", *r6("rank_score"), "context_type")


@query(f"""with {_MATCH}, d as (select 'm' || doc_id % 4 as market_id, count(*) as documents from documents group by 1), l as (select market_id, count(*) as links, count(distinct episode_id) as linked_episodes from lk group by 1)
select market_id, coalesce(documents, 0)::bigint as documents, coalesce(links, 0)::bigint as links, coalesce(linked_episodes, 0)::bigint as linked_episodes from d full join l using (market_id)""")
def q_link_coverage(spark, sf_dir):
    return news.link_coverage(fx.news_documents(spark, sf_dir), _links(spark, sf_dir))


@query("""with r as (select doc_id, unnest([doc_id % 977, doc_id % 151]) as request_id from documents), h as (select distinct doc_id, c_mktsegment, c_nationkey from r join customer on c_custkey = request_id)
select d.doc_id::varchar as document_id, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as discovery_modes, string_agg(distinct c_nationkey::varchar, ',' order by c_nationkey::varchar) as market_ids from documents d left join h using (doc_id) group by 1""")
def q_attach_requests(spark, sf_dir):
    statuses = fx.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("request_id"), F.col("c_mktsegment").alias("discovery_mode"), F.col("c_nationkey").cast("string").alias("market_id"))
    docs = fx.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.array((F.col("doc_id") % 977).cast("string"), (F.col("doc_id") % 151).cast("string")).alias("retrieval_request_ids"))
    found = news.attach_requests(docs, statuses)
    return found.select("document_id", *[F.when(F.col(c).isNotNull(), F.concat_ws(",", c)).alias(c) for c in ("discovery_modes", "market_ids")])


@query("select o_orderkey::varchar as decision_id, o_custkey::varchar as split_group, o_orderstatus as direction, o_orderpriority as candidate, 'known' as news_status, false as training_eligible from orders")
def q_join_candidates(spark, sf_dir):
    """Orders as decisions, their priorities as research candidates, exported apart and joined one to one."""
    orders = fx.read(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string").alias("decision_id")
    c = F.struct(F.array("o_orderstatus").alias("news"), F.lit("known").alias("news_status"))
    strict = orders.select(key, F.col("o_custkey").cast("string").alias("split_group"), F.struct(F.col("o_orderstatus").alias("direction")).alias("D"), c.alias("C"), F.array(F.lit("left out")).alias("research_candidates"))
    found = decisions.join_candidates(strict, orders.select(key, F.array("o_orderpriority").alias("research_candidates")))
    return found.select("decision_id", "split_group", "D.direction", F.col("C_candidate.news_candidates")[0].alias("candidate"), "C_candidate.news_status", "training_eligible")


@query("select o_orderpriority as market_id, count(*)::bigint as decision_rows, count(*) filter (o_orderstatus = 'F')::bigint as rows_with_news, count(*) filter (o_totalprice > 100000)::bigint as rows_with_candidates from orders group by 1")
def q_export_stats(spark, sf_dir):
    none = F.array().cast("array<string>")
    d, c = F.struct(F.col("o_orderpriority").alias("market_id")).alias("D"), F.struct(F.when(F.col("o_orderstatus") == "F", F.array("o_orderstatus")).otherwise(none).alias("news")).alias("C")
    return decisions.export_stats(fx.read(spark, sf_dir, "orders").select(d, c, F.when(F.col("o_totalprice") > 100000, F.array("o_orderpriority")).otherwise(none).alias("research_candidates")))


@query("select event_type as source_url, json_extract_string(props, '$.k') as error, count(*)::bigint as count from events group by 1, 2")
def q_error_counts(spark, sf_dir):
    """Users' events as cycles, each with the list of its errors."""
    one = F.struct(F.col("event_type").alias("surface"), F.get_json_object("props", "$.k").alias("error"))
    return capture.error_counts(fx.read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(one).alias("errors")))


# Documents and captures


@query("""with p as (select page_id, url, regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(\\?([^#]*))?', ['scheme', 'host', 'path', 'q', 'query']) as u from pages),
k as (select page_id, u, array_to_string(list_filter(list_filter(string_split(u.query, '&'), lambda x: x <> ''), lambda x: not starts_with(lower(x), 'utm_') and not regexp_matches(lower(x), '^(fbclid|gclid)(=|$)')), '&') as kept from p)
select page_id, u.scheme || '://' || lower(u.host) || u.path || case when kept <> '' then '?' || kept else '' end as canonical_url from k""")
def q_canonical_url(spark, sf_dir):
    return fx.read(spark, sf_dir, "pages").select("page_id", canonical_url("url").alias("canonical_url"))


def _records(spark, sf_dir) -> DataFrame:
    """documents as captured records: the source is the URL, texts are versions, later copies of a text are duplicates."""
    docs = fx.read(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("doc_id") * 7919, F.lit(100003)))
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("https://"), "source").alias("source_url"), F.lit("For release").alias("source_release_claim"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), iso(at).alias("usable_at"), F.col("lang").alias("information_event_id"))


_RECORDS = """r as (select doc_id::varchar as document_id, 'https://' || source as source_url, sha256(coalesce(text, '')) as text_sha256, 1704067200000000 + (doc_id * 7919) % 100003 * 1000000 as us, lang as information_event_id from documents),
v as (select *, sha256('["' || source_url || '","For release","' || text_sha256 || '"]') as k from r)"""


@query(f"""with {_RECORDS} select document_id, k as content_version_id, first_value(document_id) over w as canonical_document_id, {iso_sql('us')} as record_usable_at, {iso_sql('first_value(us) over w')} as canonical_usable_at from v window w as (partition by k order by us, document_id)""")
def q_canonical_versions(spark, sf_dir):
    return capture.canonical_records(_records(spark, sf_dir))[1]


@query(f"""with {_RECORDS} select information_event_id as event_id, count(*)::bigint as saved_records, count(distinct text_sha256)::bigint as distinct_extracted_texts, {iso_sql('min(us)')} as first_usable_at, string_agg(distinct source_url, ',' order by source_url) as source_urls from v group by 1""")
def q_audit_events(spark, sf_dir):
    return capture.event_audit(_records(spark, sf_dir)).withColumn("source_urls", F.concat_ws(",", "source_urls"))


@query(f"with {_RECORDS} select count(distinct k)::bigint as documents, count(*)::bigint as information_records, (count(*) - count(distinct k))::bigint as duplicate_information_records, count(distinct information_event_id)::bigint as distinct_information_events from v")
def q_index_counts(spark, sf_dir):
    return capture.index_counts(_records(spark, sf_dir))


@query("select event_type as status, count(*)::bigint as n from events group by 1")
def q_status_histogram(spark, sf_dir):
    return capture.status_histogram(fx.read(spark, sf_dir, "events").select(F.col("event_type").alias("status")))


@query("""select (doc_id % 50)::varchar as document_id, min(source) as source, string_agg(distinct lang, ',' order by lang) as discovery_modes, string_agg(distinct source, ',' order by source) as market_ids from documents group by 1""")
def q_doc_set_merge(spark, sf_dir):
    docs = fx.read(spark, sf_dir, "documents").select((F.col("doc_id") % 50).cast("string").alias("document_id"), "source", F.array("lang").alias("discovery_modes"), F.array("source").alias("market_ids"))
    return news.merged_sets(docs).select("document_id", "source", F.concat_ws(",", "discovery_modes").alias("discovery_modes"), F.concat_ws(",", "market_ids").alias("market_ids"))


@query("""select doc_id::varchar as document_id, case when doc_id % 3 <> 0 then 'old' else 'new' end as origin, case doc_id % 3 when 2 then 'a,b' when 1 then 'a' else 'b' end as discovery_modes from documents""")
def q_doc_upsert(spark, sf_dir):
    """Two sides that together hold every document and share a third."""
    docs = fx.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "doc_id")
    old = docs.where("doc_id % 3 <> 0").select("document_id", F.lit("old").alias("origin"), F.array(F.lit("a")).alias("discovery_modes"))
    new = docs.where("doc_id % 3 <> 1").select("document_id", F.lit("new").alias("origin"), F.array(F.lit("b")).alias("discovery_modes"))
    return news.upsert(old, new).select("document_id", "origin", F.concat_ws(",", "discovery_modes").alias("discovery_modes"))


@query(None)
def q_html_paragraphs(spark, sf_dir):
    found = fx.read(spark, sf_dir, "pages").withColumn("p", paragraphs("html"))
    return found.select("page_id", F.size("p").cast("long").alias("n_paragraphs"), F.sha2(F.concat_ws("\n", "p"), 256).alias("text_sha256"))


@query("select coalesce(source, '<none>') || '|' || coalesce(lang, '<none>') as key, doc_id, (doc_id * 7919) % 100003 as arrival from documents qualify row_number() over (partition by source, lang order by (doc_id * 7919) % 100003, doc_id) = 1")
def q_stream_canonical(spark, sf_dir):
    """First arrival of each source and language through keyed streaming state; its SQL is the batch form."""
    from tidemark.streaming.capture import collected, first_versions

    schema = fx.read(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")
    rows = stream.select(F.concat_ws("|", *[F.coalesce(c, F.lit("<none>")) for c in ("source", "lang")]).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.col("doc_id") * 7919, F.lit(100003)).alias("arrival"))
    return collected(first_versions(rows, "key", ("arrival", "doc_id")), "stream_canonical")


@query(f"""with {_RECORDS} select document_id, {iso_sql('us')} as usable_at from v where source_url <> 'https://web' and us < 1704067200000000 + 50000000000""")
def q_eligible_before(spark, sf_dir):
    """Records of one source break a rule; the others count if they were usable strictly before the cut-off."""
    broken = F.when(F.col("source_url") == "https://web", F.array(F.lit("source"))).otherwise(F.array().cast("array<string>"))
    return capture.eligible_before(_records(spark, sf_dir).withColumn("errors", broken), "2024-01-01T13:53:20+00:00").select("document_id", "usable_at")
