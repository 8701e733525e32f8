"""The benchmark tables seen as fills and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import ContextConfig, DenseConfig, Market, NewsConfig, SparseConfig
from tidemark.session import ship

DENSE = DenseConfig(bin_minutes=60, horizon_minutes=180, baseline_hours=120, min_baseline_bins=24, z_threshold=1.5, merge_minutes=120)
SPARSE = SparseConfig(
    bin_seconds=14400, horizons_seconds=(14400, 28800, 86400), corroboration_pp=10.0, baseline_hours=240, min_baseline_samples=20, z_threshold=1.5, news_merge_seconds=14400, news_max_span_seconds=86400
)
NEWS = NewsConfig(calendar_window_days=7, max_episodes_per_market=3)
CONTEXT = ContextConfig(news_lookback_hours=6, max_news_items=3, max_price_age_minutes=60)
#: Markets are event types; terms are frequent words of the documents' languages.
MARKETS = (
    Market("click", "click?", search_queries=("click one", "click two"), required_term_groups=(("the", "der"), ("and", "und"))),
    Market("view", "view?", search_queries=("view one",), required_term_groups=(("les", "que"),)),
    Market("error", "error?", search_queries=("error one", "error two"), required_term_groups=(("und",),)),
    Market("purchase", "purchase?", search_queries=("purchase one",), required_term_groups=(("of",), ("by", "with"))),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _utc(name: str):
    return F.col(name).cast("timestamp")  # zone-less in the files; the session zone is UTC


def event_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.round(F.col("value") / (F.col("value") + 50), 6)
    shares = F.get_json_object("props", "$.k").cast("double") + 1
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("market_id"), _utc("ts").alias("timestamp"), price.alias("price"), shares.alias("token_amount"), (price * shares).alias("usd_amount"),
        F.when(F.col("user_id") % 2 == 0, "token1").otherwise("token2").alias("nonusdc_side"), F.concat(F.lit("tx"), "event_id").alias("transaction_hash"), F.lit(0).cast("long").alias("log_index"),
        F.concat(F.lit("u"), "user_id").alias("taker"), F.concat(F.lit("m"), F.col("event_id") % 20).alias("maker"), F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("taker_direction"), "event_id",
    )


def messy_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_fills with textual times: every 97th naive (invalid), every 89th in epoch seconds, the others ISO with an offset; every 83rd amount is 'x'."""
    fills = event_fills(spark, sf_dir)
    t = F.col("timestamp")
    text = F.when(F.col("event_id") % 97 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(F.col("event_id") % 89 == 0, (F.unix_micros(t).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("string"))
    return fills.withColumn("timestamp", F.coalesce(text, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))).withColumn("token_amount", F.when(F.col("event_id") % 83 == 0, "x").otherwise(F.col("token_amount").cast("string")))


def order_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its orders; log identities repeat, also with conflicts."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    price = F.round(F.col("l_discount") * 10, 2)
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("market_id"), _utc("o_orderdate").alias("timestamp"), price.alias("price"), F.col("l_quantity").alias("token_amount"), (price * F.col("l_quantity")).alias("usd_amount"),
        F.when(F.col("l_linestatus") == "O", "token1").otherwise("token2").alias("nonusdc_side"), F.concat(F.lit("o"), "l_orderkey").alias("transaction_hash"), F.col("l_linenumber").cast("long").alias("log_index"),
        F.concat(F.lit("c"), "o_custkey").alias("taker"), F.concat(F.lit("s"), "l_suppkey").alias("maker"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("taker_direction"),
    )


def news_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with claimed times every 2,617 seconds (every 13th without), verified ones among them, and discovery modes."""
    docs = read(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 2617)
    claimed = F.when(F.col("doc_id") % 13 != 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    checked = F.col("doc_id") % 3 == 0
    return docs.select(
        F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("https://Example.org/n/"), F.col("doc_id") % 400, F.lit("?utm_source=x&id="), F.col("doc_id") % 400).alias("url"), F.col("text").alias("title"), F.lit("").alias("snippet"), "source",
        claimed.alias("published_at_claimed"), F.when(checked, "verified").otherwise("claimed").alias("timestamp_status"), F.when(checked, claimed).alias("verified_available_at"), F.when(checked, F.lit("page")).otherwise("").alias("verification_evidence"),
        F.when(checked, F.col("text")).otherwise("").alias("verified_text"), F.array(F.when(F.col("doc_id") % 2 == 0, "calendar").otherwise("spike")).alias("discovery_modes"), F.array(F.concat(F.lit("m"), F.col("doc_id") % 4)).alias("market_ids"),
    )


FE = """fe as (select event_type as market_id, epoch_us(ts) as us, round(value / (value + 50), 6) as price, cast(json_extract_string(props, '$.k') as double) + 1 as token_amount,
  user_id, event_id, 'tx' || event_id as transaction_hash, 'u' || user_id as taker, case when event_id % 2 = 0 then 'BUY' else 'SELL' end as taker_direction, case when user_id % 2 = 0 then 'token1' else 'token2' end as nonusdc_side from events),
f as (select *, case when nonusdc_side = 'token2' then 1 - price else price end as p1, price * token_amount as usd_amount from fe)"""

FL = """fl as (select 's' || (l_suppkey % 5) as market_id, epoch_us(o_orderdate) as us, round(l_discount * 10, 2) as price, l_quantity as token_amount, round(l_discount * 10, 2) * l_quantity as usd_amount,
  case when l_linestatus = 'O' then 'token1' else 'token2' end as nonusdc_side, 'o' || l_orderkey as transaction_hash, l_linenumber::bigint as log_index, 'c' || o_custkey as taker, 's' || l_suppkey as maker,
  case when l_returnflag = 'R' then 'SELL' else 'BUY' end as taker_direction from lineitem join orders on l_orderkey = o_orderkey),
g as (select *, case when nonusdc_side = 'token2' then 1 - price else price end as p1 from fl)"""

DENSE_SQL = f"""{FE},
b0 as (select market_id, us - us % 3600000000 + 3600000000 as bin_us, sum(p1 * token_amount) as w, sum(token_amount) as token_amount, sum(usd_amount) as usd, count(*) as n, min(p1) as low, max(p1) as high from f group by 1, 2),
grid as (select market_id, unnest(range(min(bin_us), max(bin_us) + 1, 3600000000)) as bin_us from b0 group by market_id),
bars as (select market_id, bin_us, w / token_amount as price, coalesce(token_amount, 0) as token_amount, coalesce(usd, 0) as usd, coalesce(n, 0) as n, low, high, n is not null as observed, coalesce(n, 9) < 3 as thin from grid left join b0 using (market_id, bin_us))"""

MOVES_SQL = f"""{DENSE_SQL},
d0 as (select *, price - lag(price) over w as step, price - lag(price, 3) over w as moved, sum(observed::int) over (w rows between 3 preceding and current row) = 4 as complete, sum(thin::int) over (w rows between 3 preceding and current row) as thin_before from bars window w as (partition by market_id order by bin_us)),
mv as (select *, case when complete then moved * 100 end as disp, case when complete then sqrt(sum(step * step * 10000) over (partition by market_id order by bin_us rows between 2 preceding and current row)) end as rv from d0)"""

FLAGS_SQL = f"""{MOVES_SQL},
z0 as (select *, count(abs(disp)) over q as nj, median(abs(disp)) over q as mj, mad(abs(disp)) over q as aj, count(rv) over q as nr, median(rv) over q as mr, mad(rv) over q as ar from mv window q as (partition by market_id order by bin_us rows between 122 preceding and 3 preceding)),
z as (select *, case when nj >= 24 then (abs(disp) - mj) / greatest(1.4826 * aj, 0.5) end as jump_z, case when nr >= 24 then (rv - mr) / greatest(1.4826 * ar, 0.5) end as rv_z from z0),
fl0 as (select *, coalesce(abs(disp) >= 3 and jump_z >= 1.5, false) as jump_alert, coalesce(rv >= 3 and rv_z >= 1.5, false) as vol_alert, greatest(jump_z, rv_z) as score from z)"""

_ISO = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S+00:00')"


def iso_sql(us: str) -> str:
    return _ISO.format(us)


EPISODES_SQL = f"""{FLAGS_SQL},
al as (select *, bin_us - lag(bin_us) over (partition by market_id order by bin_us) as gap from fl0 where jump_alert or vol_alert),
cl as (select *, sum(case when gap is null or gap > 7200000000 then 1 else 0 end) over (partition by market_id order by bin_us) as c from al),
ep as (select market_id, min(bin_us) as first_us, max(bin_us) as last_us, arg_max(struct_pack(t := bin_us, s := score, d := disp, r := rv), struct_pack(s := score, n := -bin_us)) as pk, arg_min(disp, bin_us) as d0, arg_min(price, bin_us) as p0, arg_min(thin_before, bin_us) as th,
  bool_or(jump_alert) as j, bool_or(vol_alert) as v, count(*) as alert_bins from cl group by market_id, c),
ee as (select substr(sha256(market_id || '|' || {iso_sql('first_us')}), 1, 16) as episode_id, market_id, first_us - 14400000000 as start_us, first_us as detected_us, last_us as end_us, pk.t as peak_us, pk.s as score, d0, pk.d as pd, pk.r as pr, p0, th,
  case when j and v then 'jump_and_volatility' when j then 'jump' else 'volatility' end as kind, alert_bins from ep)"""

B = 14_400_000_000
SPARSE_SQL = f"""{FE},
s0 as (select *, us - us % {B} + {B} as bin_us from f),
s1 as (select market_id, bin_us, p1, sum(token_amount) as w from s0 group by all),
s2 as (select *, sum(w) over (partition by market_id, bin_us order by p1) as run, sum(w) over (partition by market_id, bin_us) as tot from s1),
med as (select market_id, bin_us, min(p1) as median_price from s2 where run >= tot / 2 - tot * 1e-12 group by all),
sb as (select market_id, bin_us, sum(p1 * token_amount) / sum(token_amount) as price, any_value(median_price) as median_price, count(distinct case when abs(p1 - median_price) <= 10.0::double / 100 + 1e-12 then transaction_hash end) as corr, min(p1) as low, max(p1) as high,
  sum(token_amount) as shares, sum(usd_amount) as usd, count(*) as fills, count(distinct transaction_hash) as txs, min(us) as first_us, max(us) as last_us from s0 join med using (market_id, bin_us) group by all),
bars as (select *, corr >= 2 and shares >= 5 as supported from sb)"""

_SECONDS = (14400, 28800, 86400)
_H = ", ".join(map(str, _SECONDS))
REFERENCE_SQL = f"""{SPARSE_SQL},
hz as (select unnest([{_H}])::bigint as h),
ref as (select a.*, h, r.median_price as ref_price, r.supported as ref_supported from bars a cross join hz left join bars r on r.market_id = a.market_id and r.bin_us = a.bin_us - h * 1000000)"""

STEP_SQL = f"""{REFERENCE_SQL},
st as (select *, case when bin_us - lag(bin_us) over w = {B} and supported and lag(supported) over w then power((median_price - lag(median_price) over w) * 100, 2) end as step2 from bars window w as (partition by market_id order by bin_us)),
cv as (""" + " union all ".join(
    f"""select market_id, bin_us, {h}::bigint as h, count(*) over (w range between {h * 1000000 + B - 1} preceding and current row) / {h // 14400 + 1}.0::double as coverage,
  case when count(step2) over (w range between {h * 1000000 - 1} preceding and current row) = {h // 14400} then sqrt(sum(step2) over (w range between {h * 1000000 - 1} preceding and current row)) end as variation
  from st window w as (partition by market_id order by bin_us)"""
    for h in _SECONDS
) + ")"

_L = "ln(least(greatest({0}, 0.001::double), 0.999::double) / (1 - least(greatest({0}, 0.001::double), 0.999::double)))"
MEASURED_SQL = f"""{STEP_SQL},
ms as (select ref.*, coverage, variation, (median_price - ref_price) * 100 as change, {_L.format('median_price')} - {_L.format('ref_price')} as logc, supported and coalesce(ref_supported, false) as ends, supported and coalesce(ref_supported, false) and coverage >= 0.6::double - 1e-9 as eligible from ref join cv using (market_id, bin_us, h))"""

DAY10 = 864_000_000_000
BASE_SQL = f"""{MEASURED_SQL},
mm as (select *, case when eligible then abs(change) end as ej, case when eligible then abs(logc) end as el, case when eligible then variation end as ev from ms),
bl as (""" + " union all ".join(
    "select *, " + ", ".join(f"count({c}) over q as n_{c}, quantile_cont({c}, 0.25) over q as q1_{c}, quantile_cont({c}, 0.5) over q as q2_{c}, quantile_cont({c}, 0.75) over q as q3_{c}" for c in ("ej", "el", "ev"))
    + f" from mm where h = {h} window q as (partition by market_id order by bin_us range between {DAY10 + h * 1000000 + B} preceding and {h * 1000000 + B} preceding)"
    for h in _SECONDS
) + """),
zz as (select *, case when n_ej >= 20 then (abs(change) - q2_ej) / greatest((q3_ej - q1_ej) / 1.349, 0.15) end as jump_z, case when n_el >= 20 then (abs(logc) - q2_el) / greatest((q3_el - q1_el) / 1.349, 0.05) end as logit_z,
  case when n_ev >= 20 then (variation - q2_ev) / greatest((q3_ev - q1_ev) / 1.349, 0.15) end as variation_z from bl)"""

SIGNALS_SQL = f"""{BASE_SQL},
g0 as (select *, sqrt(greatest(1.0, h / 60.0::double)) as sc from zz),
g1 as (select *, coalesce(abs(change) >= 1.0 * sc - 1e-9, false) as js, coalesce((median_price <= 0.1 or median_price >= 0.9 or ref_price <= 0.1 or ref_price >= 0.9) and abs(change) >= 0.2::double - 1e-9 and abs(logc) >= 0.35::double * sc - 1e-12, false) as tl, coalesce(variation >= 1.5 * sc - 1e-9, false) as vs from g0),
g2 as (select *, eligible and (js or tl or vs) as candidate from g1),
sg as (select *, candidate and ((js and coalesce(jump_z >= 1.5, false)) or (tl and coalesce(logit_z >= 1.5, false)) or (vs and coalesce(variation_z >= 1.5, false))) as unusual from g2)"""

ALERTS_SQL = f"""{SIGNALS_SQL},
ca as (select market_id, bin_us as detected_us, min(bin_us - h * 1000000 - {B}) as start_us, any_value(price) as price, any_value(median_price) as median_price, any_value(txs) as txs, any_value(shares) as shares,
  case when bool_or(unusual) then 'unusual_change' else 'supported_change' end as tier, case when max((jump_z is not null)::int) = 1 then 'past_only_reference' else 'insufficient_history_size_only' end as note, string_agg(h::varchar, ',' order by h) as horizons, min(h) as shortest from sg where candidate group by all),
aa as (select substr(sha256('fine-v2|{SPARSE.fingerprint}|' || market_id || '|' || {iso_sql('detected_us')}), 1, 20) as alert_id, * from ca)"""

#: Documents as news: word boundaries without look-behind, which the oracle's regular expressions lack.
_HIT = r"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{M}}\p{{N}}_])({0})($|[^\p{{L}}\p{{M}}\p{{N}}_])')"


def relevance_sql(groups: tuple[tuple[str, ...], ...]) -> str:
    return "(" + " + ".join(f"{_HIT.format('|'.join(g))}::int::double" for g in groups) + f") / {len(groups)}"


DOCS_SQL = """dc as (select doc_id::varchar as document_id, doc_id, coalesce(text, '') as text, 1704067200000000 + doc_id * 2617000000 as t_us, doc_id % 13 <> 0 as dated, doc_id % 3 = 0 as verified, 'https://example.org/n/' || (doc_id % 400) || '?id=' || (doc_id % 400) as url from documents),
rel as (""" + " union all ".join(f"select *, '{m.market_id}' as market_id, {relevance_sql(m.required_term_groups)} as relevance from dc" for m in MARKETS) + ")"
