"""Decision bundles and what was known strictly before them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ContextConfig, Market
from tidemark.functions.columns import aware_time, iso, micros, relevant_pairs, require_columns, short_hash
from tidemark.functions.text import canonical_url
from tidemark.operators.chunks import asof_before, earlier_totals, even_cuts
from tidemark.operators.fills import participant_fills

HOUR = 3_600_000_000
KEYS = ("transaction_hash", "market_id", "taker", "nonusdc_side", "taker_direction")
INDEPENDENT = ("calendar", "independent_manual")


def transaction_conflicts(fills: DataFrame) -> DataFrame:
    """Transactions whose fills carry several times."""
    return fills.groupBy("transaction_hash").agg(F.countDistinct("timestamp").alias("n_times")).where("n_times > 1")


def check_decisions(fills: DataFrame) -> None:
    """Errors for missing identities, unknown directions and conflicting times; one pass."""
    require_columns(fills, [*KEYS, "timestamp", "price_observed", "price_outcome1", "token_amount", "usd_amount"])
    blank = lambda c: F.count_if(F.coalesce(F.trim(F.col(c)), F.lit("")) == "")
    unknown = F.count_if(~F.coalesce(F.col("taker_direction").isin("BUY", "SELL"), F.lit(False)))
    each = fills.groupBy("transaction_hash").agg(F.count("*").alias("n"), blank("transaction_hash").alias("tx"), blank("taker").alias("taker"), unknown.alias("direction"), (F.min("timestamp") < F.max("timestamp")).cast("int").alias("conflict"))
    seen = each.agg(*[F.sum(c).alias(c) for c in ("n", "tx", "taker", "direction", "conflict")]).first()
    if not seen["n"]:
        raise ValueError("no participant fills")
    for name, what in (("tx", "transaction_hash is missing"), ("taker", "taker is missing"), ("direction", "taker_direction is unknown")):
        if seen[name]:
            raise ValueError(f"{what} in {seen[name]} rows")
    if seen["conflict"]:
        raise ValueError("a transaction has conflicting timestamps")


def bundles(fills: DataFrame, check: bool = True) -> DataFrame:
    """One row for each taker, transaction, market, token and direction."""
    own = participant_fills(fills)
    if check:
        check_decisions(own)
    amount = F.col("token_amount")
    grouped = own.withColumn("taker", F.lower("taker")).groupBy(*KEYS).agg(
        F.min("timestamp").alias("timestamp"), F.sum(amount).alias("shares"), F.sum("usd_amount").alias("recorded_notional_usd"), F.count("*").alias("fill_count"),
        (F.sum(F.col("price_observed") * amount) / F.sum(amount)).alias("execution_price"), (F.sum(F.col("price_outcome1") * amount) / F.sum(amount)).alias("outcome1_equivalent_price"),
    )
    flipped = F.when(F.col("taker_direction") == "BUY", "SELL").otherwise("BUY")
    return grouped.withColumns({
        "direction_outcome1": F.when(F.col("nonusdc_side") == "token2", flipped).otherwise(F.col("taker_direction")),
        "decision_id": short_hash(24, *[F.col(k) for k in KEYS]), "us": micros(F.col("timestamp")),
    })


def market_state(decisions: DataFrame, bars: DataFrame, cfg: ContextConfig, chunk: int = HOUR, cuts: DataFrame | None = None) -> DataFrame:
    """decisions with the last observed bar that ended strictly before; values only where it is at most max_price_age_minutes old.

    A busy market is dealt out by the hour, and a busy hour by `cuts`; each part costs one carried row.
    """
    known = [c for c in ("price", "displacement_pp", "rv_pp", "record_count") if c in bars.columns]
    found = asof_before(decisions, bars.where("observed").select("market_id", F.col("bin_us").alias("us"), *known), "market_id", "us", known, chunk, cuts)
    age = (F.col("us") - F.col("state_us")) / 1e6
    fresh = F.coalesce(age <= cfg.max_price_age_minutes * 60, F.lit(False))
    names = {"price": "price_outcome1", "displacement_pp": "displacement_pp", "rv_pp": "rv_pp", "record_count": "prior_bar_record_count"}
    state = F.struct(F.when(F.col("state_us").isNotNull(), iso(F.timestamp_micros("state_us"))).alias("last_observed_bar_end"), age.alias("price_age_seconds"), (~fresh).alias("stale_or_missing"), *[F.when(fresh, F.col(f"state_{c}")).alias(names[c]) for c in known])
    return found.withColumn("market_state", state).drop("state_us", *[f"state_{c}" for c in known])


def actor_history(decisions: DataFrame, chunk: int = 24 * HOUR, cuts: DataFrame | None = None) -> DataFrame:
    """decisions with what the same taker did at strictly earlier times, in all markets."""
    return earlier_totals(decisions, "taker", "us", "recorded_notional_usd", chunk, cuts).withColumnsRenamed({"prior_count": "observed_prior_bundles", "prior_amount": "recorded_prior_notional_usd"})


def verified_time(docs: DataFrame):
    """verified_available_at where status, evidence and text back it."""
    for name in ("verified_available_at", "timestamp_status", "verification_evidence", "verified_text"):
        if name not in docs.columns:
            return F.lit(None).cast("timestamp")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return F.when((F.col("timestamp_status") == "verified") & filled("verification_evidence") & filled("verified_text"), aware_time(F.col("verified_available_at")))


def news_items(docs: DataFrame, markets: Sequence[Market], strict: bool) -> DataFrame:
    """(market_id, available_us, document_id, url, text) of fully relevant documents with a usable time."""
    if strict:
        some = docs.where(F.arrays_overlap("discovery_modes", F.array(*[F.lit(m) for m in INDEPENDENT])))
        pairs = relevant_pairs(some, F.col("verified_text"), markets, whole=True)
        time, text = verified_time(docs), F.col("verified_text")
    else:
        pairs = relevant_pairs(docs, F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))), markets, whole=True)
        time, text = aware_time(F.col("published_at_claimed")), F.col("title")
    items = pairs.withColumn("available_us", micros(time)).where("available_us is not null")
    return items.select("market_id", "available_us", "document_id", canonical_url("url").alias("url"), text.alias("text"))


CUT, ITEM = 0, 1
#: A lookback is dealt out in so many chunks; a chunk begins with the newest items of those before it.
CHUNKS_A_LOOKBACK = 12
_LISTS = "market_id string, us long, items array<struct<document_id: string, url: string, available_us: long>>"


class Newest:
    """The newest items, one for each URL, of a stream in time order; never more than `most`.

    An item that `most` newer URLs have pushed out can't come back: they stay newer, and what expires goes from the old end.
    """

    def __init__(self, most: int):
        self.most, self.items = most, []

    def add(self, us: int, document_id: str, url: str) -> None:
        self.items = [x for x in self.items if x[2] != url]
        self.items.append((us, document_id, url))
        del self.items[: -self.most]

    def since(self, us: int) -> list[tuple]:
        return [x for x in reversed(self.items) if x[0] >= us]


def _news_lists(batches, most: int, span: int):
    """A list for each cut-off that has items. Rows come by (market, chunk), time, cut-offs before items of their time."""
    import pyarrow as pa

    fields = pa.struct([("document_id", pa.string()), ("url", pa.string()), ("available_us", pa.int64())])
    place, newest = object(), None
    for batch in batches:
        markets, cuts, offsets, flat = [], [], [0], []
        for market, chunk, us, kind, *item in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (market, chunk) != place:
                place, newest = (market, chunk), Newest(most)
            if kind == ITEM:
                newest.add(us, *item)
                continue
            listed = newest.since(us - span)
            if not listed:
                continue
            flat += listed
            markets.append(market)
            cuts.append(us)
            offsets.append(len(flat))
        columns = [pa.array([x[k] for x in flat], t) for k, t in ((1, pa.string()), (2, pa.string()), (0, pa.int64()))]
        items = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(fields)))
        yield pa.RecordBatch.from_arrays([pa.array(markets, pa.string()), pa.array(cuts, pa.int64()), items], names=["market_id", "us", "items"])


def newest_by_url(items: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """The `most` newest items of each key, one for each URL."""
    newest = [F.desc(c) for c in ("available_us", "document_id", "url", "text") if c in items.columns]
    once = items.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "url").orderBy(*newest))).where("_n = 1")
    return once.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where(F.col("_n") <= most).drop("_n")


def news_events(decisions: DataFrame, items: DataFrame, cfg: ContextConfig) -> DataFrame:
    """(market_id, chunk, us, kind, item): each distinct cut-off and each item once, and in every chunk the newest items of each of the chunks that its lookback reaches. Items come without their texts."""
    chunk = -(-cfg.news_lookback_hours * HOUR // CHUNKS_A_LOOKBACK)
    place = lambda name: F.floor(F.col(name) / F.lit(chunk)).alias("chunk")
    known = items.select("market_id", place("available_us"), "available_us", *[F.col(c).cast("string").alias(c) for c in ("document_id", "url")])
    nothing = [F.lit(None).cast("string").alias(c) for c in ("document_id", "url")]
    # Null cut-offs get no list. Without these filters Spark adds them to some uses of decisions only, and then computes and shuffles them again for the others.
    at = decisions.select("market_id", "us").distinct().select("market_id", place("us"), "us").where("market_id is not null and us is not null and chunk is not null")
    cuts = at.withColumns({"kind": F.lit(CUT), "document_id": nothing[0], "url": nothing[1]})
    busy = cuts.select("market_id", "chunk").distinct()
    # Items that no cut-off's lookback reaches aren't carried on, and only chunks with cut-offs get carried items.
    reached = busy.select("market_id", F.explode(F.sequence(F.col("chunk") - CHUNKS_A_LOOKBACK, F.col("chunk"))).alias("chunk")).distinct()
    known = known.repartition("market_id", "chunk").join(reached, ["market_id", "chunk"], "left_semi")  # one exchange serves the items and what is carried, so documents are judged once
    carried = newest_by_url(known, ["market_id", "chunk"], cfg.max_news_items).withColumn("chunk", F.explode(F.sequence(F.col("chunk") + 1, F.col("chunk") + CHUNKS_A_LOOKBACK)))
    carried = carried.join(busy, ["market_id", "chunk"], "left_semi")
    both = known.unionByName(carried).select("market_id", "chunk", F.col("available_us").alias("us"), F.lit(ITEM).alias("kind"), "document_id", "url")
    return cuts.unionByName(both)


def listed_before(decisions: DataFrame, items: DataFrame, cfg: ContextConfig, name: str = "news") -> DataFrame:
    """decisions with up to max_news_items items available in [cutoff - lookback, cutoff), newest first, one for each URL, as (document_id, url, available_us).

    An ordered fold over (market, chunk): items and distinct cut-offs stream past in time order, and a bounded list of the newest items is what a cut-off gets. No pair of a cut-off and
    an item is formed: what is shuffled is each row once, and for each chunk as many carried items as lists may hold. Texts take no part, whatever their length.
    """
    events = news_events(decisions, items, cfg).repartition("market_id", "chunk").sortWithinPartitions("market_id", "chunk", "us", "kind", "document_id", "url")
    lists = events.mapInArrow(partial(_news_lists, most=cfg.max_news_items, span=cfg.news_lookback_hours * HOUR), _LISTS)
    found = lists.select(F.col("market_id").alias("_m"), F.col("us").alias("_u"), F.col("items").alias(name))
    joined = decisions.join(found, (F.col("market_id") == F.col("_m")) & (F.col("us") == F.col("_u")), "left").drop("_m", "_u")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))


def news_before(decisions: DataFrame, items: DataFrame, cfg: ContextConfig, name: str = "news") -> DataFrame:
    """As listed_before, with rank, ISO times and the texts.

    Texts join each distinct list of a market once: a list changes only when an item comes or goes, so there are about twice as many as items, however many cut-offs share them.
    """
    listed = listed_before(decisions, items, cfg, "_listed")
    lists = listed.where(F.size("_listed") > 0).select(F.col("market_id").alias("_m"), F.col("_listed").alias("_l")).distinct()
    item = F.struct(F.col("document_id").cast("string").alias("document_id"), F.col("url").cast("string").alias("url"), F.col("available_us").cast("long").alias("available_us"))
    texts = items.groupBy(F.col("market_id").alias("_t"), item.alias("_i")).agg(F.max(F.col("text").cast("string")).alias("text"))
    places = lists.select("_m", "_l", F.posexplode("_l").alias("_k", "_x")).join(texts, (F.col("_m") == F.col("_t")) & (F.col("_x") == F.col("_i")))
    ranked = F.struct((F.col("_k") + 1).alias("rank"), F.col("_x.document_id").alias("document_id"), F.col("_x.url").alias("url"), iso(F.timestamp_micros("_x.available_us")).alias("available_at"), "text")
    whole = places.groupBy("_m", "_l").agg(F.array_sort(F.collect_list(ranked)).alias(name))
    joined = listed.join(whole, (F.col("market_id") == F.col("_m")) & (F.col("_listed") == F.col("_l")), "left").drop("_m", "_l", "_listed")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(whole.schema[name].dataType)))


def eligible_news(items: DataFrame, market_id: str, cutoff_us: int, cfg: ContextConfig) -> DataFrame:
    """What one cut-off sees, newest first: the items of a market in [cutoff - lookback, cutoff), one for each URL, up to max_news_items."""
    seen = items.where((F.col("market_id") == market_id) & (F.col("available_us") < cutoff_us) & (F.col("available_us") >= cutoff_us - cfg.news_lookback_hours * HOUR))
    return newest_by_url(seen, ["market_id"], cfg.max_news_items).orderBy(F.desc("available_us"), F.desc("document_id"))


def context_rows(decisions: DataFrame, bars: DataFrame, docs: DataFrame, markets: Sequence[Market], cfg: ContextConfig) -> DataFrame:
    """One nested record for each decision (D, C) with research candidates beside it."""
    known = F.create_map(*[x for m in markets for x in (F.lit(m.market_id), F.struct(F.lit(m.question).alias("question"), F.lit(m.outcome1_label).alias("outcome1_label")))])
    busy = even_cuts(decisions, "market_id", "us", HOUR), even_cuts(decisions, "taker", "us", 24 * HOUR)
    rows = actor_history(market_state(decisions, bars, cfg, HOUR, busy[0]), 24 * HOUR, busy[1])
    rows = news_before(rows, news_items(docs, markets, True), cfg, "news")
    rows = news_before(rows, news_items(docs, markets, False), cfg, "research_candidates")
    at = iso(F.col("timestamp"))
    d = F.struct(
        F.col("taker").alias("actor"), F.lit("taker").alias("actor_role"), at.alias("execution_timestamp"), "transaction_hash", "market_id", F.col("nonusdc_side").alias("token_side"), F.col("taker_direction").alias("direction"),
        F.col("direction_outcome1").alias("direction_outcome1_equivalent"), "shares", "recorded_notional_usd", "execution_price", "fill_count",
    )
    c = F.struct(
        at.alias("cutoff_exclusive"), "market_id", known[F.col("market_id")]["question"].alias("question"), known[F.col("market_id")]["outcome1_label"].alias("outcome1_label"), "market_state",
        F.struct("observed_prior_bundles", "recorded_prior_notional_usd").alias("actor_history_in_selected_markets"), "news", F.when(F.size("news") > 0, "verified_items_available").otherwise("no_verified_context").alias("news_status"),
        F.lit("Configured contract identity; historical rule versions not reconstructed.").alias("metadata_note"), F.lit("pre-fill; submission time and individual exposure unobserved").alias("context_semantics"),
    )
    return rows.select("decision_id", F.col("transaction_hash").alias("split_group"), d.alias("D"), c.alias("C"), "research_candidates")


def candidate_view(rows: DataFrame) -> DataFrame:
    """The exploratory view: candidates in the place of verified news, never eligible for training."""
    return rows.select("decision_id", "split_group", "D", F.col("C").dropFields("news").withField("news_candidates", F.col("research_candidates")).alias("C_candidate"), F.lit(False).alias("training_eligible"))


def join_candidates(strict: DataFrame, candidates: DataFrame) -> DataFrame:
    """1:1 by decision_id; ids on one side only, or twice, are an error."""
    pairs = strict.select("decision_id").groupBy("decision_id").agg(F.count("*").alias("a")).join(candidates.groupBy("decision_id").agg(F.count("*").alias("b")), "decision_id", "full")
    if not pairs.where("coalesce(a, 0) != 1 or coalesce(b, 0) != 1").isEmpty():
        raise ValueError("decision and candidate exports don't match")
    return candidate_view(strict.drop("research_candidates").join(candidates.select("decision_id", "research_candidates"), "decision_id"))


def export_stats(rows: DataFrame) -> DataFrame:
    """For each market: decisions, rows with verified news, rows with candidates."""
    return rows.groupBy(F.col("D.market_id").alias("market_id")).agg(F.count("*").alias("decision_rows"), F.count_if(F.size("C.news") > 0).alias("rows_with_news"), F.count_if(F.size("research_candidates") > 0).alias("rows_with_candidates"))
