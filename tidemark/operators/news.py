"""Documents around episodes and alerts: candidate links, context, search jobs, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Market, NewsConfig
from tidemark.functions.columns import aware_time, html_escape, iso, micros, relevance, relevant_pairs
from tidemark.functions.text import canonical_url
from tidemark.operators.decisions import verified_time

HOUR = 3_600_000_000
DAY = 24 * HOUR
LABELS = ("unreviewed", "plausible_context", "background", "aftermath", "rejected")


def headline(docs: DataFrame):
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")) if "snippet" in docs.columns else F.lit(""))


def interval_join(spans: DataFrame, points: DataFrame, low: str, high: str, at: str, bucket: int = DAY) -> DataFrame:
    """Inner join on market_id with low <= at <= high, as an equi-join on time buckets: a span stands in every bucket it touches."""
    placed = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / F.lit(bucket)), F.floor(F.col(high) / F.lit(bucket)))))
    return placed.join(points.withColumn("_b", F.floor(F.col(at) / F.lit(bucket))), ["market_id", "_b"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_b")


def match_candidates(episodes: DataFrame, docs: DataFrame, markets: Sequence[Market], cfg: NewsConfig, reviews: DataFrame | None = None) -> DataFrame:
    """Episode-document links: fully relevant, time within [start - lookback, end + post] or unknown; best rank for each URL."""
    verified = verified_time(docs)
    items = relevant_pairs(docs.withColumn("verified_us", micros(verified)), headline(docs), markets, whole=True)
    items = items.withColumn("used_us", F.coalesce("verified_us", micros(aware_time(F.col("published_at_claimed")))))
    items = items.select("market_id", "document_id", "url", "published_at_claimed", "verified_us", "used_us", "relevance")
    spans = episodes.select("episode_id", "market_id", "start_us", "end_us", (F.col("start_us") - cfg.lookback_hours * HOUR).alias("_low"), (F.col("end_us") + cfg.post_hours * HOUR).alias("_high"))
    timed = interval_join(spans, items.where("used_us is not null"), "_low", "_high", "used_us")
    untimed = spans.join(items.where("used_us is null"), "market_id")
    both = timed.unionByName(untimed).drop("_low", "_high")
    role = F.when(F.col("used_us").isNull(), "unknown_time").when(F.col("used_us") < F.col("start_us"), "pre_window").when(F.col("used_us") <= F.col("end_us"), "within_window_timing_ambiguous").otherwise("after_window")
    weight = F.when(F.col("temporal_role") == "pre_window", 2.0).when(F.col("temporal_role") == "within_window_timing_ambiguous", 1.0).otherwise(0.0)
    checked = F.col("verified_us").isNotNull()
    ranked = both.withColumn("temporal_role", role).withColumn("timestamp_verified", checked).withColumn("rank_score", F.col("relevance") + weight + F.when(checked, 0.5).otherwise(0.0))
    w = Window.partitionBy("episode_id", canonical_url("url")).orderBy(F.desc("rank_score"), "document_id")
    links = ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    # Titles join the links that are left; the joins and the ranking above carry none.
    titles = docs.select(F.col("document_id").alias("_d"), F.col("url").alias("_u"), "title").dropDuplicates(["_d", "_u"])
    links = links.join(titles, (F.col("document_id") == F.col("_d")) & F.col("url").eqNullSafe(F.col("_u")))
    links = links.select("episode_id", "market_id", "document_id", "url", "title", "published_at_claimed", F.when(checked, iso(F.timestamp_micros("verified_us"))).alias("verified_available_at"), "temporal_role", "timestamp_verified", "rank_score")
    return review(links, reviews) if reviews is not None else links.withColumns({"review_label": F.lit("unreviewed"), "review_note": F.lit("")})


def review(links: DataFrame, reviews: DataFrame) -> DataFrame:
    """links with review_label (unreviewed by default) and review_note; labels outside the vocabulary are an error."""
    r = reviews.select("episode_id", "document_id", F.col("label").alias("review_label"), F.coalesce("note", F.lit("")).alias("review_note") if "note" in reviews.columns else F.lit("").alias("review_note"))
    label = F.coalesce("review_label", F.lit("unreviewed"))
    known = F.when(label.isin(*LABELS), label).otherwise(F.raise_error(F.concat(F.lit("unknown review label: "), label)))
    return links.join(r, ["episode_id", "document_id"], "left").withColumn("review_label", known).withColumn("review_note", F.coalesce("review_note", F.lit("")))


def match_seed(links: DataFrame, docs: DataFrame) -> DataFrame:
    """links of supplied documents: date-only documents only in their listed episodes, at rank 1; match reports at rank 0.5."""
    extra = docs.select("document_id", "candidate_episode_ids", "context_type", "publication_date_claimed", F.coalesce("timing_evidence", F.lit("")).alias("source_timing_note"), "information_event_id")
    rows = links.join(extra, "document_id")
    listed = F.col("candidate_episode_ids")
    undated = aware_time(F.col("published_at_claimed")).isNull()
    rows = rows.where((listed.isNull() | F.array_contains(listed, F.col("episode_id"))) & (~undated | (F.coalesce(F.size(listed), F.lit(0)) > 0)))
    report = F.coalesce(F.col("context_type") == "retrospective_match_report", F.lit(False))
    return rows.withColumns({
        "temporal_role": F.when(report, "aftermath_report_not_pre_move_evidence").when(undated, "date_only_timing_ambiguous").otherwise(F.col("temporal_role")),
        "rank_score": F.when(report, 0.5).when(undated, 1.0).otherwise(F.col("rank_score")), "context_type": F.coalesce("context_type", F.lit("candidate")),
    }).drop("candidate_episode_ids")


def context_asof(docs: DataFrame, market: Market, cutoff_us: int) -> DataFrame:
    """Verified, relevant documents available strictly before a cut-off."""
    time = micros(verified_time(docs))
    rows = docs.withColumn("available_us", time).where((F.col("available_us") < cutoff_us) & (relevance(F.col("verified_text"), market) == 1.0))
    return rows.select("document_id", canonical_url("url").alias("url"), iso(F.timestamp_micros("available_us")).alias("available_at"), F.col("verified_text").alias("text")).orderBy("available_at", "document_id")


def known_context(alert_rows: DataFrame, episodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links of the episodes whose window holds an alert; the first episode wins for each alert and document."""
    spans = episodes.select("market_id", "episode_id", F.col("start_us").alias("_low"), F.col("end_us").alias("_high"), "detected_us" if "episode_order" not in episodes.columns else F.col("episode_order").alias("detected_us"))
    spans = spans.withColumnRenamed("detected_us", "_order")
    hit = interval_join(spans, alert_rows.select("alert_id", "market_id", "detected_us", "start_us"), "_low", "_high", "detected_us")
    pairs = hit.join(links.drop("market_id"), "episode_id")
    first = Window.partitionBy("alert_id", "document_id").orderBy("_order", "episode_id")
    pub = micros(aware_time(F.col("published_at_claimed")))
    report = F.coalesce(F.col("context_type") == "retrospective_match_report", F.lit(False)) if "context_type" in links.columns else F.lit(False)
    role = (
        F.when(report, "aftermath_not_pre_move_evidence").when(F.coalesce("published_at_claimed", F.lit("")) == "", "unknown_ordering_date_only").when(pub.isNull(), "unknown_timezone")
        .when(pub < F.col("start_us"), "before_window_claim_only").when(pub >= F.col("detected_us"), "after_detection").otherwise("within_window_ambiguous")
    )
    kept = pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select("alert_id", "market_id", "document_id", F.col("episode_id").alias("legacy_episode_id"), role.alias("temporal_role"), F.lit("existing_manual_scope_overlap_NOT_new_attribution").alias("relation"), F.lit(False).alias("training_eligible"))


def unattributed(episodes: DataFrame, links: DataFrame) -> DataFrame:
    return episodes.join(links.select("episode_id").distinct(), "episode_id", "left_anti")


def review_template(links: DataFrame) -> DataFrame:
    """What a reviewer fills in: one row for each link."""
    return links.select("episode_id", "document_id", F.col("review_label").alias("label"), F.col("review_note").alias("note"))


def top_links(links: DataFrame, n: int = 10) -> DataFrame:
    """The n best links of each episode by rank, then document, with place from 1."""
    w = Window.partitionBy("episode_id").orderBy(F.desc("rank_score"), "document_id")
    return links.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def episode_cards(episodes: DataFrame, links: DataFrame, n: int = 10) -> DataFrame:
    """(market_id, detected_us, episode_id, candidates, html): an HTML section for each episode, with its n best links; all text is escaped."""
    label = F.concat_ws(", ", "temporal_role", "review_label", F.concat(F.lit("published "), F.coalesce("published_at_claimed", F.lit("unknown"))))
    entry = F.concat(F.lit('<li><a href="'), html_escape(canonical_url("url")), F.lit('">'), html_escape(F.col("title")), F.lit("</a> <small>"), html_escape(label), F.lit("</small></li>"))
    lists = top_links(links, n).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("place", entry.alias("entry")))).alias("entries"))
    counts = links.groupBy("episode_id").agg(F.count("*").alias("candidates"))
    rows = episodes.select("market_id", "detected_us", "episode_id", "detected_at", "window_start", "window_end", "kind", "initial_displacement_pp").join(counts, "episode_id", "left").join(lists, "episode_id", "left")
    rows = rows.withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long")))
    way = F.when(F.col("initial_displacement_pp") > 0, "rise").otherwise("fall or still")
    summary = F.concat_ws(" | ", "detected_at", "kind", way, F.concat(F.col("candidates").cast("string"), F.lit(" candidates")))
    body = F.when(F.col("candidates") > 0, F.concat(F.lit("<ol>"), F.array_join("entries.entry", ""), F.lit("</ol>"))).otherwise("<p>No candidate found; that is no proof of absence.</p>")
    html = F.concat(
        F.lit('<details id="episode-'), html_escape(F.col("episode_id")), F.lit('"><summary>'), html_escape(summary), F.lit("</summary><p>"), html_escape(F.concat_ws(" to ", "window_start", "window_end")), F.lit("</p>"), body, F.lit("</details>"),
    )
    return rows.select("market_id", "detected_us", "episode_id", "candidates", html.alias("html"))


def _queries(markets: Sequence[Market], most: int):
    return F.create_map(*[x for m in markets for x in (F.lit(m.market_id), F.array(*[F.lit(q) for q in m.search_queries[:most]]).cast("array<string>"))])


def _day(us, days: int = 0):
    return F.date_format(F.date_add(F.timestamp_micros(us).cast("date"), days), "yyyy-MM-dd")


def calendar_jobs(bars: DataFrame, markets: Sequence[Market], cfg: NewsConfig) -> DataFrame:
    """Search windows of calendar_window_days from the day before the first bar to the day after the last; the last window is clipped."""
    width = cfg.calendar_window_days * DAY
    day = lambda c: c - F.pmod(c, F.lit(DAY))
    span = bars.groupBy("market_id").agg((day(F.min("bin_us")) - DAY).alias("a"), (day(F.max("bin_us")) + DAY).alias("z"))
    starts = span.select("market_id", "z", F.posexplode(F.sequence(F.col("a"), F.col("z") - 1, F.lit(width))).alias("position", "start_us"))
    rows = starts.withColumn("end_us", F.least(F.col("start_us") + width, F.col("z"))).withColumn("query", F.explode(_queries(markets, 1)[F.col("market_id")]))
    return rows.select("market_id", F.lit(None).cast("string").alias("episode_id"), F.lit("calendar").alias("discovery_mode"), "query", "start_us", "end_us", _day(F.col("start_us")).alias("start_date"), _day(F.col("end_us")).alias("end_date"), "position")


def spike_jobs(episodes: DataFrame, markets: Sequence[Market], cfg: NewsConfig) -> DataFrame:
    """Padded windows around each market's best episodes, for its first two queries."""
    from tidemark.operators.dense import top_episodes

    best = top_episodes(episodes, cfg.max_episodes_per_market).withColumns({"a": F.col("start_us") - cfg.lookback_hours * HOUR, "z": F.col("end_us") + cfg.post_hours * HOUR})
    rows = best.select("market_id", "episode_id", "place", "a", "z", F.posexplode(_queries(markets, 2)[F.col("market_id")]).alias("q", "query"))
    return rows.select("market_id", "episode_id", F.lit("spike").alias("discovery_mode"), "query", F.col("a").alias("start_us"), F.col("z").alias("end_us"), _day(F.col("a"), -1).alias("start_date"), _day(F.col("z"), 1).alias("end_date"), ((F.col("place") - 1) * 2 + F.col("q")).alias("position"))


def interleaved(streams: Sequence[DataFrame]) -> DataFrame:
    """Jobs of several streams in round-robin order: by place in the stream, then by stream and market."""
    out = None
    for n, s in enumerate(streams):
        place = F.row_number().over(Window.partitionBy("market_id").orderBy("position", "query")) - 1
        part = s.withColumn("turn", place).withColumn("stream", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out.drop("position").orderBy("turn", "market_id", "stream")


def fine_jobs(groups: DataFrame, markets: Sequence[Market]) -> DataFrame:
    """One search for each group and query, from 30 minutes before its window to 10 minutes after its last detection."""
    minute = 60_000_000
    rows = groups.withColumn("query", F.explode(_queries(markets, 1 << 20)[F.col("market_id")]))
    return rows.select("group_id", "market_id", "query", (F.col("start_us") - 30 * minute).alias("start_us"), (F.col("last_us") + 10 * minute).alias("end_us"))


def merged_sets(rows: DataFrame, sets: Sequence[str] = ("discovery_modes", "market_ids")) -> DataFrame:
    """One row for each document: sorted distinct unions of its set-valued columns, the smallest of all others."""
    plain = [c for c in rows.columns if c not in (*sets, "document_id")]
    return rows.groupBy("document_id").agg(*[F.min(c).alias(c) for c in plain], *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in sets])


def upsert(old: DataFrame, new: DataFrame, prefer: str = "old", sets: Sequence[str] = ("discovery_modes", "market_ids")) -> DataFrame:
    """Full outer merge by document_id; prefer says whose value wins where both have one; sets are united."""
    o, n = old.select(F.struct(*old.columns).alias("o"), F.col("document_id").alias("_k")), new.select(F.struct(*new.columns).alias("n"), F.col("document_id").alias("_j"))
    rows = o.join(n, F.col("_k") == F.col("_j"), "full")
    out = []
    for c in dict.fromkeys([*old.columns, *new.columns]):
        sides = [F.col(f"{s}.{c}") for s, df in (("o", old), ("n", new)) if c in df.columns]
        if prefer == "new":
            sides.reverse()
        if c in sets and len(sides) == 2:
            empty = F.array().cast("array<string>")
            out.append(F.array_sort(F.array_union(F.coalesce(sides[0], empty), F.coalesce(sides[1], empty))).alias(c))
        else:
            out.append(F.coalesce(*sides).alias(c))
    return rows.select(*out)


def attach_requests(docs: DataFrame, statuses: DataFrame) -> DataFrame:
    """docs with the modes and markets of the searches that found them. docs: document_id, retrieval_request_ids; statuses: request_id, discovery_mode, market_id."""
    hits = docs.select("document_id", F.explode("retrieval_request_ids").alias("request_id")).join(statuses.select("request_id", "discovery_mode", "market_id"), "request_id")
    found = hits.groupBy("document_id").agg(F.array_sort(F.collect_set("discovery_mode")).alias("discovery_modes"), F.array_sort(F.collect_set("market_id")).alias("market_ids"))
    return docs.drop("discovery_modes", "market_ids").join(found, "document_id", "left")


def link_coverage(docs: DataFrame, links: DataFrame) -> DataFrame:
    """For each market: documents that name it, links, and distinct episodes with links."""
    one = docs.select(F.explode("market_ids").alias("market_id")).groupBy("market_id").agg(F.count("*").alias("documents"))
    two = links.groupBy("market_id").agg(F.count("*").alias("links"), F.countDistinct("episode_id").alias("linked_episodes"))
    return one.join(two, "market_id", "full").select("market_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "links", "linked_episodes")])
