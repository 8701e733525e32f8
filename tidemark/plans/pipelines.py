"""Staged runs over a configuration, and the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import RunConfig
from tidemark.functions.columns import iso
from tidemark.operators import charts, decisions, dense, fills, news, sparse
from tidemark.sources import readers, search, writers

STAGES = ("analyze", "news", "dc", "render")


def prepared(spark: SparkSession, config: RunConfig) -> tuple[DataFrame, DataFrame]:
    """(participant fills, audit): exchange legs leave before normalisation; every configured market must have rows."""
    raw = readers.load_fills(spark, config.data_path, [m.market_id for m in config.markets])
    kept, audit = fills.normalize(fills.participant_fills(raw), config.input_kind)
    missing = readers.absent_markets(kept, config.markets)
    if missing:
        raise ValueError(f"no fills for markets {missing}")
    return kept, audit


def analyze(spark: SparkSession, config: RunConfig, overwrite: bool = False) -> dict:
    kept, audit = prepared(spark, config)
    scored = dense.movements(dense.dense_bars(kept, config.dense), config.dense)
    return writers.write_run(spark, config, scored, dense.episodes(scored, config.dense), audit, overwrite)


def link(spark: SparkSession, config: RunConfig, documents: DataFrame, reviews: DataFrame | None = None, seed: bool = False) -> DataFrame:
    _, found = readers.read_run(spark, config)
    links = news.match_candidates(found, documents, config.markets, config.news, reviews)
    return news.match_seed(links, documents) if seed else links


#: What supplied documents may say beyond found ones.
SEED_COLUMNS = {"candidate_episode_ids": "array<string>", "context_type": "string", "publication_date_claimed": "string", "timing_evidence": "string", "information_event_id": "string", "market_ids": "array<string>"}


def check_unverified(documents: DataFrame) -> None:
    """Documents with verified times belong to the verified import; a run over supplied documents takes claims only."""
    if "timestamp_status" in documents.columns and not documents.where("timestamp_status = 'verified'").isEmpty():
        raise ValueError("supplied documents must not be marked as verified")


def seed(spark: SparkSession, config: RunConfig, documents: DataFrame, metadata: str | None = None, manifest: str | None = None, overwrite: bool = True) -> dict:
    """A run over supplied documents: bars and episodes, links, decisions with their candidates, what stays unattributed."""
    check_unverified(documents)
    if metadata:
        readers.check_markets(spark, metadata, config.markets)
    if manifest:
        readers.check_manifest(manifest)
    documents = documents.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in SEED_COLUMNS.items() if c not in documents.columns])
    root = config.output_dir
    status: dict = {"analyze": analyze(spark, config, overwrite)}
    writers.write_table(link(spark, config, documents, seed=True), f"{root}/links", overwrite)
    links = spark.read.parquet(f"{root}/links")
    writers.write_table(export(spark, config, documents), f"{root}/decisions", overwrite)
    rows = spark.read.parquet(f"{root}/decisions")
    writers.write_table(decisions.join_candidates(rows, rows.select("decision_id", "research_candidates")), f"{root}/candidates", overwrite)
    _, found = readers.read_run(spark, config)
    writers.write_table(news.unattributed(found, links), f"{root}/unattributed", overwrite)
    status["links"] = [r.asDict() for r in news.link_coverage(documents, links).orderBy("market_id").collect()]
    status["dc"] = [r.asDict() for r in decisions.export_stats(rows).orderBy("market_id").collect()]
    status["unattributed"] = spark.read.parquet(f"{root}/unattributed").count()
    return status


def rebuild(spark: SparkSession, config: RunConfig, documents: DataFrame, output: str, overwrite: bool = True) -> dict:
    """seed, then fine."""
    return {"seed": seed(spark, config, documents, overwrite=overwrite), "fine": fine(spark, config, output, overwrite)}


def extract(spark: SparkSession, markets_source: str, fills_source: str, market_ids: list[str], output: str, overwrite: bool = False) -> dict:
    """Markets and fills of some markets from Parquet at any URL, as sorted Parquet, gzipped CSV and a manifest, whose status says complete last."""
    if not overwrite and readers.exists(spark, f"{output}/manifest"):
        raise ValueError(f"{output} holds an extract already")
    writers.write_json(spark, f"{output}/manifest", {"status": "running", "market_ids": market_ids})
    markets, rows = readers.extract(spark, markets_source, fills_source, market_ids)
    writers.write_table(markets, f"{output}/markets.parquet", overwrite)
    writers.write_sorted(rows, f"{output}/trades.parquet", ["timestamp", "block_number", "transaction_hash", "log_index"], overwrite)
    kept = spark.read.parquet(f"{output}/trades.parquet")
    writers.write_csv(kept, f"{output}/trades_csv")
    counts = [r.asDict() for r in kept.groupBy("market_id").agg(F.count("*").alias("rows"), F.sum("usd_amount").alias("usd_amount"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).orderBy("market_id").collect()]
    manifest = {"status": "complete", "market_ids": market_ids, "markets": counts}
    writers.write_json(spark, f"{output}/manifest", manifest)
    return manifest


def export(spark: SparkSession, config: RunConfig, documents: DataFrame) -> DataFrame:
    kept, _ = prepared(spark, config)
    bars, _ = readers.read_run(spark, config)
    return decisions.context_rows(decisions.bundles(kept), bars, documents, config.markets, config.context)


def pilot(spark: SparkSession, config: RunConfig, documents: DataFrame, stages: tuple[str, ...] = STAGES, overwrite: bool = True) -> dict:
    """analyze, news, dc and render in order; each reads what earlier ones wrote."""
    root, status = config.output_dir, {}
    if "analyze" in stages:
        status["analyze"] = analyze(spark, config, overwrite)
    if "news" in stages:
        links = link(spark, config, documents)
        writers.write_table(links, f"{root}/links", overwrite)
        status["news"] = [r.asDict() for r in news.link_coverage(documents, spark.read.parquet(f"{root}/links")).collect()]
    if "dc" in stages:
        writers.write_table(export(spark, config, documents), f"{root}/decisions", overwrite)
        rows = spark.read.parquet(f"{root}/decisions")
        writers.write_jsonl(rows.drop("research_candidates"), f"{root}/dc_jsonl", gzip=True)
        writers.write_jsonl(rows.select("decision_id", "research_candidates"), f"{root}/candidates_jsonl", gzip=True)
        writers.write_jsonl(rows.orderBy("C.cutoff_exclusive", "decision_id").limit(5), f"{root}/dc_sample")
        status["dc"] = [r.asDict() for r in decisions.export_stats(rows).collect()]
    if "render" in stages:
        status["render"] = render(spark, config, documents)
    return status


def collection_jobs(spark: SparkSession, config: RunConfig) -> DataFrame:
    """Calendar and spike searches of an analysed run, in round-robin order as `place`."""
    bars, found = readers.read_run(spark, config)
    jobs = news.interleaved([news.calendar_jobs(bars, config.markets, config.news), news.spike_jobs(found, config.markets, config.news)])
    order = F.struct("turn", "market_id", "stream")
    return jobs.withColumn("place", F.row_number().over(Window.orderBy(order)).cast("long"))  # as many jobs as windows and best episodes of configured markets


def collect(spark: SparkSession, config: RunConfig, provider: str = "google_rss", fetcher: str | None = "tidemark.sources.search:fetch_search", delay: float = 1.0, **options) -> dict:
    """Searches for an analysed run's windows, within the request budget; documents merge into those that earlier collections found. A later call goes on with what is missing."""
    root = config.output_dir
    found, statuses = search.collect(spark, collection_jobs(spark, config), f"{root}/collection/{provider}", provider, fetcher, config.news.max_requests, delay, **options)
    writers.replace_table(statuses, f"{root}/collection/statuses")
    writers.append_jsonl(spark.read.parquet(f"{root}/collection/statuses").withColumn("collected_at", iso(F.current_timestamp())), f"{root}/collection/log")
    documents = f"{root}/collection/documents"
    if readers.exists(spark, documents):
        found = news.upsert(spark.read.parquet(documents), found, sets=("discovery_modes", "market_ids", "retrieval_request_ids"))
    writers.replace_table(found, documents)
    counts = spark.read.parquet(f"{root}/collection/statuses").groupBy("status").agg(F.count("*").alias("n")).collect()
    return {"documents": spark.read.parquet(documents).count(), "statuses": {r["status"]: r["n"] for r in counts}}


def render(spark: SparkSession, config: RunConfig, documents: DataFrame, reviews: DataFrame | None = None) -> str:
    """Links with reviews, the template for further reviews and the HTML page of each market's best episodes; returns these as JSON."""
    root = config.output_dir
    writers.write_table(link(spark, config, documents, reviews), f"{root}/links", overwrite=True)
    links = spark.read.parquet(f"{root}/links")
    writers.write_jsonl(news.review_template(links), f"{root}/review_template")
    bars, found = readers.read_run(spark, config)
    best = dense.top_episodes(found, config.news.max_episodes_per_market).drop("place")
    line = bars.select("market_id", F.col("bin_us").alias("us"), F.when(F.col("observed"), F.col("price")).alias("value"))
    writers.write_report(news.episode_cards(best, links), f"{root}/report_html", "Episodes and candidate documents", charts.line_charts(line))
    return writers.report_json(best)


def fine(spark: SparkSession, config: RunConfig, output: str, overwrite: bool = True) -> dict:
    """Sparse bars, diagnostics, alerts, groups and searches; a summary for each market."""
    kept, _ = prepared(spark, config)
    writers.write_table(sparse.sparse_bars(kept, config.sparse), f"{output}/bars", overwrite)
    bars = spark.read.parquet(f"{output}/bars")
    writers.write_table(sparse.diagnostics(bars, config.sparse), f"{output}/diagnostics", overwrite)
    found = spark.read.parquet(f"{output}/diagnostics")
    writers.write_table(sparse.alerts(found, config.sparse), f"{output}/alerts", overwrite)
    alerts = spark.read.parquet(f"{output}/alerts")
    writers.write_csv(alerts, f"{output}/alerts_csv")
    writers.write_table(sparse.bounded_groups(alerts, config.sparse), f"{output}/groups", overwrite)
    groups = spark.read.parquet(f"{output}/groups")
    writers.write_table(news.fine_jobs(groups, config.markets), f"{output}/jobs", overwrite)
    summary = {"markets": [r.asDict() for r in sparse.market_summary(bars, found, alerts, config.sparse).orderBy("market_id").collect()], "alerts": alerts.count(), "groups": groups.count(), "windows": []}
    for w in config.review_windows:
        start, end = (int(spark.sql(f"select unix_micros(timestamp '{w[k]}') as us").first()["us"]) for k in ("start", "end"))
        inside = alerts.where((F.col("market_id") == w["market_id"]) & (F.col("detected_us") > start) & (F.col("detected_us") <= end))
        summary["windows"].append({**w, "alerts": inside.count(), "unusual": inside.where("tier = 'unusual_change'").count()})
    writers.write_json(spark, f"{output}/summary", summary)
    return summary


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("analyze", "collect", "pilot", "fine", "seed", "rebuild", "render"):
        p = commands.add_parser(name)
        p.add_argument("--config", required=True)
        p.add_argument("--overwrite", action="store_true")
        if name in ("pilot", "seed", "rebuild", "render"):
            p.add_argument("--documents", required=True)
        if name == "collect":
            p.add_argument("--provider", choices=tuple(search.PROVIDERS), default="google_rss")
            p.add_argument("--fetcher", default="tidemark.sources.search:fetch_search")
            p.add_argument("--delay", type=float, default=1.0)
        if name == "render":
            p.add_argument("--reviews")
        if name == "pilot":
            p.add_argument("--stage", choices=("all", *STAGES), default="all")
        if name == "seed":
            p.add_argument("--metadata")
            p.add_argument("--manifest")
        if name in ("fine", "rebuild"):
            p.add_argument("--output", required=True)
        if name == "fine":
            p.add_argument("--bin-seconds", type=int)
            p.add_argument("--data")
    p = commands.add_parser("extract")
    p.add_argument("--markets", required=True)
    p.add_argument("--fills", required=True)
    p.add_argument("--market-id", action="append", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--overwrite", action="store_true")
    p = commands.add_parser("demo")
    p.add_argument("--output", required=True)
    p = commands.add_parser("primary")
    p.add_argument("--plan", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--watch", type=int)
    p.add_argument("--stream", type=int, help="poll as a stream, every so many seconds")
    p = commands.add_parser("live")
    p.add_argument("--landing", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--bin-seconds", type=int, default=30)
    p.add_argument("--lateness", default="10 minutes")
    p.add_argument("--watch", type=int)
    p = commands.add_parser("audit")
    p.add_argument("--input", required=True)
    args = parser.parse_args(argv)
    from tidemark.session import SETTINGS, ship
    from tidemark.streaming import capture, polling

    builder = SparkSession.builder.appName("tidemark")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    if args.command == "audit":
        try:
            report = capture.audit(spark, args.input)
        except Exception as e:  # noqa: BLE001  a folder without captures is exit code 2
            print(f"{type(e).__name__}: {e}", file=sys.stderr)
            return 2
        print(json.dumps(report, default=str))
        return int(report["validation_status"] == "failed")
    if args.command == "primary":
        with open(args.plan, encoding="utf-8") as f:
            plan = json.load(f)
        if args.stream:
            polling.start_polling(spark, plan, args.output, interval_seconds=args.stream).awaitTermination()
        elif args.watch:
            capture.watch(spark, plan, args.output, args.watch)
        else:
            print(json.dumps(capture.cycle(spark, plan, args.output)))
        return 0
    if args.command == "live":
        capture.start_live_bars(spark, args.landing, args.output, args.bin_seconds, args.lateness, args.watch).awaitTermination()
        return 0
    if args.command == "demo":
        writers.write_table(readers.demo_fills(spark), f"{args.output}/trades.parquet", overwrite=True)
        return 0
    if args.command == "extract":
        print(json.dumps(extract(spark, args.markets, args.fills, args.market_id, args.output, args.overwrite), default=str))
        return 0
    config = RunConfig.load(args.config)
    if args.command == "analyze":
        print(json.dumps(analyze(spark, config, args.overwrite)))
    elif args.command == "collect":
        ready = args.provider != "tavily" or "TAVILY_API_KEY" in os.environ or not args.fetcher.startswith("tidemark.")
        print(json.dumps(collect(spark, config, args.provider, args.fetcher if ready else None, args.delay)))
    elif args.command == "fine":
        if args.bin_seconds:
            config = replace(config, sparse=replace(config.sparse, bin_seconds=args.bin_seconds))
        print(json.dumps(fine(spark, replace(config, data_path=args.data) if args.data else config, args.output, args.overwrite)))
    elif args.command == "seed":
        print(json.dumps(seed(spark, config, spark.read.json(args.documents), args.metadata, args.manifest, args.overwrite)))
    elif args.command == "render":
        print(render(spark, config, spark.read.json(args.documents), spark.read.json(args.reviews) if args.reviews else None))
    elif args.command == "rebuild":
        print(json.dumps(rebuild(spark, config, spark.read.json(args.documents), args.output, args.overwrite)))
    else:
        documents = spark.read.json(args.documents)
        pilot(spark, config, documents, STAGES if args.stage == "all" else (args.stage,), args.overwrite)
    return 0


if __name__ == "__main__":
    sys.exit(main())
