"""News search connectors: requests are partitions of a data source, responses a stored cache, results tables."""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.text import canonical, rss_items
from tidemark.sources.readers import exists

RETRIED = (429, 500, 502, 503, 504)


class HttpError(Exception):
    def __init__(self, status: int):
        super().__init__(f"HTTP {status}")
        self.status = status


def with_retries(call: Callable[[], str], tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> str:
    """Tries again on overload and server errors, waiting 1, 2, ... seconds."""
    for n in range(tries):
        try:
            return call()
        except HttpError as e:
            if e.status not in RETRIED or n == tries - 1:
                raise
            sleep(float(2**n))
    raise AssertionError


def request_id(payload: dict) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()


def rss_payload(job: dict) -> dict:
    query = f"{job['query']} after:{job['start_date']} before:{job['end_date']}"
    return {"url": "https://news.google.com/rss/search?" + urlencode({"q": query, "hl": "en-US", "gl": "US", "ceid": "US:en"})}


def search_payload(job: dict, results: int = 10) -> dict:
    return {"url": "https://api.tavily.com/search", "body": {"query": job["query"], "start_date": job["start_date"], "end_date": job["end_date"], "max_results": results, "topic": "news"}}


def parse_search(text: str) -> list[dict]:
    out = []
    for r in json.loads(text).get("results", []):
        url = canonical(r.get("url"))
        if url and r.get("title"):
            out.append({"title": r["title"], "url": url, "snippet": r.get("content", ""), "published_date": r.get("published_date"), "source": r.get("source", "")})
    return out


def fetch_search(payload: dict) -> str:
    """A response's text over HTTP; the search API's key comes from TAVILY_API_KEY."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    data, headers = None, {"User-Agent": "tidemark"}
    if "body" in payload:
        data = json.dumps(payload["body"]).encode()
        headers |= {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ['TAVILY_API_KEY']}"}
    try:
        with urlopen(Request(payload["url"], data=data, headers=headers), timeout=30) as r:  # noqa: S310  fixed https addresses
            return r.read().decode("utf-8", "replace")
    except HTTPError as e:
        raise HttpError(e.code) from e


PROVIDERS = {"google_rss": (rss_payload, rss_items), "tavily": (search_payload, parse_search)}
RESPONSE_DDL = "request_id string, body string, error string, retrieved_at string"
REQUEST_DDL = "request_id string, payload string, market_id string, discovery_mode string, place long"


@dataclass
class Lane(InputPartition):
    """Requests that one task makes one after the other."""

    requests: list


class SearchResponses(DataSource):
    """One row for each request, fetched by tasks. Options: provider, requests (JSON list of request_id and payload; at most a run's budget), fetcher (module:function), lanes, delay."""

    @classmethod
    def name(cls) -> str:
        return "search_responses"

    def schema(self) -> str:
        return RESPONSE_DDL

    def reader(self, schema) -> DataSourceReader:
        return _ResponseReader(dict(self.options))


class _ResponseReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        requests, lanes = json.loads(self.options["requests"]), max(1, int(self.options.get("lanes", 4)))
        return [Lane(requests[k::lanes]) for k in range(min(lanes, len(requests)))]

    def read(self, partition: Lane) -> Iterator[tuple]:
        module, _, name = self.options["fetcher"].partition(":")
        fetcher, parse = getattr(importlib.import_module(module), name), PROVIDERS[self.options["provider"]][1]
        for n, (key, payload) in enumerate(partition.requests):
            if n and float(self.options.get("delay", 0)):
                time.sleep(float(self.options["delay"]))
            body, error = None, None
            try:
                body = with_retries(lambda p=payload: fetcher(json.loads(p)), sleep=lambda s: time.sleep(s * float(self.options.get("backoff", 1))))
                parse(body)  # what can't be parsed isn't kept
            except Exception as e:  # noqa: BLE001  one request's failure is its status
                body, error = None, f"{type(e).__name__}: {e}"
            yield (key, body, error, datetime.now(UTC).isoformat())


def requests_of(jobs: DataFrame, provider: str) -> DataFrame:
    """jobs (market_id, query, start_date, end_date, discovery_mode, place) with the payload of each and its hash."""
    payload_of = PROVIDERS[provider][0]

    def make(frames):
        for frame in frames:
            payloads = [payload_of(job) for job in frame.to_dict("records")]
            yield frame.assign(payload=[json.dumps(p, sort_keys=True) for p in payloads], request_id=[request_id(p) for p in payloads])[["request_id", "payload", "market_id", "discovery_mode", "place"]]

    return jobs.select("market_id", "query", "start_date", "end_date", "discovery_mode", "place").mapInPandas(make, REQUEST_DDL)


def cached_responses(spark: SparkSession, cache: str) -> DataFrame:
    """(request_id, body, retrieved_at) of all successful attempts, the first of each request."""
    if not exists(spark, f"{cache}/attempts"):
        return spark.createDataFrame([], "request_id string, body string, retrieved_at string")
    rows = spark.read.schema(RESPONSE_DDL).parquet(f"{cache}/attempts").where("body is not null")
    return rows.groupBy("request_id").agg(F.min(F.struct("retrieved_at", "body")).alias("f")).select("request_id", "f.body", "f.retrieved_at")


def found_documents(requests: DataFrame, responses: DataFrame, provider: str) -> tuple[DataFrame, DataFrame]:
    """(documents, result counts by request): responses parsed once each; a document's sets unite over the requests that found it."""
    parse = PROVIDERS[provider][1]
    item_ddl = "request_id string, url string, title string, snippet string, source string, published_at_claimed string, retrieved_at string"

    def parsed(frames):
        import pandas as pd

        for frame in frames:
            rows = [(key, x["url"], x["title"], x.get("snippet", ""), x.get("source"), x.get("published_date"), at) for key, body, at in zip(frame["request_id"], frame["body"], frame["retrieved_at"], strict=True) for x in parse(body)]
            yield pd.DataFrame(rows, columns=["request_id", "url", "title", "snippet", "source", "published_at_claimed", "retrieved_at"])

    wanted = responses.join(requests.select("request_id").distinct(), "request_id", "left_semi")
    items = wanted.select("request_id", "body", "retrieved_at").mapInPandas(parsed, item_ddl)
    text = F.sha2(F.concat_ws("|", "title", "snippet"), 256)
    items = items.withColumn("document_id", F.substring(F.sha2(F.concat_ws("|", "url", text), 256), 1, 20))
    counts = items.groupBy("request_id").agg(F.count("*").cast("int").alias("results"))
    sets = items.join(requests.select("request_id", "market_id", "discovery_mode"), "request_id").groupBy("document_id").agg(
        F.min(F.struct("retrieved_at", "url", "title", "snippet", "source", "published_at_claimed")).alias("f"), *[F.array_sort(F.collect_set(c)).alias(name) for c, name in (("discovery_mode", "discovery_modes"), ("market_id", "market_ids"), ("request_id", "retrieval_request_ids"))]
    )
    documents = sets.select("document_id", "f.url", "f.title", "f.snippet", "f.source", "f.published_at_claimed", F.lit("claimed").alias("timestamp_status"), "discovery_modes", "market_ids", "retrieval_request_ids")
    return documents, counts


def collect(
    spark: SparkSession, jobs: DataFrame, cache: str, provider: str = "google_rss", fetcher: str | None = "tidemark.sources.search:fetch_search", max_requests: int = 80, delay: float = 0.0, lanes: int = 4, backoff: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """(documents, statuses) of search jobs in order of `place`.

    Requests whose response is in the cache (a table in a shared folder) are left out by an anti join; of the others the first max_requests are fetched by tasks and appended to the cache, so an interrupted run
    goes on where it was. Statuses: ok, cached (also a job that repeats an earlier one's request), budget_skipped, missing_api_key, failed.
    """
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider}")
    if max_requests < 0:
        raise ValueError("the budget can't be negative")
    run = uuid.uuid4().hex
    requests_of(jobs, provider).write.parquet(f"{cache}/jobs/run={run}")
    requests = spark.read.schema(REQUEST_DDL).parquet(f"{cache}/jobs/run={run}")
    old = cached_responses(spark, cache).select("request_id", F.lit(True).alias("_old"))
    missing = requests.groupBy("request_id").agg(F.min("place").alias("place"), F.min("payload").alias("payload")).join(old, "request_id", "left_anti")
    chosen = missing.orderBy("place", "request_id").limit(max_requests if fetcher else 0).collect()  # at most the budget
    attempts = spark.createDataFrame([], RESPONSE_DDL)
    if chosen:
        spark.dataSource.register(SearchResponses)
        options = {"provider": provider, "fetcher": fetcher, "lanes": str(lanes), "delay": str(delay), "backoff": str(backoff), "requests": json.dumps([(r["request_id"], r["payload"]) for r in chosen])}
        spark.read.format("search_responses").options(**options).load().write.parquet(f"{cache}/attempts/run={run}")
        attempts = spark.read.schema(RESPONSE_DDL).parquet(f"{cache}/attempts/run={run}")
    documents, counts = found_documents(requests, cached_responses(spark, cache), provider)
    first = F.row_number().over(Window.partitionBy("request_id").orderBy("place", "market_id", "discovery_mode")) == 1
    tried = attempts.select("request_id", F.col("body").isNotNull().alias("_ok"), "error")
    judged = requests.withColumn("_first", first).join(tried, "request_id", "left").join(counts, "request_id", "left")
    skipped = F.lit("budget_skipped" if fetcher else "missing_api_key")
    state = F.when(F.col("_ok"), F.when(F.col("_first"), "ok").otherwise("cached")).when(~F.col("_ok"), "failed")
    # Anti-joined requests were known before this run.
    known = missing.select("request_id", F.lit(True).alias("_missing"))
    judged = judged.join(known.join(F.broadcast(tried.select("request_id")), "request_id", "left_anti"), "request_id", "left")  # tried: at most the budget
    status = F.coalesce(state, F.when(F.col("_missing"), skipped), F.lit("cached"))
    return documents, judged.select("request_id", "market_id", "discovery_mode", status.alias("status"), F.coalesce("results", F.lit(0)).alias("results"), "error", "place")
