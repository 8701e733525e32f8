"""Streaming capture of fetched pages: append-only logs, first accepted record for each content key, idempotent batches."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from urllib.request import HTTPRedirectHandler, Request, build_opener

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.columns import schema_of
from tidemark.functions.text import STATEMENT_URL, allowed, event_of, feed_links, statement_column
from tidemark.operators.capture import SCHEMA_TAG, canonical_records, content_key
from tidemark.sources.writers import store_snapshots

#: A landed response: what a fetcher writes for each request.
RESPONSES = schema_of("response_id string, run_id string, source_url string, plan_sha256 string, plan_recorded_at string, request_started_at string, received_at string, final_url string, status int, content binary, fetch_error string")
MAX_BYTES = 3_000_000
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


class _OnlyAllowed(HTTPRedirectHandler):
    def redirect_request(self, req, fp, code, msg, headers, newurl):
        return super().redirect_request(req, fp, code, msg, headers, allowed(newurl))


def fetch(url: str) -> tuple[bytes, dict]:
    """Bytes of a permitted URL, at most MAX_BYTES; redirects are checked too."""
    with build_opener(_OnlyAllowed()).open(Request(allowed(url), headers={"Accept-Encoding": "identity"}), timeout=30) as r:
        data = r.read(MAX_BYTES + 1)
        if len(data) > MAX_BYTES:
            raise ValueError("response is too large")
        return data, {"status": r.status, "final_url": allowed(r.url)}


def now() -> str:
    return datetime.now(UTC).isoformat()


def plan_hash(plan: dict) -> str:
    return hashlib.sha256(json.dumps(plan, sort_keys=True).encode()).hexdigest()


def record_plan(spark: SparkSession, plan: dict, root: str, at: str) -> None:
    record = spark.createDataFrame([(plan_hash(plan), at, json.dumps(plan, sort_keys=True), plan["selection_basis"])], "plan_sha256 string, recorded_at string, plan string, selection_basis string")
    record.coalesce(1).write.mode("append").parquet(f"{root}/plans")


def land(spark: SparkSession, plan: dict, root: str, fetcher: Callable[[str], tuple[bytes, dict]] = fetch) -> dict:
    """One polling cycle on the driver: record the plan, read the feed, fetch each statement, land responses as one Parquet file.

    Errors of one URL stay with it. Returns the run's summary so far.
    """
    if plan.get("selection_basis") != "source_schedule":
        raise ValueError("a plan must not depend on prices")
    started, digest, run_id, errors = now(), plan_hash(plan), uuid.uuid4().hex, []
    urls = {allowed(u) for u in plan.get("release_urls", [])}
    record_plan(spark, plan, root, started)
    if plan.get("feed_url"):
        try:
            urls |= set(feed_links(fetcher(allowed(plan["feed_url"]))[0]))
        except Exception as e:  # noqa: BLE001  whatever goes wrong with the feed is recorded, statements go on
            errors.append({"surface": plan["feed_url"], "error": str(e)})
    rows = []
    for n, url in enumerate(sorted(urls)):
        requested = now()
        data, meta, error = None, {}, None
        try:
            data, meta = fetcher(url)
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
        rows.append((f"{run_id}-{n}", run_id, url, digest, started, requested, now(), meta.get("final_url"), meta.get("status"), data, error))
    if rows:
        spark.createDataFrame(rows, RESPONSES).coalesce(1).write.mode("append").parquet(f"{root}/landing")
    return {"run_id": run_id, "started_at": started, "plan_sha256": digest, "selected_statements": len(rows), "errors": errors}


def processed(responses: DataFrame, ready_at: Column) -> DataFrame:
    """Responses parsed and keyed. A failed fetch or parse keeps its error; usable_at is the processing time, never earlier."""
    parsed = responses.withColumn("p", statement_column("content"))
    bad_url = F.when(~F.col("source_url").rlike(STATEMENT_URL), F.lit("ValueError: not a statement URL"))
    rows = parsed.withColumn("error", F.coalesce("fetch_error", bad_url, "p.error")).withColumns({
        "raw_sha256": F.sha2("content", 256), "verified_text": F.when(F.col("error").isNull(), F.col("p.text")), "source_release_claim": F.col("p.header"), "text_sha256": F.sha2("p.text", 256),
        "features_ready_at": ready_at, "usable_at": ready_at, "information_event_id": event_of(F.col("source_url")), "discovery_mode": F.lit("source_schedule"), "schema": F.lit(SCHEMA_TAG),
        "availability_basis": F.lit("collector_observation"), "historical_usable_at": F.lit(None).cast("string"), "extractor": F.lit("fomc-paragraphs-v3"), "raw_path": F.concat(F.lit("raw/"), F.sha2("content", 256), F.lit(".bin")),
    }).drop("p")
    return rows.withColumn("content_version_id", F.when(F.col("error").isNull(), content_key())).withColumn("document_id", F.col("content_version_id"))


def _write_once(df: DataFrame, folder: str, batch: int) -> None:
    """A batch's part of a log: a folder of its own, so a replayed batch replaces what it wrote."""
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Sets the state store that keyed state needs while a query starts."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)


def judged(rows: DataFrame) -> DataFrame:
    """Streaming: rows with status (new_content, known_content, failed) and canonical_usable_at.

    The state of a content key is the time from which it was usable first; it never expires and later records never change it. So a batch costs what its own
    responses cost, however long the log is. Failed responses are keyed by their own id and leave no state.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    rows = rows.withColumnRenamed("status", "http_status").withColumn("state_key", F.coalesce("content_version_id", "response_id"))
    schema = StructType([*rows.schema.fields, StructField("status", StringType()), StructField("canonical_usable_at", StringType())])

    class Judge(StatefulProcessor):
        def init(self, handle):
            self.first = handle.getValueState("first", "usable_at string")

        def handleInputRows(self, key, frames, timer_values):
            import pandas as pd

            frame = pd.concat(list(frames)).sort_values(["request_started_at", "response_id"])  # one content's responses of one batch
            if frame["content_version_id"].iloc[0] is None:
                yield frame.assign(status="failed", canonical_usable_at=None)
                return
            status = ["known_content"] * len(frame)
            if not self.first.exists():
                self.first.update((frame["usable_at"].iloc[0],))
                status[0] = "new_content"
            yield frame.assign(status=status, canonical_usable_at=self.first.get()[0])

        def close(self):
            pass

    return rows.groupBy("state_key").transformWithStateInPandas(Judge(), outputStructType=schema, outputMode="Append", timeMode="None")


def capture_batch(root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function for judged responses: appends new contents to information, every response to observations, raw bytes by hash to raw."""

    def run(batch: DataFrame, number: int) -> None:
        _write_once(batch, f"{root}/parsed", number)  # the state is read once
        rows = batch.sparkSession.read.parquet(f"{root}/parsed/batch={number}")
        store_snapshots(rows.where("content is not null").select("content"), f"{root}/raw")  # before the records that name them
        new = rows.where("status = 'new_content'").drop("status", "canonical_usable_at", "content", "error", "fetch_error", "state_key").withColumnRenamed("http_status", "status")
        _write_once(new, f"{root}/information", number)
        _write_once(rows.select("response_id", "run_id", "source_url", "plan_sha256", "request_started_at", "received_at", "status", "error", "raw_sha256", "content_version_id", "document_id", "canonical_usable_at"), f"{root}/observations", number)

    return run


def start(spark: SparkSession, root: str, landing: str | None = None, interval_seconds: int | None = None) -> StreamingQuery:
    """Streams landed responses. Without an interval it takes what is there and ends.

    The processing time is the batch's own, which the checkpoint keeps, so a replayed batch repeats it.
    """
    source = spark.readStream.schema(RESPONSES).parquet(landing or f"{root}/landing")
    ready = F.date_format(F.current_timestamp(), ISO_FORMAT)
    with keyed_state(spark):
        writer = judged(processed(source, ready)).writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(capture_batch(root))
        if interval_seconds is None:
            return writer.trigger(availableNow=True).start()
        if interval_seconds < 30:
            raise ValueError("the interval is at least 30 seconds")
        return writer.trigger(processingTime=f"{interval_seconds} seconds").start()


def cycle(spark: SparkSession, plan: dict, root: str, fetcher: Callable[[str], tuple[bytes, dict]] = fetch) -> dict:
    """Land one cycle, process it, refresh the derived views, record the cycle."""
    run = land(spark, plan, root, fetcher)
    if _exists(spark, f"{root}/landing"):
        start(spark, root).awaitTermination()
        mine = spark.read.parquet(f"{root}/observations").where(F.col("run_id") == run["run_id"])
        counts = {r["status"]: r["n"] for r in mine.groupBy("status").agg(F.count("*").alias("n")).collect()}
        run["errors"] += [{"surface": r["source_url"], "error": r["error"]} for r in mine.where("status = 'failed'").select("source_url", "error").collect()]
        run |= {"records_added": counts.get("new_content", 0), "unchanged_documents": counts.get("known_content", 0)} | write_index(spark, root)
    run["completed_at"] = now()
    run["status"] = "partial_or_failed" if run["errors"] else "complete" if run["selected_statements"] else "no_matching_statements"
    frame = spark.createDataFrame([(json.dumps(run), run["run_id"], run["status"], [(e["surface"], e["error"]) for e in run["errors"]])], "cycle string, run_id string, status string, errors array<struct<surface: string, error: string>>")
    frame.coalesce(1).write.mode("append").parquet(f"{root}/cycles")
    return run


def write_index(spark: SparkSession, root: str) -> dict:
    """Rewrites the unique view and the aliases; returns counts."""
    rows = spark.read.parquet(f"{root}/information").drop("batch")
    unique, aliases = canonical_records(rows)
    unique.write.mode("overwrite").parquet(f"{root}/information_unique")
    aliases.write.mode("overwrite").parquet(f"{root}/version_aliases")
    n, u = rows.count(), spark.read.parquet(f"{root}/information_unique").count()
    return {"documents": u, "information_records": n, "duplicate_information_records": n - u}


def watch(spark: SparkSession, plan: dict, root: str, interval_seconds: int, cycles: int | None = None, fetcher: Callable[[str], tuple[bytes, dict]] = fetch, sleep: Callable[[float], None] = time.sleep) -> None:
    """Cycles until interrupted."""
    if interval_seconds < 30:
        raise ValueError("the interval is at least 30 seconds")
    done = 0
    try:
        while cycles is None or done < cycles:
            cycle(spark, plan, root, fetcher)
            done += 1
            if cycles is None or done < cycles:
                sleep(interval_seconds)
    except KeyboardInterrupt:
        pass


def first_versions(stream: DataFrame, key: str, order: tuple[str, str]) -> DataFrame:
    """Streaming: the earliest row for each key that never expires; rows of one batch count in `order`, later batches never replace it.

    Keyed state (transformWithStateInPandas, RocksDB state store); emits each key's first accepted row once.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    schema = stream.schema

    class First(StatefulProcessor):
        def init(self, handle):
            self.seen = handle.getValueState("seen", "taken boolean")

        def handleInputRows(self, k, rows, timer_values):
            if self.seen.exists():
                for _ in rows:
                    pass
                return
            best = None  # one row at a time: a hot key's rows are never held together
            for frame in rows:
                first = frame.sort_values(list(order)).head(1)
                if best is None or tuple(first[c].iloc[0] for c in order) < tuple(best[c].iloc[0] for c in order):
                    best = first
            self.seen.update((True,))
            yield best

        def close(self):
            pass

    return stream.groupBy(key).transformWithStateInPandas(First(), outputStructType=schema, outputMode="Append", timeMode="None")


def collected(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there now and returns what it appended, from Parquet in the shared folder."""
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    folder = f"{base.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    with keyed_state(spark):
        query = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, n: _write_once(df, f"{folder}/rows", n)).start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch")


def live_bars(fills: DataFrame, bin_seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """Event-time bars of a live stream of normalised fills: append mode, late fills beyond the watermark are dropped."""
    end = F.window("timestamp", f"{bin_seconds} seconds")
    grouped = fills.withWatermark("timestamp", lateness).groupBy("market_id", end.alias("w")).agg(
        F.sum(F.col("price_outcome1") * F.col("token_amount")).alias("weighted"), F.sum("token_amount").alias("shares"), F.sum("usd_amount").alias("recorded_notional_usd"), F.count("*").alias("fill_count"),
        F.min("price_outcome1").alias("low"), F.max("price_outcome1").alias("high"),
    )
    return grouped.select("market_id", F.col("w.end").alias("bin_end"), (F.col("weighted") / F.col("shares")).alias("price"), "shares", "recorded_notional_usd", "fill_count", "low", "high")


def start_live_bars(spark: SparkSession, landing: str, output: str, bin_seconds: int, lateness: str = "10 minutes", interval_seconds: int | None = None, files_per_batch: int | None = None) -> StreamingQuery:
    """Streams normalised fills that land as Parquet files (market_id, timestamp, price_outcome1, token_amount, usd_amount) into bars below output. Without an interval it takes what is there and ends."""
    source = spark.readStream.schema("market_id string, timestamp timestamp, price_outcome1 double, token_amount double, usd_amount double")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    writer = live_bars(source.parquet(landing), bin_seconds, lateness).writeStream.format("parquet").option("path", f"{output}/bars").option("checkpointLocation", f"{output}/checkpoint").outputMode("append")
    return (writer.trigger(availableNow=True) if interval_seconds is None else writer.trigger(processingTime=f"{interval_seconds} seconds")).start()


#: Invalid records that an audit report names; their count is whole.
AUDIT_SAMPLE = 100


def audit(spark: SparkSession, root: str) -> dict:
    """Replays the log: validates every record, refreshes the derived views only if all are valid; names the first AUDIT_SAMPLE invalid records."""
    from tidemark.operators.capture import error_counts, event_audit, violations
    from tidemark.sources.readers import snapshots

    rows = spark.read.parquet(f"{root}/information").drop("batch")
    plans = spark.read.parquet(f"{root}/plans").withColumn("own_sha256", F.sha2("plan", 256))
    checked = violations(rows, plans, snapshots(spark, root))
    wrong = checked.where(F.size("errors") > 0).select("document_id", "errors")
    invalid = [r.asDict() for r in wrong.orderBy("document_id").limit(AUDIT_SAMPLE).collect()]
    valid = checked.where(F.size("errors") == 0).drop("errors")
    report = {"records": rows.count(), "invalid_count": wrong.count(), "invalid_records": invalid, "validation_status": "failed" if invalid else "passed", "unique_view_refreshed": not invalid}
    if not invalid:
        report |= write_index(spark, root)
    report["events"] = [r.asDict() for r in event_audit(valid).orderBy("event_id").collect()]
    if _exists(spark, f"{root}/cycles"):
        report["errors_by_source"] = [r.asDict() for r in error_counts(spark.read.parquet(f"{root}/cycles")).orderBy("source_url", "error").collect()]
    return report
