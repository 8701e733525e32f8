"""Statement pages as a stream: a Python data source whose offsets are polling cycles and whose partitions are requests.

A cycle is planned when Spark asks for the latest offset: its time and its URLs (those of the plan and those that the feed lists) are written as one ledger file. Tasks fetch; each
response is stored before it is handed on, and a task that finds it stored reads it instead of asking again. So a batch that is repeated, after a lost executor or a restart, gives
the same rows, and together with the checkpoint every response is processed exactly once.
"""

from __future__ import annotations

import base64
import importlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import allowed, feed_links

COLUMNS = ("response_id", "run_id", "source_url", "plan_sha256", "plan_recorded_at", "request_started_at", "received_at", "final_url", "status", "content", "fetch_error")
DEFAULT_FETCHER = "tidemark.streaming.capture:fetch"


class Shelf:
    """Small JSON files in a shared folder, each written once: aside, then renamed."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))
        self.kind = fs.FileType

    def read(self, name: str) -> dict | None:
        path = f"{self.root}/{name}.json"
        if self.files.get_file_info(path).type == self.kind.NotFound:
            return None
        with self.files.open_input_stream(path) as f:
            return json.loads(f.read())

    def write(self, name: str, value: dict) -> None:
        path = f"{self.root}/{name}.json"
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        aside = f"{path}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(aside) as f:
            f.write(json.dumps(value).encode())
        self.files.move(aside, path)


def _named(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


@dataclass
class Request(InputPartition):
    cycle: int
    number: int
    url: str
    planned: dict


class StatementResponses(DataSource):
    """Options: plan (JSON), root (a folder that driver and executors share), fetcher (module:function, url -> (bytes, meta))."""

    @classmethod
    def name(cls) -> str:
        return "statement_responses"

    def schema(self):
        from tidemark.streaming.capture import RESPONSES

        return RESPONSES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PollingReader(dict(self.options))


class PollingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.plan, self.root, self.fetcher = json.loads(options["plan"]), options["root"], options.get("fetcher", DEFAULT_FETCHER)

    def initialOffset(self) -> dict:
        return {"cycle": 0}

    def latestOffset(self) -> dict:
        """Plans the next cycle. Its ledger file is there before Spark logs the offset."""
        from tidemark.streaming.capture import now, plan_hash

        shelf, cycle = Shelf(f"{self.root}/polling"), 1
        last = shelf.read("last")
        if last is not None:
            cycle = last["cycle"] + 1
        started, errors = now(), []
        urls = {allowed(u) for u in self.plan.get("release_urls", [])}
        if self.plan.get("feed_url"):
            try:
                urls |= set(feed_links(_named(self.fetcher)(allowed(self.plan["feed_url"]))[0]))
            except Exception as e:  # noqa: BLE001  whatever goes wrong with the feed is recorded, statements go on
                errors.append({"surface": self.plan["feed_url"], "error": str(e)})
        shelf.write(f"cycle-{cycle}", {"run_id": f"{plan_hash(self.plan)[:12]}-{cycle}", "started_at": started, "plan_sha256": plan_hash(self.plan), "urls": sorted(urls), "errors": errors})
        shelf.write("last", {"cycle": cycle})
        return {"cycle": cycle}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        shelf, found = Shelf(f"{self.root}/polling"), []
        for cycle in range(start["cycle"] + 1, end["cycle"] + 1):
            planned = shelf.read(f"cycle-{cycle}")
            facts = {k: planned[k] for k in ("run_id", "started_at", "plan_sha256")}
            found += [Request(cycle, n, url, facts) for n, url in enumerate(planned["urls"])]
        return found

    def read(self, partition: Request) -> Iterator[tuple]:
        from tidemark.streaming.capture import now

        shelf, name = Shelf(f"{self.root}/polling"), f"responses/{partition.cycle}-{partition.number}"
        row = shelf.read(name)
        if row is None:
            requested, content, meta, error = now(), None, {}, None
            try:
                content, meta = _named(self.fetcher)(partition.url)
            except Exception as e:  # noqa: BLE001  one URL's failure is its own
                error = f"{type(e).__name__}: {e}"
            facts = partition.planned
            row = {
                "response_id": f"{facts['run_id']}-{partition.number}", "run_id": facts["run_id"], "source_url": partition.url, "plan_sha256": facts["plan_sha256"], "plan_recorded_at": facts["started_at"],
                "request_started_at": requested, "received_at": now(), "final_url": meta.get("final_url"), "status": meta.get("status"), "content": None if content is None else base64.b64encode(content).decode(), "fetch_error": error,
            }
            shelf.write(name, row)
        yield tuple(bytearray(base64.b64decode(row[c])) if c == "content" and row[c] is not None else row[c] for c in COLUMNS)


def start_polling(spark: SparkSession, plan: dict, root: str, fetcher: str = DEFAULT_FETCHER, interval_seconds: int | None = None, batch=None) -> StreamingQuery:
    """Polls into the same logs as `capture.start`; without an interval one cycle, then it ends. A restart goes on from the checkpoint."""
    from tidemark.streaming import capture

    if plan.get("selection_basis") != "source_schedule":
        raise ValueError("a plan must not depend on prices")
    if interval_seconds is not None and interval_seconds < 30:
        raise ValueError("the interval is at least 30 seconds")
    capture.record_plan(spark, plan, root, capture.now())
    spark.dataSource.register(StatementResponses)
    source = spark.readStream.format("statement_responses").options(plan=json.dumps(plan, sort_keys=True), root=root, fetcher=fetcher).load()
    ready = F.date_format(F.current_timestamp(), capture.ISO_FORMAT)
    with capture.keyed_state(spark):
        writer = capture.judged(capture.processed(source, ready)).writeStream.option("checkpointLocation", f"{root}/polling-checkpoint").foreachBatch(batch or capture.capture_batch(root))
        return (writer.trigger(availableNow=True) if interval_seconds is None else writer.trigger(processingTime=f"{interval_seconds} seconds")).start()
