"""Collection: requests as partitions, the stored response cache, statuses, the command; atomic replacement."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.plans import pipelines
from tidemark.sources import readers, search, writers
from tests.search_fixture import POINTER

FETCHER = "tests.search_fixture:answer"
JOBS = "market_id string, query string, start_date string, end_date string, discovery_mode string, place long"


@pytest.fixture
def folder(tmp_path):
    with open(POINTER, "w") as f:
        f.write(str(tmp_path))
    return tmp_path


def calls(folder):
    return sorted(open(p).read() for p in glob.glob(f"{folder}/*.call"))


def jobs(spark, *rows):
    return spark.createDataFrame([(m, q, "2025-01-01", "2025-01-08", mode, k) for k, (m, q, mode) in enumerate(rows)], JOBS)


def run(spark, folder, rows, **options):
    documents, statuses = search.collect(spark, jobs(spark, *rows), f"{folder}/cache", **({"fetcher": FETCHER, "backoff": 0.0} | options))
    return {r.url: r for r in documents.collect()}, [(r.status, r.results) for r in statuses.orderBy("place").collect()]


@pytest.mark.parametrize("provider", ["google_rss", "tavily"])
def test_statuses_budget_and_merged_sets(spark, folder, provider):
    rows = [("m", "q", "calendar"), ("n", "q", "spike"), ("m", "busy", "spike"), ("m", "down", "spike"), ("m", "broken", "spike"), ("m", "late", "spike")]
    documents, statuses = run(spark, folder, rows, max_requests=4, provider=provider)
    assert statuses == [("ok", 2), ("cached", 2), ("ok", 2), ("failed", 0), ("failed", 0), ("budget_skipped", 0)]
    assert calls(folder).count("busy") == 2  # tried again after the first refusal
    shared = documents["https://a.com/x"]
    assert shared.discovery_modes == ["calendar", "spike"] and shared.market_ids == ["m", "n"] and len(shared.retrieval_request_ids) == 2
    assert set(documents) == {"https://a.com/x", "https://a.com/q", "https://a.com/busy"} and shared.timestamp_status == "claimed"


def test_a_later_run_asks_only_for_what_is_missing(spark, folder):
    rows = [("m", q, "spike") for q in ("one", "two", "three", "down")]
    assert [s for s, _ in run(spark, folder, rows, max_requests=2)[1]] == ["ok", "ok", "budget_skipped", "budget_skipped"]
    documents, statuses = run(spark, folder, rows, max_requests=80)
    assert [s for s, _ in statuses] == ["cached", "cached", "ok", "failed"] and len(documents) == 4
    assert calls(folder) == ["down", "one", "three", "two"]
    assert [s for s, _ in run(spark, folder, rows[:3], max_requests=0)[1]] == ["cached"] * 3
    assert calls(folder) == ["down", "one", "three", "two"]


def test_no_key_and_bad_arguments(spark, folder):
    assert run(spark, folder, [("m", "q", "spike")], provider="tavily", fetcher=None)[1] == [("missing_api_key", 0)]
    with pytest.raises(ValueError, match="provider"):
        run(spark, folder, [("m", "q", "spike")], provider="another")
    with pytest.raises(ValueError, match="budget"):
        run(spark, folder, [("m", "q", "spike")], max_requests=-1)
    assert run(spark, folder, [])[1] == [] and calls(folder) == []


def test_collect_command(spark, folder, capsys):
    writers.write_table(readers.demo_fills(spark), f"{folder}/trades.parquet")
    markets = [{"market_id": m, "question": "q", "search_queries": ["one"], "required_term_groups": [["Inter"]]} for m in ("demo-a", "demo-b")]
    (folder / "config.json").write_text(json.dumps({"data_path": f"{folder}/trades.parquet", "output_dir": f"{folder}/out", "markets": markets, "news": {"max_requests": 3}}))
    config = pipelines.RunConfig.load(f"{folder}/config.json")
    pipelines.analyze(spark, config)
    total = pipelines.collection_jobs(spark, config).count()
    assert pipelines.main(["collect", "--config", f"{folder}/config.json", "--fetcher", FETCHER, "--delay", "0"]) == 0
    first = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert first["statuses"]["ok"] == 3 and sum(first["statuses"].values()) == total and first["documents"] == 2
    again = pipelines.collect(spark, config, fetcher=FETCHER, delay=0.0)
    assert len(calls(folder)) == 3 + again["statuses"].get("ok", 0) and again["documents"] == 2
    log = spark.read.json(f"{folder}/out/collection/log")  # appended to by each run
    assert log.count() == 2 * total and log.select("collected_at").distinct().count() == 2
    assert spark.read.parquet(f"{folder}/out/collection/documents").where("array_contains(market_ids, 'demo-a') and size(retrieval_request_ids) >= 3").count() == 2


def test_a_failing_write_leaves_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/table"
    writers.write_table(spark.range(5), path)
    with pytest.raises(Exception, match="oops"):
        writers.write_table(spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("oops"))).otherwise(F.col("id")).alias("id")), path, overwrite=True)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4] and os.listdir(tmp_path) == ["table"]
    writers.write_table(spark.read.parquet(path).where("id < 2"), path, overwrite=True)  # may read what it replaces
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1] and os.listdir(tmp_path) == ["table"]
    writers.write_json(spark, f"{tmp_path}/m", {"a": 1})
    writers.write_json(spark, f"{tmp_path}/m", {"a": 2})
    assert readers.json.loads(spark.read.text(f"{tmp_path}/m").first().value) == {"a": 2}
    with pytest.raises(Exception):
        writers.write_table(spark.range(1), path)


def test_a_rename_that_fails_puts_the_old_table_back(spark, tmp_path):
    path = f"{tmp_path}/table"
    writers.write_table(spark.range(3), path)
    with pytest.raises(Exception):
        writers.replace_path(spark, f"{tmp_path}/nothing", path)
    assert spark.read.parquet(path).count() == 3
