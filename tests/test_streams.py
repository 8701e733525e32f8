"""The capture log's state, the raw store, and live bars with late fills."""

import datetime
import hashlib
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.plans import pipelines
from tidemark.sources import readers, writers
from tidemark.streaming import capture, polling
from tests.search_fixture import POINTER
from tests.test_news_capture import NAMED, PLAN, TALLIED

START = datetime.datetime(2025, 1, 1, tzinfo=datetime.UTC)


def test_later_batches_know_earlier_contents_without_the_log(spark, tmp_path):
    """The log of earlier batches is moved away: statuses and first times come from the state alone."""
    root = f"file://{tmp_path}/cap"
    pages = {"20250101": NAMED, "20250102": TALLIED}
    fetcher = lambda url: (pages[url[-13:-5]].encode(), {"status": 200, "final_url": url})
    capture.land(spark, PLAN, root, fetcher)
    capture.start(spark, root).awaitTermination()
    first = {r.source_url: r for r in spark.read.parquet(f"{root}/observations").collect()}
    assert {r.status for r in first.values()} == {"new_content"}
    for name in ("information", "observations", "parsed"):
        shutil.move(f"{tmp_path}/cap/{name}", f"{tmp_path}/{name}-of-the-first-run")
    pages["20250102"] = TALLIED.replace("Body", "Other")
    for _ in range(2):
        capture.land(spark, PLAN, root, fetcher)
    capture.start(spark, root).awaitTermination()
    second = spark.read.parquet(f"{root}/observations").collect()
    known = [r for r in second if r.source_url.endswith("20250101a.htm")]
    changed = sorted((r for r in second if r.source_url.endswith("20250102a.htm")), key=lambda r: r.request_started_at)
    assert [r.status for r in known] == ["known_content"] * 2 and {r.canonical_usable_at for r in known} == {first[known[0].source_url].canonical_usable_at}
    assert [r.status for r in changed] == (["new_content", "known_content"] if TALLIED != pages["20250102"] else ["known_content"] * 2)
    assert {r.document_id for r in spark.read.parquet(f"{root}/information").collect()} == {r.document_id for r in second if r.status == "new_content"}


def test_polling_is_exactly_once_over_a_restart(spark, tmp_path):
    with open(POINTER, "w") as f:
        f.write(str(tmp_path))
    (tmp_path / "20250101.htm").write_text(NAMED)
    (tmp_path / "20250102.htm").write_text(TALLIED)
    root, asked = f"file://{tmp_path}/cap", lambda: len(list(tmp_path.glob("*.call")))

    def failing(batch, number):
        batch.write.format("noop").mode("overwrite").save()
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        polling.start_polling(spark, PLAN, root, "tests.search_fixture:page", batch=failing).awaitTermination()
    assert asked() == 2
    (tmp_path / "20250102.htm").write_text("<p>changed since")
    polling.start_polling(spark, PLAN, root, "tests.search_fixture:page").awaitTermination()
    rows = spark.read.parquet(f"{root}/observations").collect()
    cycles = {r.run_id for r in rows}
    first = [r for r in rows if r.run_id == min(cycles)]
    assert asked() == 2 * len(cycles)  # the repeated cycle asked nobody again
    assert len(first) == 2 and {r.status for r in first} == {"new_content"}
    polling.start_polling(spark, PLAN, root, "tests.search_fixture:page").awaitTermination()
    rows = spark.read.parquet(f"{root}/observations").collect()
    assert len({r.response_id for r in rows}) == len(rows) == asked()
    known = [r for r in rows if r.source_url.endswith("20250101a.htm")]
    assert sorted(r.status for r in known) == ["known_content"] * (len(known) - 1) + ["new_content"] and len({r.canonical_usable_at for r in known}) == 1
    assert {r.status for r in rows if r.run_id == max(cycles) and r.source_url.endswith("20250102a.htm")} <= {"failed", "new_content"}
    assert capture.audit(spark, root)["records"] == 2


def test_raw_store_with_concurrent_writers(spark, tmp_path):
    contents = [f"content {k}".encode() * 1000 for k in range(20)]
    rows = spark.createDataFrame([(bytearray(c),) for c in contents] * 3 + [(None,)], "content binary")
    # Without a shuffle on the content each of the tasks writes every hash.
    for part in (rows, rows.limit(5)):
        assert writers.store_snapshots(part.repartition(4), f"{tmp_path}/raw") <= 20
    racing = spark.range(8, numPartitions=8).crossJoin(rows.where("content is not null").distinct()).select("content")
    assert racing.mapInArrow(writers.partial(writers._store, folder=f"file://{tmp_path}/raw"), "name string").count() == 160
    assert sorted(n for n in os.listdir(f"{tmp_path}/raw") if not n.startswith(".")) == sorted(hashlib.sha256(c).hexdigest() + ".bin" for c in contents)
    found = {r.raw_path: bytes(r.content) for r in readers.snapshots(spark, str(tmp_path)).collect()}
    assert found == {f"raw/{hashlib.sha256(c).hexdigest()}.bin": c for c in contents}


def test_raw_store_finds_a_changed_file(spark, tmp_path):
    rows = spark.createDataFrame([(bytearray(b"as it was"),)], "content binary")
    assert writers.store_snapshots(rows, f"{tmp_path}/raw") == writers.store_snapshots(rows, f"{tmp_path}/raw") == 1
    (tmp_path / "raw" / (hashlib.sha256(b"as it was").hexdigest() + ".bin")).write_bytes(b"as it is")
    for old in tmp_path.glob("raw/.*.crc"):
        old.unlink()
    with pytest.raises(Exception, match="does not hold"):
        writers.store_snapshots(rows, f"{tmp_path}/raw")


def fill(minute, price, shares=10.0):
    return ("m", START + datetime.timedelta(minutes=minute), price, shares, price * shares)


def test_live_bars_take_late_fills_and_drop_very_late_ones(spark, tmp_path):
    ddl = "market_id string, timestamp timestamp, price_outcome1 double, token_amount double, usd_amount double"
    batches = [
        [fill(0, 0.1), fill(4, 0.2), fill(6, 0.3)],
        [fill(12, 0.4), fill(3, 0.6, 30.0)],  # 3: late, within ten minutes of the latest
        [fill(40, 0.5)],
        [fill(2, 0.9), fill(33, 0.7)],  # 2: its bar is out already; 33: late, but in time
        [fill(90, 0.5)],
        [fill(200, 0.5)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landing")
        capture.start_live_bars(spark, f"{tmp_path}/landing", f"{tmp_path}/out", 300, files_per_batch=1).awaitTermination()
    got = {r.bin_end: r for r in spark.read.parquet(f"{tmp_path}/out/bars").collect()}
    kept = spark.createDataFrame([r for rows in batches[:-1] for r in rows if r[1] != START + datetime.timedelta(minutes=2)], ddl)  # the last one's bar is still open
    want = {r.bin_end: r for r in capture.live_bars(kept, 300).collect()}
    assert len(got) == len(want) == 6 and got == want
    first = got[min(got)]
    assert first.fill_count == 3 and abs(first.price - (0.1 * 10 + 0.2 * 10 + 0.6 * 30) / 50) < 1e-12 and (first.low, first.high) == (0.1, 0.6)
    # The command goes on from the checkpoint.
    spark.createDataFrame([fill(400, 0.5)], ddl).write.mode("append").parquet(f"{tmp_path}/landing")
    assert pipelines.main(["live", "--landing", f"{tmp_path}/landing", "--output", f"{tmp_path}/out", "--bin-seconds", "300"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out/bars").where(F.col("fill_count") == 1).count() >= len([r for r in want.values() if r.fill_count == 1]) + 1
