"""Sparse groups, decisions, news, text functions, capture stream, sources."""

import collections
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.config import ContextConfig, Market, NewsConfig, RunConfig, SparseConfig
from tidemark.functions import text
from tidemark.functions.columns import aware_time, iso, relevance
from tidemark.operators import capture, charts, decisions, news, sparse
from tidemark.sources import readers, search, writers

MARKET = Market("m", "q", required_term_groups=(("Inter Milan", "Inter"), ("UEFA",)))
DOC = "document_id string, url string, title string, snippet string, published_at_claimed string, timestamp_status string, verified_available_at string, verification_evidence string, verified_text string, discovery_modes array<string>"
HOUR = 3_600_000_000


def doc(i, at="2025-01-01T00:00:00Z", url=None, title="Inter UEFA", verified=False, mode="calendar"):
    return (f"d{i}", url or f"https://x/{i}", title, "", at, "verified" if verified else "claimed", at if verified else None, "e" if verified else "", title if verified else "", [mode])


def test_relevance_respects_word_boundaries(spark):
    rows = spark.createDataFrame([("INTER milan in UEFA",), ("internet UEFA",), ("éinter UEFA",), ("Inter",), (None,)], "t string")
    assert [r[0] for r in rows.select(relevance(F.col("t"), MARKET)).collect()] == [1.0, 0.5, 0.5, 0.5, 0.0]
    assert rows.select(relevance(F.col("t"), Market("n"))).first()[0] == 0.0


def test_times_need_offsets(spark):
    rows = spark.createDataFrame([("2025-01-01T12:00:00",), ("2025-01-01",), ("2025-01-01T12:00:00+02:00",), ("2025-01-01T12:00:00.5Z",), ("bad Z",)], "t string")
    assert [r[0] for r in rows.select(iso(aware_time(F.col("t")))).collect()] == [None, None, "2025-01-01T10:00:00+00:00", "2025-01-01T12:00:00.500000+00:00", None]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://A.b/c?utm_x=1&q=a%20b&e=&FBCLID=2#f", "https://a.b/c?q=a+b&e="), ("http://a", "http://a"), ("ftp://a/b", None), ("https:///x", None), (None, None), ("https://a/?x=1&x=2", "https://a/?x=1&x=2"),
    ],
)
def test_canonical_url(url, want):
    assert text.canonical(url) == want


def test_paragraph_rules():
    assert text.paragraph_list("<p>a<br>b &amp; c<p>d</p>x<div><p>e<table><p>f</body>g") == ["a b & c", "d", "e", "f"]
    assert text.paragraph_list("<p>a<!-- <p>no --><script>if (a<b) '<p>'</script> z") == ["aif (a<b) '<p>' z"]


NAMED = "<p>For release at 2 p.m.</p><p>Body.</p><p>Voting for the monetary policy action were A.<p>Voting against: B.<p>Later<p>For media inquiries x"
TALLIED = "<p>For release at 2 p.m.<p>The Federal Open Market Committee approved the following statement for release by a 9 – 2 vote:<p>Economy.<p>The Committee decided to keep the target range for the federal funds rate.<p>More.<p>Implementation Note"


def test_statement_layouts_fail_closed():
    assert text.statement(NAMED.encode())[0] == "Body.\n\nVoting for the monetary policy action were A.\n\nVoting against: B."
    assert text.statement(b"\xef\xbb\xbf" + TALLIED.encode())[0].endswith("More.")
    for bad in ("<p>none", TALLIED.replace("<p>Implementation Note", ""), TALLIED.replace("<p>More.", "").replace("<p>Economy.", ""), NAMED.replace("Voting for the", "Voting of the")):
        with pytest.raises(ValueError):
            text.statement(bad.encode())
    with pytest.raises(ValueError):
        text.statement(TALLIED.encode(), "fomc-paragraphs-v2")


def test_rss_and_allowed():
    feed = "<rss><channel><item><title>T</title><link>https://A.com/x?utm_a=1</link><pubDate>Wed, 01 Jan 2025 10:00:00 +0200</pubDate></item><item><title/><link>https://b</link></item></channel></rss>"
    assert text.rss_items(feed) == [{"title": "T", "url": "https://a.com/x", "published_date": "2025-01-01T08:00:00+00:00", "source": "a.com", "publisher_homepage": None}]
    with pytest.raises(ValueError):
        text.rss_items("<feed/>")
    for bad in ("http://www.federalreserve.gov/x", "https://u:p@www.federalreserve.gov/", "https://www.federalreserve.gov:8443/", "https://evil.com/"):
        with pytest.raises(ValueError):
            text.allowed(bad)


def test_groups_are_bounded_and_lose_nothing(spark):
    cfg = SparseConfig()
    times = [0, 100, 220, 340, 460, 580, 700, 821, 2000]  # gaps of 120 s at most, then one of 121 s
    rows = spark.createDataFrame([("m", t * 1_000_000, (t - 60) * 1_000_000, f"a{t}") for t in times], "market_id string, detected_us long, start_us long, alert_id string")
    got = sparse.bounded_groups(rows, cfg).orderBy("first_us").collect()
    want, last, first = [], None, None
    for t in times:
        if last is None or t - last > 120 or t - first > 600:
            want.append([])
            first = t
        want[-1].append(f"a{t}")
        last = t
    assert [g.alert_ids for g in got] == want


def test_groups_go_on_across_batches(spark):
    rows = [(m, t * 1_000_000, 0, f"{m}{t}") for m in ("a", "b") for t in range(0, 60 * 500, 60)]
    frame = spark.createDataFrame(rows, "market_id string, detected_us long, start_us long, alert_id string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sparse.bounded_groups(frame, SparseConfig(news_max_span_seconds=600)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(len(g.alert_ids) for g in got) == [5, 5, *[11] * 90]  # 500 = 45 * 11 + 5


def test_line_charts(spark):
    rng = random.Random(4)
    line = [("a<b", 10 * k, None if k in (30, 31) else round(rng.random(), 3)) for k in range(1000)] + [("one", 7, 0.5), ("gap", 1, None)]
    frame = spark.createDataFrame(line, "market_id string, us long, value double")
    columns = collections.defaultdict(list)
    for market, us, value in line:
        span = 9991 if market == "a<b" else 1
        columns[market, us * 20 // span if market == "a<b" else 0].append((us, value))
    want = set()
    for (market, _), points in columns.items():
        seen, gaps = [p for p in points if p[1] is not None], [p for p in points if p[1] is None]
        want |= {(market, *p) for p in [*gaps[:1], *(seen and [seen[0], seen[-1], min(seen, key=lambda p: (p[1], p[0])), max(seen, key=lambda p: (p[1], -p[0]))])]}
    assert sorted(map(str, charts.line_columns(frame, 20).select("market_id", "us", "value").collect())) == sorted(str(Row(market_id=m, us=u, value=v)) for m, u, v in want)
    html = {r.market_id: r.html for r in charts.line_charts(frame, 20, 100).collect()}
    assert html["a<b"].count("M") == 2 and "price of a&lt;b" in html["a<b"] and 'd="M0.0 50.0"' in html["one"] and 'd=""' in html["gap"]
    assert charts.line_charts(frame.limit(0)).count() == 0


def test_cards_name_the_ten_best_links_and_escape_text(spark):
    episodes = spark.createDataFrame(
        [("e1", "m", 5, "t0", "t1", "t2", "jump", 1.0), ("e2", "m", 9, "t0", "t1", "t2", "jump", -1.0)],
        "episode_id string, market_id string, detected_us long, detected_at string, window_start string, window_end string, kind string, initial_displacement_pp double",
    )
    links = spark.createDataFrame(
        [("e1", f"d{k:02}", "https://x/?a=1&b=2", "<b>'\"&" if k == 12 else f"title {k}", None, "pre_window", float(k // 2), "unreviewed") for k in range(13)],
        "episode_id string, document_id string, url string, title string, published_at_claimed string, temporal_role string, rank_score double, review_label string",
    )
    assert [r.document_id for r in news.top_links(links).orderBy("place").collect()] == ["d12", "d10", "d11", "d08", "d09", "d06", "d07", "d04", "d05", "d02"]
    html = {r.episode_id: (r.candidates, r.html) for r in news.episode_cards(episodes, links).collect()}
    assert html["e1"][0] == 13 and html["e1"][1].count("<li>") == 10 and "&lt;b&gt;&#x27;&quot;&amp;</a>" in html["e1"][1] and "published unknown" in html["e1"][1]
    assert html["e1"][1].index("&lt;b&gt;") < html["e1"][1].index("title 10<") < html["e1"][1].index("title 11<")
    assert html["e2"][0] == 0 and "No candidate" in html["e2"][1]


def test_candidate_links(spark):
    episodes = spark.createDataFrame([("e1", "m", 0 + 1735689600_000000, 1735689600_000000 + HOUR)], "episode_id string, market_id string, start_us long, end_us long")
    docs = spark.createDataFrame(
        [doc(1, "2024-12-31T23:00:00Z"), doc(2, "2025-01-01T00:30:00Z", url="https://x/1"), doc(3, "2025-01-01T03:00:00Z"), doc(4, "2025-01-01T03:00:01Z"), doc(5, None), doc(6, "2025-01-01T00:30:00Z", title="Inter only"), doc(7, "2024-12-31T00:00:00Z", verified=True)], DOC
    )
    got = {r.document_id: r for r in news.match_candidates(episodes, docs, [MARKET], NewsConfig()).collect()}
    assert {k: (v.temporal_role, v.rank_score) for k, v in got.items()} == {"d1": ("pre_window", 3.0), "d3": ("after_window", 1.0), "d5": ("unknown_time", 1.0), "d7": ("pre_window", 3.5)}
    with pytest.raises(Exception, match="unknown review label"):
        reviews = spark.createDataFrame([("e1", "d1", "great")], "episode_id string, document_id string, label string")
        news.match_candidates(episodes, docs, [MARKET], NewsConfig(), reviews).collect()


def test_news_is_strictly_before_the_cutoff(spark):
    docs = spark.createDataFrame([doc(1, "2025-01-01T00:00:00Z", verified=True), doc(2, "2025-01-01T01:00:00Z", verified=True), doc(3, "2025-01-01T00:30:00Z", verified=True, mode="spike"), doc(4, "2025-01-01T00:40:00Z")], DOC)
    cuts = spark.createDataFrame([("m", 1735689600_000000 + HOUR), ("m", 1735689600_000000)], "market_id string, us long")
    cfg = ContextConfig(news_lookback_hours=1, max_news_items=2)
    strict = {r.us: [x.document_id for x in r.news] for r in decisions.news_before(cuts, decisions.news_items(docs, [MARKET], True), cfg).collect()}
    assert strict == {1735689600_000000 + HOUR: ["d1"], 1735689600_000000: []}
    loose = {r.us: [x.document_id for x in r.news] for r in decisions.news_before(cuts, decisions.news_items(docs, [MARKET], False), cfg).collect()}
    assert loose[1735689600_000000 + HOUR] == ["d4", "d3"]


PLAN = {"selection_basis": "source_schedule", "release_urls": ["https://www.federalreserve.gov/newsevents/pressreleases/monetary20250101a.htm", "https://www.federalreserve.gov/newsevents/pressreleases/monetary20250102a.htm"]}


def test_capture_cycles(spark, tmp_path):
    from tidemark.streaming import capture as stream

    root, pages = f"file://{tmp_path}/cap", {"20250101": NAMED, "20250102": "<p>broken"}

    def fetcher(url):
        return pages[url[-13:-5]].encode(), {"status": 200, "final_url": url}

    first = stream.cycle(spark, PLAN, root, fetcher)
    assert (first["status"], first["records_added"]) == ("partial_or_failed", 1)
    pages["20250102"] = TALLIED
    second = stream.cycle(spark, PLAN, root, fetcher)
    assert (second["status"], second["records_added"], second["unchanged_documents"]) == ("complete", 1, 1)
    usable = {r.document_id: r.usable_at for r in spark.read.parquet(f"{root}/information").collect()}
    pages["20250101"] = NAMED.replace("Body", "Other")
    stream.cycle(spark, PLAN, root, fetcher)
    pages["20250101"] = NAMED  # back to the first text: no new record, no new time
    last = stream.cycle(spark, PLAN, root, fetcher)
    assert last["records_added"] == 0 and last["documents"] == 3
    now = {r.document_id: r.usable_at for r in spark.read.parquet(f"{root}/information").collect()}
    assert all(now[k] == v for k, v in usable.items())
    report = stream.audit(spark, root)
    assert report["validation_status"] == "passed" and report["records"] == 3 and len(report["events"]) == 2
    assert spark.read.parquet(f"{root}/observations").count() == 8


def test_stream_and_batch_first_versions_agree(spark):
    from tidemark.plans import queries

    got = {(r.key, r.doc_id) for r in queries.q_stream_canonical(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.concat_ws("|", "source", "lang").alias("key"), "doc_id", F.pmod(F.col("doc_id") * 7919, F.lit(100003)).alias("arrival"))
    want = {(r.key, r.f.doc_id) for r in docs.groupBy("key").agg(F.min(F.struct("arrival", "doc_id")).alias("f")).collect()}
    assert got == want


def test_violations_name_the_broken_rules(spark):
    rows = spark.createDataFrame([("d", "2025-01-01T00:00:00Z", "2025-01-01T00:00:02Z")], "document_id string, usable_at string, received_at string")
    full = rows.select(
        "*", *[F.lit("2025-01-01T00:00:00Z").alias(c) for c in capture.CLOCKS if c not in rows.columns], F.lit("other").alias("schema"), F.lit("collector_observation").alias("availability_basis"), F.lit("https://evil.com/").alias("source_url"),
        F.lit("h").alias("source_release_claim"), F.lit("t").alias("verified_text"), F.sha2(F.lit("t").cast("binary"), 256).alias("text_sha256"), F.lit("source_schedule").alias("discovery_mode"), F.lit(None).cast("string").alias("historical_usable_at"),
        F.lit("p").alias("plan_sha256"), F.lit("raw/x").alias("raw_path"), F.lit("y").alias("raw_sha256"), F.lit("e").alias("information_event_id"), F.lit(None).cast("string").alias("content_version_id"),
    )
    plans = spark.createDataFrame([], "recorded_at string, plan_sha256 string, own_sha256 string, selection_basis string")
    found = capture.violations(full, plans, spark.createDataFrame([], "raw_path string, content binary")).first().errors
    assert set(found) == {"schema", "clock order", "source", "plan", "snapshot", "header", "event"}


def test_cutoffs_need_an_offset(spark):
    rows = spark.createDataFrame([("a", "2025-01-01T00:00:00Z", []), ("b", "2025-01-01T02:00:00+01:00", []), ("c", "2024-01-01T00:00:00Z", ["plan"])], "document_id string, usable_at string, errors array<string>")
    assert [r.document_id for r in capture.eligible_before(rows, "2025-01-01T02:30:00+02:00").collect()] == ["a"]
    with pytest.raises(Exception, match="offset"):
        capture.eligible_before(rows, "2025-01-01T02:30:00").collect()


def test_demo_run_end_to_end(spark, tmp_path):
    from tidemark.plans import pipelines

    writers.write_table(readers.demo_fills(spark), f"{tmp_path}/trades.parquet")
    markets = [{"market_id": m, "question": "q", "search_queries": ["one"], "required_term_groups": [["Inter"]]} for m in ("demo-a", "demo-b")]
    (tmp_path / "config.json").write_text(json.dumps({"data_path": f"{tmp_path}/trades.parquet", "output_dir": f"{tmp_path}/out", "markets": markets}))
    config = RunConfig.load(str(tmp_path / "config.json"))
    docs = spark.createDataFrame([(*doc(1, "2025-09-14T05:00:00Z"), ["demo-a"])], DOC + ", market_ids array<string>")
    status = pipelines.pilot(spark, config, docs)
    assert status["analyze"]["audit"]["valid_rows"] == 2 * 854 * 4 and status["analyze"]["episodes"] >= 1
    assert sum(r["decision_rows"] for r in status["dc"]) == 2 * 854 * 4
    page = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/out/report_html").collect())
    assert page.startswith("<!doctype html>") and page.count("<h2>") == len({e["market_id"] for e in json.loads(status["render"])}) and page.count("<details") == len(json.loads(status["render"]))
    assert page.count("<svg") == page.count("<h2>") and page.index("<svg") < page.index("<details")
    assert page.index("<h2>") < page.index("<details") and spark.read.text(f"{tmp_path}/out/review_template").count() == spark.read.parquet(f"{tmp_path}/out/links").count()
    with pytest.raises(Exception):
        pipelines.analyze(spark, config)  # a non-empty output is not overwritten
    summary = pipelines.fine(spark, config, f"{tmp_path}/fine")
    assert {m["market_id"] for m in summary["markets"]} == {"demo-a", "demo-b"}


def test_seed_run_and_extract(spark, tmp_path):
    from tidemark.plans import pipelines

    writers.write_table(readers.demo_fills(spark), f"{tmp_path}/trades.parquet")
    ids = ["demo-a", "demo-b"]
    (tmp_path / "config.json").write_text(json.dumps({"data_path": f"{tmp_path}/trades.parquet", "output_dir": f"{tmp_path}/out", "markets": [{"market_id": m, "question": "q", "required_term_groups": [["Inter"]]} for m in ids]}))
    (tmp_path / "meta.json").write_text(json.dumps([{"id": m, "question": "q", "answer1": "yes", "answer2": "no"} for m in ids]))
    (tmp_path / "manifest.json").write_text('{"status": "complete"}')
    config = RunConfig.load(str(tmp_path / "config.json"))
    docs = spark.createDataFrame([doc(1, "2025-09-14T05:00:00Z"), doc(2, None)], DOC)
    status = pipelines.seed(spark, config, docs, f"{tmp_path}/meta.json", f"{tmp_path}/manifest.json")
    assert sum(r["decision_rows"] for r in status["dc"]) == spark.read.parquet(f"{tmp_path}/out/candidates").count() == 2 * 854 * 4
    links = spark.read.parquet(f"{tmp_path}/out/links")
    assert {r.document_id for r in links.collect()} <= {"d1"}  # undated documents count only where they list episodes
    assert status["unattributed"] == status["analyze"]["episodes"] - links.select("episode_id").distinct().count()
    with pytest.raises(ValueError, match="verified"):
        pipelines.seed(spark, config, spark.createDataFrame([doc(1, verified=True)], DOC))
    (tmp_path / "meta.json").write_text(json.dumps([{"id": m, "question": "another", "answer1": "yes", "answer2": "no"} for m in ids]))
    with pytest.raises(ValueError, match="metadata"):
        pipelines.seed(spark, config, docs, f"{tmp_path}/meta.json")
    (tmp_path / "manifest.json").write_text('{"status": "running"}')
    with pytest.raises(ValueError, match="complete"):
        pipelines.seed(spark, config, docs, None, f"{tmp_path}/manifest.json")

    whole = readers.demo_fills(spark)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in readers.FILL_SCHEMA if f.name not in whole.columns]
    whole.select("*", *missing).write.parquet(f"{tmp_path}/all.parquet")
    spark.createDataFrame([(m,) for m in ids], "id string").write.parquet(f"{tmp_path}/markets.parquet")
    found = pipelines.extract(spark, f"{tmp_path}/markets.parquet", f"{tmp_path}/all.parquet", ["demo-a"], f"{tmp_path}/extract")
    assert found["status"] == readers.read_manifest(spark, f"{tmp_path}/extract")["status"] == "complete" and [m["rows"] for m in found["markets"]] == [854 * 4]
    times = [r.timestamp for r in spark.read.parquet(f"{tmp_path}/extract/trades.parquet").select("timestamp").collect()]
    assert times == sorted(times)
    with pytest.raises(ValueError, match="already"):
        pipelines.extract(spark, f"{tmp_path}/markets.parquet", f"{tmp_path}/all.parquet", ["demo-a"], f"{tmp_path}/extract")


def test_strict_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n[oops\n')
    assert readers.read_jsonl(spark, f"{tmp_path}/none.jsonl", "x int").count() == 0
    assert readers.read_jsonl(spark, f"{tmp_path}/a.jsonl", "x int", strict=True).count() == 2
    with pytest.raises(Exception, match="malformed JSON"):
        readers.read_jsonl(spark, f"{tmp_path}/b.jsonl", "x int", strict=True).collect()
    with pytest.raises(FileNotFoundError):
        readers.load_fills(spark, f"{tmp_path}/none.csv", ["m"])
    with pytest.raises(Exception, match="finite"):
        writers.json_lines(spark.range(1).select(F.lit(float("nan")).alias("v"))).collect()


def test_feed_rules():
    feed = """<?xml version="1.0"?><!-- c --><rss version="2.0"><channel><title>f</title>
      <item><title> A </title><link>https://a.com/1?utm_source=x</link><pubDate>Wed, 01 Jan 2025 08:00:00</pubDate><source url="https://s.com">S</source></item>
      <item><title></title><link>https://a.com/2</link></item><item><title>B</title><link>ftp://a.com/3</link></item></channel></rss>"""
    assert text.rss_items(feed) == [{"title": "A", "url": "https://a.com/1", "published_date": None, "source": "S", "publisher_homepage": "https://s.com"}]
    title, host = text.STATEMENT_TITLE, "https://" + text.FED_HOST
    item = "<item><title>{}</title><link>{}</link></item>"
    links = [host + f"/newsevents/pressreleases/monetary2025{n}a.htm" for n in ("0129", "0319", "0129")] + [host + "/other.htm"]
    page = "<rss><channel>" + "".join(item.format(title, x) for x in links) + item.format("Minutes", "https://elsewhere.org/x") + "</channel></rss>"
    assert text.feed_links(page.encode()) == sorted(set(links[:3])) and text.feed_links(b"<rss><channel/></rss>") == []
    with pytest.raises(ValueError):
        text.feed_links(page.replace("Minutes", title).encode())


def test_paragraphs_of_malformed_markup_take_linear_time():
    import time

    for unit in ("<a ", '<a "', "<!--", "<p"):
        start = time.perf_counter()
        text.paragraph_list(unit * (1_000_000 // len(unit)))
        assert time.perf_counter() - start < 2
    assert text.paragraph_list("<p>a <b and more") == ["a <b and more"] and text.paragraph_list("<p>a<p>b <!-- c") == ["a", "b"]


def test_snapshots_find_what_a_capture_stored(spark, tmp_path):
    from tidemark.sources.readers import snapshots

    rows = [("raw/1.bin", "s", bytearray(b"x")), ("raw/1.bin", "s", bytearray(b"x")), ("raw/2.bin", "t", bytearray(b"y"))]
    spark.createDataFrame(rows, "raw_path string, raw_sha256 string, content binary").write.parquet(str(tmp_path / "raw"))
    assert sorted((r.raw_path, bytes(r.content)) for r in snapshots(spark, str(tmp_path)).collect()) == [("raw/1.bin", b"x"), ("raw/2.bin", b"y")]


def test_relevant_pairs_of_whole_relevance(spark):
    from tidemark.functions.columns import relevant_pairs

    rows = spark.createDataFrame([("a", "Inter UEFA"), ("b", "Inter")], "id string, t string")
    assert [r.id for r in relevant_pairs(rows, F.col("t"), [MARKET], whole=True).collect()] == ["a"]
