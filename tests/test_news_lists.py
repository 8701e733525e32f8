"""Lists of news before cut-offs: a fold over time chunks against brute force, and how many rows it takes."""

import random

from tidemark.config import ContextConfig
from tidemark.operators import decisions

HOUR = decisions.HOUR
CFG = ContextConfig(news_lookback_hours=6, max_news_items=3)


def tables(spark, seed=1, burst=False):
    rng = random.Random(seed)
    moment = lambda: rng.choice([0, -50, 400]) * HOUR + rng.randrange(0, 40 * HOUR, HOUR // (1 if rng.random() < 0.3 else 60))
    items = [(rng.choice("mn"), moment(), f"d{k}", None if rng.random() < 0.05 else f"u{rng.randrange(40)}", f"t{k}") for k in range(600)]
    cuts = [(k, rng.choice("mno"), moment()) for k in range(500)]
    if burst:
        items += [("m", 5 * HOUR + k, f"b{k}", f"v{k % 7}", "x") for k in range(3000)]
        cuts += [(1000 + k, "m", 5 * HOUR + k) for k in range(3000)]
    return items, cuts, spark.createDataFrame(items, "market_id string, available_us long, document_id string, url string, text string").repartition(3), spark.createDataFrame(cuts, "id long, market_id string, us long").repartition(3)


def brute(items, market, us):
    seen, out = set(), []
    for m, t, doc, url, text in sorted(items, key=lambda x: (x[1], x[2]), reverse=True):
        if m == market and us - 6 * HOUR <= t < us and url not in seen:
            seen.add(url)
            out.append((len(out) + 1, doc, url, text))
    return out[:3]


def test_lists_equal_brute_force(spark):
    items, cuts, item_rows, cut_rows = tables(spark)
    got = {r.id: [(x["rank"], x.document_id, x.url, x.text) for x in r.news] for r in decisions.news_before(cut_rows, item_rows, CFG).collect()}
    assert got == {k: brute(items, m, us) for k, m, us in cuts} and sum(map(len, got.values())) > 300


def test_one_cutoff(spark):
    items, cuts, item_rows, _ = tables(spark)
    for _, market, us in cuts[:5]:
        assert [(r.document_id, r.url) for r in decisions.eligible_news(item_rows, market, us, CFG).collect()] == [(doc, url) for _, doc, url, _ in brute(items, market, us)]


def test_no_pair_of_a_cutoff_and_an_item_is_formed(spark):
    """3,000 items and 3,000 cut-offs within a few milliseconds: as many rows as there are, and a few for each chunk."""
    items, cuts, item_rows, cut_rows = tables(spark, burst=True)
    events = decisions.news_events(cut_rows, item_rows, CFG)
    chunks = events.where(events.kind == decisions.CUT).select("market_id", "chunk").distinct().count()
    assert events.count() <= len(items) + len(cuts) + chunks * decisions.CHUNKS_A_LOOKBACK * CFG.max_news_items
    got = {r.id: [x.document_id for x in r.news] for r in decisions.news_before(cut_rows, item_rows, CFG).collect()}
    for k, market, us in random.Random(2).sample(cuts, 150):
        assert got[k] == [doc for _, doc, _, _ in brute(items, market, us)]


def test_nothing_to_list(spark):
    _, cuts, item_rows, cut_rows = tables(spark)
    assert {tuple(r.news) for r in decisions.news_before(cut_rows, item_rows.limit(0), CFG).collect()} == {()}
    assert decisions.news_before(cut_rows.limit(0), item_rows, CFG).count() == 0


def test_texts_take_no_part_in_the_fold(spark):
    """Neither the fold's rows nor the lists carry texts, and texts are joined to each distinct list once."""
    items, cuts, item_rows, cut_rows = tables(spark, seed=4)
    long_items, same = [(*x[:4], x[4] * 5000) for x in items], [(1000 + k, "m", 20 * HOUR + 1) for k in range(200)]
    item_rows, cut_rows = spark.createDataFrame(long_items, item_rows.schema), cut_rows.unionByName(spark.createDataFrame(same, cut_rows.schema))
    assert "text" not in decisions.news_events(cut_rows, item_rows, CFG).columns
    listed = {r.id: [(x.document_id, x.url) for x in r.news] for r in decisions.listed_before(cut_rows, item_rows, CFG).collect()}
    assert "text" not in decisions.listed_before(cut_rows, item_rows, CFG).schema["news"].dataType.elementType.names
    whole = {r.id: [(x["rank"], x.document_id, x.url, x.text) for x in r.news] for r in decisions.news_before(cut_rows, item_rows, CFG).collect()}
    assert whole == {k: brute(long_items, m, us) for k, m, us in cuts + same}
    assert listed == {k: [x[1:3] for x in v] for k, v in whole.items()}


def test_items_out_of_reach_are_not_carried(spark):
    far = [("m", (1000 + k) * HOUR, f"f{k}", f"w{k}", "x") for k in range(500)]
    near = [("m", 4 * HOUR, "near", "u", "x"), ("m", 10 * HOUR, "late", "u", "x")]
    item_rows, cut_rows = spark.createDataFrame(far + near, "market_id string, available_us long, document_id string, url string, text string"), spark.createDataFrame([(1, "m", 10 * HOUR)], "id long, market_id string, us long")
    assert decisions.news_events(cut_rows, item_rows, CFG).count() <= 1 + 2 + 1
    assert [x.document_id for x in decisions.news_before(cut_rows, item_rows, CFG).first().news] == ["near"]


def bundled(spark, places):
    names = "transaction_hash string, market_id string, taker string, nonusdc_side string, taker_direction string, at long, price_observed double, price_outcome1 double, token_amount double, usd_amount double"
    rows = [(f"x{k}", market, "u", "token1", "BUY", at, 0.5, 0.5, 1.0, 0.5) for k, (market, at) in enumerate(places)]
    items = [("m", 4 * HOUR, "d", "u", "x"), (None, 4 * HOUR, "e", "v", "x")]
    found = decisions.bundles(spark.createDataFrame(rows, names).selectExpr("* except (at)", "timestamp_micros(at) as timestamp"), check=False)
    return decisions.listed_before(found, spark.createDataFrame(items, "market_id string, available_us long, document_id string, url string, text string"), CFG)


def test_decisions_without_market_or_time_get_no_list(spark):
    listed = bundled(spark, [("m", 5 * HOUR), (None, 5 * HOUR), ("m", None), (None, None), ("n", 5 * HOUR), ("m", 9 * HOUR)])
    assert {r.transaction_hash: [x.document_id for x in r.news] for r in listed.collect()} == {"x0": ["d"], "x1": [], "x2": [], "x3": [], "x4": [], "x5": ["d"]}


def test_bundles_are_shuffled_once(spark, capsys):
    """Cut-offs, their chunks and the decisions that get lists come from one exchange of the bundles."""
    listed = bundled(spark, [("m", 5 * HOUR), ("m", 9 * HOUR)])
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1"), strict=True):  # the plan of large tables, with reused exchanges named
            spark.conf.set(k, v)
        listed.where("size(news) > 0").select("transaction_hash", "news").explain()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert capsys.readouterr().out.count("partial_min(") == 1
