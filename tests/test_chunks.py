"""Time chunks of a burst: even parts, and as-of states and running totals that don't depend on the cuts."""

import random

from pyspark.sql import functions as F

from tidemark.operators.chunks import CHUNK, asof_before, earlier_totals, even_cuts, placed

HOUR = 3_600_000_000


def burst(spark, n=60_000):
    """One market whose rows nearly all fall into one second of one hour, and a quiet one."""
    rows = spark.range(n, numPartitions=4).select(F.lit("m").alias("k"), (F.lit(5 * HOUR) + F.pmod(F.xxhash64("id"), F.lit(1_000_000))).alias("us"), F.col("id").alias("v"))
    quiet = spark.range(200).select(F.when(F.col("id") % 2 == 0, "q").alias("k"), (F.col("id") * (HOUR // 3)).alias("us"), F.col("id").alias("v"))
    return rows.unionByName(quiet)


def test_parts_of_a_burst_are_even(spark):
    rows = burst(spark)
    cuts = even_cuts(rows, "k", "us", HOUR, most=5000)
    assert cuts.count() == 1
    sizes = sorted(r["count"] for r in placed(rows.where("k = 'm'"), "k", "us", HOUR, cuts).groupBy(CHUNK).count().collect())
    assert len(sizes) > 32 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    quiet = placed(rows.where("k is null or k = 'q'"), "k", "us", HOUR, cuts).where(f"{CHUNK} != floor(us / {HOUR}) * {HOUR}")
    assert quiet.isEmpty()


def test_cuts_change_no_result(spark):
    rows = burst(spark, 3000).withColumn("amount", (F.col("v") % 7).cast("double"))
    rng = random.Random(3)
    state = spark.createDataFrame([("m", 5 * HOUR + rng.randrange(-1000, 1_000_000), k) for k in range(500)] + [("q", 3 * HOUR, 7)], "k string, us long, price long").dropDuplicates(["k", "us"])
    cuts = even_cuts(rows, "k", "us", HOUR, most=100)
    assert cuts.count() == 1
    for found in ([asof_before(rows, state, "k", "us", ["price"], HOUR, c) for c in (None, cuts)], [earlier_totals(rows, "k", "us", "amount", HOUR, c) for c in (None, cuts)]):
        plain, cut = (sorted(map(tuple, df.collect()), key=str) for df in found)
        assert plain == cut and len(plain) == 3200
    times = sorted((r.us, r.price) for r in state.where("k = 'm'").collect())
    for r in asof_before(rows.where("k = 'm'"), state, "k", "us", ["price"], HOUR, cuts).where("v % 50 = 0").collect():
        assert r.state_price == max(((t, p) for t, p in times if t < r.us), default=(None, None))[1]


def test_totals_of_quiet_keys_need_no_chunks(spark):
    """Busy keys go from chunk to chunk, quiet ones whole: the same totals, and no row of a quiet key is shuffled to be joined."""
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None, *"cdefgh"]) if k % 2 else "a", rng.randrange(0, 500), float(rng.randrange(9)) if rng.random() < 0.9 else None, k) for k in range(800)]
    rows = spark.createDataFrame(data, "k string, us long, v double, id int").repartition(3)
    want = {i: (sum(1 for q, t, _, _ in data if q == k and t < us), sum(v or 0.0 for q, t, v, _ in data if q == k and t < us)) for k, us, _, i in data}
    cuts = even_cuts(rows, "k", "us", 50, most=20)
    for most in (0, 100, 1000):
        for c in (None, cuts):
            assert {r.id: (r.prior_count, r.prior_amount) for r in earlier_totals(rows, "k", "us", "v", 50, c, most).collect()} == want
    found = earlier_totals(rows, "k", "us", "v", 50)
    found.collect()
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
