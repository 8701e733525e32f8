"""Windows without hot keys: long series are cut into time chunks with a halo.

A window over one market, or one actor, would put the whole series into one task. `with_halo` repeats the rows just before a chunk in it, so frames of
bounded width are computed by (key, chunk); `carried` hands totals of unbounded frames from chunk to chunk with one row for each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK, OWN = "_chunk", "_own"


def with_halo(df: DataFrame, us: str, chunk: int, halo: int) -> DataFrame:
    """Rows with _chunk; rows of the halo before a chunk come again with _own false. us, chunk and halo in microseconds."""
    if chunk < halo:
        raise ValueError("a chunk must be at least as long as its halo")
    home = F.floor(F.col(us) / F.lit(chunk))
    last = F.floor((F.col(us) + F.lit(halo)) / F.lit(chunk))
    return df.withColumn("_home", home).withColumn(CHUNK, F.explode(F.sequence("_home", last))).withColumn(OWN, F.col(CHUNK) == F.col("_home")).drop("_home")


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(OWN).drop(CHUNK, OWN)


def chunk_window(keys: Sequence[str], us: str):
    return Window.partitionBy(*keys, CHUNK).orderBy(us)


#: A busy chunk is cut into so many parts of about equal size.
PARTS = 64


def even_cuts(rows: DataFrame, key: str, us: str, chunk: int, most: int = 1_000_000) -> DataFrame:
    """(_ck, _cb, _cuts): for each chunk of a key with more than `most` rows the times at which it is cut into PARTS of about equal size, by approximate quantiles.

    Only key and time are read, and counts and quantile sketches are combined before the shuffle. The result has a row for each busy chunk.
    """
    base = F.floor(F.col(us) / F.lit(chunk))
    quantiles = F.percentile_approx(us, [k / PARTS for k in range(1, PARTS)], 10 * PARTS)
    busy = rows.groupBy(F.col(key).alias("_ck"), base.alias("_cb")).agg(F.count(F.lit(1)).alias("_n"), quantiles.alias("_cuts")).where(F.col("_n") > most)
    return busy.select("_ck", "_cb", F.array_distinct("_cuts").alias("_cuts"))


def placed(df: DataFrame, key: str, us: str, chunk: int, cuts: DataFrame | None = None) -> DataFrame:
    """df with _chunk, the time at which its part of the time line begins: a fixed chunk, or a part of a busy one. Rows of one time stay together."""
    start = F.floor(F.col(us) / F.lit(chunk)) * F.lit(chunk)
    if cuts is None:
        return df.withColumn(CHUNK, start)
    found = df.join(cuts, F.col(key).eqNullSafe(F.col("_ck")) & (F.floor(F.col(us) / F.lit(chunk)) == F.col("_cb")), "left")
    part = F.array_max(F.filter("_cuts", lambda c: c <= F.col(us)))
    return found.withColumn(CHUNK, F.greatest(start, F.coalesce(part, start))).drop("_ck", "_cb", "_cuts")


def asof_before(probe: DataFrame, state: DataFrame, key: str, us: str, payload: Sequence[str], chunk: int, cuts: DataFrame | None = None) -> DataFrame:
    """probe with the payload of the last state row of the same key at a strictly earlier time (null where there is none).

    Within a chunk: union and last(); before it: the last state row of each earlier chunk, one row for each chunk. cuts: of busy chunks (`even_cuts` of probe and state).
    """
    item = F.struct(*[F.col(c) for c in (us, *payload)])
    p = probe.select(F.col(key).alias("_k"), F.col(us).alias("_t"), F.lit(0).alias("_kind"), F.struct(*probe.columns).alias("_p"))
    s = state.select(F.col(key).alias("_k"), F.col(us).alias("_t"), F.lit(1).alias("_kind"), item.alias("_s"))
    both = p.withColumn("_s", F.lit(None).cast(s.schema["_s"].dataType)).unionByName(s.withColumn("_p", F.lit(None).cast(p.schema["_p"].dataType)))
    both = placed(both, "_k", "_t", chunk, cuts)
    w = Window.partitionBy("_k", CHUNK).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_near", F.last("_s", ignorenulls=True).over(w)).where("_kind = 0")
    ends = both.groupBy("_k", CHUNK).agg(F.max("_s").alias("_end"))
    before = Window.partitionBy("_k").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).select(F.col("_k").alias("_ck"), F.col(CHUNK).alias("_cc"), "_carried")
    found = near.join(ends, near["_k"].eqNullSafe(F.col("_ck")) & (near[CHUNK] == F.col("_cc")), "left")
    return found.select("_p.*", F.coalesce("_near", "_carried").alias("_state")).select(*probe.columns, *[F.col(f"_state.{c}").alias(f"state_{c}") for c in (us, *payload)])


def earlier_totals(df: DataFrame, key: str, us: str, amount: str, chunk: int, cuts: DataFrame | None = None, most: int = 1_000_000) -> DataFrame:
    """df with prior_count and prior_amount over rows of the same key at strictly earlier times. cuts: of busy chunks (`even_cuts` of df).

    Only a key with more than `most` rows is cut into chunks, so there are few of them; each of its chunks begins with one row of carried totals. Any other key is one chunk.
    """
    # Counted over the columns that are summed, so that one exchange below serves the counts and the totals.
    counts = [F.count(c).alias(f"_n{k}") for k, c in enumerate((F.lit(1), F.col(us), F.col(amount)))]
    busy = df.groupBy(F.col(key).alias("_bk")).agg(*counts).where(F.greatest("_n0", "_n1", "_n2") > most).select("_bk", F.lit(True).alias("_busy"))
    cut = placed(df, key, us, chunk, cuts).join(F.broadcast(busy), F.col(key).eqNullSafe(F.col("_bk")), "left").withColumn(CHUNK, F.when(F.col("_busy"), F.col(CHUNK)))
    sums = cut.where("_busy").groupBy(key, CHUNK).agg(F.count(F.lit(1)).alias("_cn"), F.sum(amount).alias("_ca"))
    before = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(key, CHUNK, (F.col(CHUNK) - 1).alias(us), F.sum("_cn").over(before).alias("_w"), F.sum("_ca").over(before).alias("_a"), F.lit(False).alias(OWN))
    both = cut.select(*df.columns, CHUNK, F.lit(1).cast("long").alias("_w"), F.col(amount).alias("_a"), F.lit(True).alias(OWN)).unionByName(carried, allowMissingColumns=True)
    strict = Window.partitionBy(key, CHUNK).orderBy(us).rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumns({"prior_count": F.coalesce(F.sum("_w").over(strict), F.lit(0).cast("long")), "prior_amount": F.coalesce(F.sum("_a").over(strict), F.lit(0.0))})
    return found.where(OWN).select(*df.columns, "prior_count", "prior_amount")
