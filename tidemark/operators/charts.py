"""Price lines for reports: reduced to what a chart of a given width shows, then drawn as SVG."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import html_escape


def line_columns(line: DataFrame, width: int = 800) -> DataFrame:
    """line (market_id, us, value; a null value is a gap) reduced to the first, last, lowest and highest point and the first gap of each of width
    columns of time: at most five points a column, and a line through them covers the same pixels as one through all. Of equal values the earliest counts.

    Each column is an aggregate, so no market's line is gathered before it is small. Also gives `at`, the place of the point between 0 and width.
    """
    ends = line.groupBy("market_id").agg(F.min("us").alias("_low"), F.max("us").alias("_high"))
    at = (F.col("us") - F.col("_low")) * F.lit(float(width)) / (F.col("_high") - F.col("_low") + 1)
    placed = line.join(ends, "market_id").withColumn("at", at)
    own = F.when(F.col("value").isNotNull(), F.struct("us", "value", "at"))
    low = F.when(F.col("value").isNotNull(), F.struct("value", "us", "at"))
    high = F.when(F.col("value").isNotNull(), F.struct((-F.col("value")).alias("value"), "us", "at"))
    gap = F.when(F.col("value").isNull(), F.struct("us", "value", "at"))
    columns = placed.groupBy("market_id", F.floor("at").alias("_column")).agg(F.min(own).alias("first"), F.max(own).alias("last"), F.min(low).alias("low"), F.min(high).alias("high"), F.min(gap).alias("gap"))
    point = [F.struct(f"{name}.us", (-F.col("high.value") if name == "high" else F.col(f"{name}.value")).alias("value"), f"{name}.at") for name in ("first", "last", "low", "high", "gap")]
    points = columns.select("market_id", F.explode(F.array_distinct(F.array(*point))).alias("p")).where("p.us is not null")
    return points.select("market_id", "p.us", "p.value", "p.at")


def line_charts(line: DataFrame, width: int = 800, height: int = 160) -> DataFrame:
    """(market_id, html): an SVG of each market's line between 0 and 1, broken at gaps. A market has at most five points a column, so one row holds them."""
    points = line_columns(line, width)
    before = F.lag("value").over(Window.partitionBy("market_id").orderBy("us"))
    step = F.concat(F.when(before.isNull(), F.lit("M")).otherwise(F.lit("L")), F.round("at", 1).cast("string"), F.lit(" "), F.round((1 - F.col("value")) * height, 1).cast("string"))
    steps = points.withColumn("step", F.when(F.col("value").isNotNull(), step))
    paths = steps.groupBy("market_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("us", "step")))), lambda s: s["step"]), " ").alias("path"))
    html = F.concat(F.lit(f'<svg viewBox="0 0 {width} {height}" role="img" aria-label="'), html_escape(F.concat(F.lit("price of "), F.col("market_id"))), F.lit('"><path fill="none" stroke="currentColor" d="'), F.col("path"), F.lit('"/></svg>'))
    return paths.select("market_id", html.alias("html"))
