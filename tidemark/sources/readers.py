"""Readers of fills, line-delimited JSON, market metadata, runs and raw snapshots."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import Market, RunConfig
from tidemark.functions.columns import schema_of

#: The columns of raw fills; ids are text, whatever they look like.
FILL_SCHEMA = schema_of(
    "timestamp string, block_number long, transaction_hash string, log_index long, contract string, market_id string, condition_id string, event_id string, nonusdc_side string, maker string, taker string, "
    "price double, usd_amount double, token_amount double, maker_direction string, taker_direction string, asset_id string"
)
TEXT_IDS = ("market_id", "asset_id", "transaction_hash")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_fills(spark: SparkSession, path: str, market_ids: Sequence[str]) -> DataFrame:
    """CSV, gzipped CSV or Parquet (file or folder), with the market filter pushed to the scan."""
    low = path.lower().rstrip("/")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if low.endswith((".csv", ".csv.gz")):
        header = spark.read.option("header", True).csv(path).columns  # reads the first line only
        known = {f.name: f.dataType for f in FILL_SCHEMA}
        schema = T.StructType([T.StructField(c, T.StringType() if c in TEXT_IDS else known.get(c, T.StringType())) for c in header])
        rows = spark.read.schema(schema).option("header", True).csv(path)
    elif low.endswith(".parquet") or "." not in os.path.basename(low):
        rows = spark.read.parquet(path)
    else:
        raise ValueError(f"neither CSV nor Parquet: {path}")
    return rows.where(F.col("market_id").isin(*market_ids))


def extract(spark: SparkSession, markets_source: str, fills_source: str, market_ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(market rows, fills of 17 columns) of the given markets from Parquet at any URL Spark reads; filters and columns are pushed down."""
    markets = spark.read.parquet(markets_source).where(F.col("id").isin(*market_ids))
    return markets, spark.read.parquet(fills_source).select(*FILL_SCHEMA.fieldNames()).where(F.col("market_id").isin(*market_ids))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """Rows of line-delimited JSON; a missing file has none and blank lines are skipped. With strict, a malformed line is an error that names path and text."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        return spark.createDataFrame([], kind)
    if not strict:
        return spark.read.schema(kind).json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", kind.add("_bad", T.StringType()) if "_bad" not in kind.names else kind, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.ltrim("value").startswith("{")
    checked = F.when(broken, F.raise_error(F.concat(F.lit(f"{path}: malformed JSON: "), F.substring("value", 1, 80))).cast(parsed.schema["r"].dataType)).otherwise(F.col("r"))
    return parsed.select(checked.alias("r")).select(*[f"r.{n}" for n in kind.names if n != "_bad"])


def check_markets(spark: SparkSession, metadata: str, markets: Sequence[Market], fold_case: bool = True) -> None:
    """Question and answer labels of the configured markets must agree with the metadata file (JSON list: id, question, answer1, answer2)."""
    known = spark.read.option("multiLine", True).json(metadata).select(F.col("id").cast("string").alias("market_id"), F.col("question").alias("q"), *[F.col(f"answer{k}").alias(f"a{k}") for k in (1, 2)])
    mine = spark.createDataFrame([(m.market_id, m.question, m.outcome1_label, m.outcome2_label) for m in markets], "market_id string, question string, l1 string, l2 string")
    fold = F.lower if fold_case else (lambda c: c)
    same = (F.col("q") == F.col("question")) & (fold(F.col("a1")) == fold(F.col("l1"))) & (fold(F.col("a2")) == fold(F.col("l2")))
    wrong = [r["market_id"] for r in mine.join(known, "market_id", "left").where(~F.coalesce(same, F.lit(False))).select("market_id").collect()]
    if wrong:
        raise ValueError(f"metadata disagrees for markets {sorted(wrong)}")


def check_manifest(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        manifest = json.load(f)
    if manifest.get("status") != "complete":
        raise ValueError("the extraction isn't complete")
    return manifest


def absent_markets(rows: DataFrame, markets: Sequence[Market]) -> list[str]:
    """Configured markets without a row."""
    mine = rows.sparkSession.createDataFrame([(m.market_id,) for m in markets], "market_id string")
    return sorted(r["market_id"] for r in mine.join(rows.select("market_id"), "market_id", "left_anti").collect())


def read_run(spark: SparkSession, config: RunConfig) -> tuple[DataFrame, DataFrame]:
    """(bars, episodes) of the run in the output folder; an error if the configuration has changed since."""
    manifest = read_manifest(spark, config.output_dir)
    if manifest["config_sha256"] != config.hash:
        raise ValueError("the configuration has changed since this run")
    return spark.read.parquet(f"{config.output_dir}/bars"), spark.read.parquet(f"{config.output_dir}/episodes")


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest", wholetext=True).first()["value"])


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """raw_path and content of the snapshots that captures have stored, one for each path; only those below the capture root can appear. Files named by their hash, and Parquet tables of older logs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(f"{root}/raw")
    named = files.select(F.concat(F.lit("raw/"), F.element_at(F.split("path", "/"), -1)).alias("raw_path"), "content")
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/raw")
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if any(listed.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/raw/{p}")) for p in ("*.parquet", "batch=*")):
        table = spark.read.option("pathGlobFilter", "*.parquet").parquet(f"{root}/raw")
        named = named.unionByName(table.select("raw_path", "content"))
    return named.dropDuplicates(["raw_path"])


def demo_fills(spark: SparkSession) -> DataFrame:
    """Two markets, 864 five-minute slots of four fills with a hole at slots 700-709 and price steps at 360 and 600; a fixed function of the slot."""
    grid = spark.range(864).where("id < 700 or id > 709").crossJoin(F.broadcast(spark.createDataFrame([("demo-a", 0), ("demo-b", 1)], "market_id string, m int"))).crossJoin(F.broadcast(spark.range(4).withColumnRenamed("id", "k")))
    noise = (F.pmod(F.xxhash64("id", "m", "k"), F.lit(2001)) - 1000) / 500000.0
    level = F.lit(0.35) + 0.12 * (F.col("id") >= 360).cast("double") * (F.col("m") == 0).cast("double") - 0.08 * (F.col("id") >= 600).cast("double")
    price = F.round(level + noise, 6)
    return grid.select(
        "market_id", (F.lit(1757721600) + F.col("id") * 300 + F.col("k") * 60).cast("string").alias("timestamp"), price.alias("price"), (F.lit(50.0) + 10 * F.col("k")).alias("token_amount"),
        (price * (F.lit(50.0) + 10 * F.col("k"))).alias("usd_amount"), F.lit("token1").alias("nonusdc_side"), F.concat_ws("-", F.lit("tx"), "m", "id", "k").alias("transaction_hash"), F.lit(0).cast("long").alias("log_index"),
        F.concat(F.lit("taker"), F.pmod("id", F.lit(7))).alias("taker"), F.lit("maker").alias("maker"), F.lit("BUY").alias("taker_direction"),
    )
