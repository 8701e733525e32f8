"""Sinks: tables, sorted Parquet, JSON lines, manifests, raw snapshots."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import RunConfig
from tidemark.functions.columns import html_escape, safe_json

NESTED = ("array", "map", "struct")


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet; a non-empty target is an error unless overwrite is given."""
    if overwrite:
        replace_table(df, path)
    else:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def replace_path(spark: SparkSession, new: str, path: str) -> None:
    """Puts a finished file or folder in the place of an old one by renaming. Until then the old one stays whole; if the last rename fails, it is put back."""
    jvm = spark._jvm
    target, fresh, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, f"{path}.old-{uuid.uuid4().hex}"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"{path} can't be moved aside")
    moved = False
    try:
        moved = fs.rename(fresh, target)
    finally:
        if not moved and had:
            fs.rename(aside, target)
    if not moved:
        raise OSError(f"{new} can't be renamed to {path}")
    if had:
        fs.delete(aside, True)


def replaced(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> None:
    """Writes df under a temporary name beside path, then renames it: a write that fails leaves what was there, and df may read path itself."""
    spark = df.sparkSession
    folder, _, name = path.rstrip("/").rpartition("/")
    temporary = f"{folder}/.{name}.new-{uuid.uuid4().hex}"
    try:
        write(df, temporary)
        replace_path(spark, temporary, path.rstrip("/"))
    finally:
        left = spark._jvm.org.apache.hadoop.fs.Path(temporary)
        left.getFileSystem(spark._jsc.hadoopConfiguration()).delete(left, True)


def replace_table(df: DataFrame, path: str) -> None:
    replaced(df, path, lambda rows, at: rows.write.option("compression", "zstd").parquet(at))


def write_sorted(df: DataFrame, path: str, order: list[str], overwrite: bool = False) -> None:
    """Globally sorted zstd Parquet: ranges across files, sorted within."""
    write_table(df.repartitionByRange(*order).sortWithinPartitions(*order), path, overwrite)


def json_lines(df: DataFrame, sorted_keys: bool = True) -> DataFrame:
    """One JSON text for each row; NaN and infinities are an error."""
    bad = [F.col(c).isNotNull() & (F.isnan(c) | (F.abs(F.col(c)) == float("inf"))) for c, kind in df.dtypes if kind in ("double", "float")]
    columns = sorted(df.columns) if sorted_keys else df.columns
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    for b in bad:
        text = F.when(b, F.raise_error(F.lit("not a finite number"))).otherwise(text)
    return df.select(text.alias("value"))


def write_jsonl(df: DataFrame, path: str, gzip: bool = False, sorted_keys: bool = True) -> None:
    writer = json_lines(df, sorted_keys).write.mode("overwrite")
    (writer.option("compression", "gzip") if gzip else writer).text(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    json_lines(df, sorted_keys=False).write.mode("append").text(path)


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns dropped, but arrays of plain values joined by commas."""
    out = []
    for c, kind in df.dtypes:
        if kind.startswith("array<") and not any(n in kind[6:] for n in NESTED):
            out.append(F.concat_ws(",", F.col(c).cast("array<string>")).alias(c))
        elif not kind.startswith(NESTED):
            out.append(F.col(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, gzip: bool = True) -> None:
    flattened(df).write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """Order-insensitive: row count, exclusive or, and sum of row hashes."""
    h = F.xxhash64(*columns)
    r = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 40))).alias("s")).first()
    return f"{r['n']}-{r['x'] or 0}-{r['s'] or 0}"


def write_run(spark: SparkSession, config: RunConfig, bars: DataFrame, episodes: DataFrame, audit: DataFrame, overwrite: bool = False) -> dict:
    """bars and episodes as Parquet, CSV and JSON lines, then a manifest that ties them to the configuration."""
    root = config.output_dir
    write_table(bars, f"{root}/bars", overwrite)
    write_table(episodes, f"{root}/episodes", overwrite)
    bars, episodes = spark.read.parquet(f"{root}/bars"), spark.read.parquet(f"{root}/episodes")
    write_csv(bars, f"{root}/bars_csv")
    write_jsonl(episodes, f"{root}/episodes_jsonl")
    coverage = bars.groupBy("market_id").agg(F.count("*").alias("bars"), F.min("bin_us").alias("first_us"), F.max("bin_us").alias("last_us"), F.count_if("baseline_ready").alias("baseline_ready"))
    manifest = {
        "config_sha256": config.hash, "audit": audit.first().asDict(), "bars": bars.count(), "episodes": episodes.count(), "coverage": [r.asDict() for r in coverage.orderBy("market_id").collect()],
        "bars_fingerprint": fingerprint(bars, ["market_id", "bin_us", "price", "record_count"]),
    }
    write_json(spark, f"{root}/manifest", manifest)
    return manifest


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    replaced(spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1), path, lambda rows, at: rows.write.text(at))


def _store(batches, folder: str):
    """Writes each content to the file of its hash, or verifies the file that is there; one row for each content."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    for batch in batches:
        paths = []
        for value in batch.column(0):
            content = value.as_buffer()
            name = f"{hashlib.sha256(content).hexdigest()}.bin"
            path = f"{root}/{name}"
            if files.get_file_info(path).type == fs.FileType.NotFound:
                # Written aside and renamed: a reader never sees half a file, and of two writers of one hash either may win, with the same bytes.
                aside = f"{root}/.{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(aside) as out:
                    out.write(content)
                files.move(aside, path)
            with files.open_input_stream(path) as held:
                digest = hashlib.sha256()
                while part := held.read(1 << 20):
                    digest.update(part)
            if f"{digest.hexdigest()}.bin" != name:
                raise ValueError(f"{path} does not hold what its name says")
            paths.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["name"])


def store_snapshots(df: DataFrame, path: str) -> int:
    """Content-addressed raw store: executors write each distinct content to `path/<sha256>.bin` once and verify what is there already, so a replay adds nothing and a changed file is an error. df: content; returns how many contents there were."""
    if "://" not in path:
        path = "file://" + os.path.abspath(path)
    return df.where("content is not null").select(F.col("content").cast("binary").alias("content")).dropDuplicates().mapInArrow(partial(_store, folder=path), "name string").count()


def report_json(df: DataFrame, limit: int = 100) -> str:
    """The first rows as a JSON list that may stand inside HTML."""
    rows = json_lines(df.limit(limit)).select(safe_json(F.col("value")).alias("value")).collect()
    return "[" + ",".join(r["value"] for r in rows) + "]"


def write_report(cards: DataFrame, path: str, title: str, charts: DataFrame | None = None) -> None:
    """One HTML page of episode cards (market_id, detected_us, episode_id, html) under a heading, and a chart (market_id, html) if given, for each market.

    The page is one text file, so cards are those of a bounded choice of episodes (`top_episodes`).
    """
    spark = cards.sparkSession
    part = cards.select(F.lit(1).alias("part"), "market_id", "detected_us", "episode_id", "html")
    markets = cards.select("market_id").distinct()
    markets = markets.withColumn("chart", F.lit("")) if charts is None else markets.join(charts.select("market_id", F.col("html").alias("chart")), "market_id", "left")
    head = F.concat(F.lit("<h2>"), html_escape(F.col("market_id")), F.lit("</h2>"), F.coalesce("chart", F.lit("")))
    heads = markets.select(F.lit(1).alias("part"), "market_id", F.lit(None).cast("long").alias("detected_us"), F.lit("").alias("episode_id"), head.alias("html"))
    frame = spark.range(2).select((F.col("id") * 2).cast("int").alias("part"), F.lit("").alias("market_id"), F.lit(None).cast("long").alias("detected_us"), F.lit("").alias("episode_id"), F.when(F.col("id") == 0, F.concat(F.lit('<!doctype html><meta charset="utf-8"><title>'), html_escape(F.lit(title)), F.lit("</title>"))).otherwise("<!-- end -->").alias("html"))
    page = part.unionByName(heads).unionByName(frame)
    page.coalesce(1).sortWithinPartitions("part", "market_id", F.asc_nulls_first("detected_us"), "episode_id").select(F.col("html").alias("value")).write.mode("overwrite").text(path)
