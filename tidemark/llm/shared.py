"""Shared-folder tables and small helpers for the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words and lines everywhere here: [\x20\x09-\x0D].
SPACE_CLASS = r"[\x20\x09-\x0D]"

_OWN_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application, unless they find it on their path."""
    context = spark.sparkContext
    home = Path(__file__).resolve().parents[2]
    on_path = any(Path(p or ".").resolve() == home for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)])
    if on_path or context.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((home / "tidemark").rglob("*.py")):
            out.write(file, file.relative_to(home))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent (tests on one machine) is a temporary folder used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _OWN_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _OWN_FOLDERS[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_hash(name: str = "text") -> Column:
    """Tells the texts of rows with one doc_id apart."""
    return F.xxhash64(text_or_empty(name))


def row_key(doc_id: str, text: Column) -> Column:
    """A row by its id, which may be null, and its text_hash; rows that repeat both have one key."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("null")), text)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(n_folds: int, name: str = "doc_id"):
    """crc32 of the id as text, modulo n_folds; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % n_folds, F.lit(0))


#: DuckDB: a list of the 256 values of the CRC-32 of a byte, and the CRC-32 of an ASCII text {0} with that list in {1}.
CRC_TABLE_SQL = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(({1})[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
