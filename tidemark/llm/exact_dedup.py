"""Exact deduplication by an extendible-hash index on shared files, with DataFrame and SQL functions only.

1. Rows are pre-aggregated where they are read, by hash and whole normalised text: equal bytes meet, equal hashes
   with different bytes stay apart as links of a chain. Copies collapse before the shuffle, so a hot text costs one row a task.
2. The directory: a histogram of at most 2^max_depth hash prefixes goes to the driver, which doubles the directory while
   some bucket holds more than capacity entries and splits only the overfull ones; at the last depth a bucket overflows into its chain.
   Its 2^depth entries are a bound that doesn't grow with the data; it is stored beside the index.
3. Owner tasks write the entries of ascending bucket ranges, sorted by bucket, hash and chain link, as Parquet files in the shared folder.
4. Every document looks itself up by bucket and digest in a sort-merge join that adaptive execution can split on a hot text.
   Digests with a chain of several texts (none, unless the hash is weakened) are resolved by comparing whole texts.

Defined cases: null text is the empty text; of equal texts the longest original, then the smallest doc_id stays (a null doc_id comes last);
rows that repeat both doc_id and text get the same verdict in `dedup`, and one of them stays in `keep`; an empty table gives no rows;
other columns are ignored by `dedup` and kept by `keep`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import new_path, stored, text_or_empty

MAX_DEPTH = 12
CAPACITY = 1 << 16
#: Rank of a row within its group: code points first, then small ids; fits decimal(38, 0).
_STEP = "100000000000000000000"
_TOP = "9223372036854775808"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, hash_bits: int = 64, whole: bool = False) -> DataFrame:
    """doc_id, original length, normalised text, its SHA-256 and the index hash; with whole, also the row itself.

    hash_bits under 64 weakens both, for tests of chains.
    """
    row = [F.struct("*").alias("row")] if whole else []
    carried = ["row"] if whole else []
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t"), *row)
    t = t.select("doc_id", F.char_length("t").alias("n"), normalised(F.col("t")).alias("norm"), *carried)
    sha = F.sha2("norm", 256)
    hashed = F.xxhash64("norm")
    if hash_bits < 64:
        hashed = F.shiftleft(F.pmod(hashed, F.lit(1 << hash_bits)), 64 - hash_bits)
    key = sha if hash_bits == 64 else F.hex(hashed)
    return t.select("doc_id", "n", "norm", sha.alias("sha"), hashed.alias("h"), key.alias("key"), *carried)


def entries(rows: DataFrame) -> DataFrame:
    """One row per different text: h, key, sha, group_size, and keep_id and keep_n of the row that stays."""
    tie = F.coalesce(F.expr(f"cast('{_TOP}' as decimal(38,0)) - cast(doc_id as decimal(38,0))"), F.expr("cast(0 as decimal(38,0))"))
    rank = F.expr(f"cast(n as decimal(38,0)) * cast('{_STEP}' as decimal(38,0))") + tie
    grouped = rows.withColumn("rank", rank.cast("decimal(38,0)")).groupBy("h", "key", "norm").agg(F.count("*").alias("group_size"), F.max("rank").alias("rank"))
    last = F.expr(f"rank % cast('{_STEP}' as decimal(38,0))")
    return grouped.select("h", "key", F.sha2("norm", 256).alias("sha"), "group_size", F.when(last != 0, (F.expr(f"cast('{_TOP}' as decimal(38,0))") - last).cast("long")).alias("keep_id"), F.expr(f"cast(rank div cast('{_STEP}' as decimal(38,0)) as int)").alias("keep_n"))


def directory(prefixes: dict[int, int], max_depth: int = MAX_DEPTH, capacity: int = CAPACITY) -> list[int]:
    """Bucket of each slot after splitting. prefixes: entries by the first max_depth hash bits.

    Starts with one bucket; while one is overfull and may still split, it splits by its next bit, and the directory doubles
    when that bucket's depth was the directory's. A bucket is named by its lowest slot.
    """
    counts = [prefixes.get(x, 0) for x in range(1 << max_depth)]
    owner = [0] * (1 << max_depth)
    todo = [(0, 0)]  # first slot and local depth
    while todo:
        first, depth = todo.pop()
        width = 1 << (max_depth - depth)
        if depth < max_depth and sum(counts[first : first + width]) > capacity:
            todo += [(first, depth + 1), (first + width // 2, depth + 1)]
        else:
            owner[first : first + width] = [first] * width
    return owner


def slot(max_depth: int) -> Column:
    return F.shiftrightunsigned("h", 64 - max_depth).cast("int")


def build_index(docs: DataFrame, max_depth: int = MAX_DEPTH, capacity: int = CAPACITY, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(index, directory) read back from the shared folder. index: bucket, h, key, link, chain, sha, group_size, keep_id."""
    spark = docs.sparkSession
    found = stored(entries(digests(docs, hash_bits)), "dedup-entries").withColumn("slot", slot(max_depth))
    prefixes = {r["slot"]: r["count"] for r in found.groupBy("slot").count().collect()}  # at most 2^max_depth rows
    owner = directory(prefixes, max_depth, capacity)
    schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    pages = stored(spark.createDataFrame(list(enumerate(owner)), schema).coalesce(1), "dedup-directory")
    path = new_path(spark, "dedup-index")
    tasks = max(1, min(len(set(owner)), 4 * spark.sparkContext.defaultParallelism))
    placed = found.join(F.broadcast(pages), "slot").drop("slot")
    placed.repartitionByRange(tasks, "bucket", "h").sortWithinPartitions("bucket", "h", "sha").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(placed.schema).parquet(path), pages


def dedup(docs: DataFrame, max_depth: int = MAX_DEPTH, capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index, pages = build_index(docs, max_depth, capacity, hash_bits)
    return verdicts(digests(docs, hash_bits), index, pages, max_depth).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def _own_row(doc_id: str, n: str) -> Column:
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(n).cast("string"))


def verdicts(rows: DataFrame, index: DataFrame, pages: DataFrame, max_depth: int, staying: bool = False) -> DataFrame:
    """rows (of digests) with keep_id and group_size of their text, looked up by bucket, key and, in chains, bytes.

    With staying, only rows with the doc_id and length of the row that stays; both are part of the join, which spreads a hot text.
    """
    chained = index.groupBy("key").agg(F.count("*").alias("links")).where("links > 1").select("key")
    looked = rows.withColumn("slot", slot(max_depth)).join(F.broadcast(pages), "slot").drop("slot")
    looked = looked.withColumn("own", _own_row("doc_id", "n")).drop("n")
    found = index.select(F.col("bucket").alias("_bucket"), F.col("key").alias("_key"), F.col("sha").alias("_sha"), "group_size", "keep_id", _own_row("keep_id", "keep_n").alias("_own"))
    on = [looked["bucket"] == found["_bucket"], looked["key"] == found["_key"]]
    if staying:
        on.append(looked["own"] == found["_own"])
    if chained.isEmpty():
        return looked.drop("norm").join(found, on, "inner")
    # Chains: the digest alone doesn't tell the texts apart; the whole texts are compared with the chain's.
    texts = rows.join(chained, "key", "left_semi").groupBy("key", "norm").agg(F.min("sha").alias("_link")).withColumnsRenamed({"key": "_chain_key", "norm": "_chain_norm"})
    linked = looked.join(texts, (looked["key"] == texts["_chain_key"]) & (looked["norm"] == texts["_chain_norm"]), "left")
    return linked.join(found, [*on, F.coalesce(F.col("_link"), looked["sha"]) == found["_sha"]], "inner").drop("norm")


def keep(docs: DataFrame, max_depth: int = MAX_DEPTH, capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """The documents that stay, with their columns; of rows that repeat the staying doc_id, text and length, one."""
    index, pages = build_index(docs, max_depth, capacity, hash_bits)
    found = verdicts(digests(docs, hash_bits, whole=True), index, pages, max_depth, staying=True)
    return found.dropDuplicates(["bucket", "key", "own", "sha"]).select("row.*")


SQL = r"""
with t as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
g as (select doc_id, norm, first_value(doc_id) over (partition by norm order by n desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g
"""
