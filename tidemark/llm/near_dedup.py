"""Near-duplicate classes by BagMinHash signatures over five-word shingles.

A document is the multiset of its five-word shingles (lower case; fewer than five words make one shingle). BagMinHash: for each
shingle, a Poisson process runs over its weight axis, cut into the levels [0,1), [1,2), [2,4), [4,8) ... whose
processes are independent and seeded by shingle and level; a point counts where its weight coordinate lies under the shingle's weight
in the document. Each point picks a register, each register keeps its earliest time, so two documents share a register with the probability of
their weighted Jaccard similarity. A document's processes are generated in time order, in growing blocks, and stop beyond its latest register.

1. One pass computes signatures in numpy (bands of registers hashed to 64 bits) and a digest of the word sequence; texts of one
   word sequence collapse before anything is compared. From here on the digest stands for the text.
2. Buckets (equal band) with two or more texts give candidate pairs without emitting all pairs of a large bucket: buckets of up to small_bucket
   texts pair their members, a bound; larger ones first pair every member with a hub, the member that shares most buckets with others. Then every pair
   of a large bucket that the links so far don't hold in one component is compared exactly, block against block: blocks hold texts of one size class
   (texts of similarity t differ in size by a factor of at most 1 / t, so only equal and neighbouring classes meet), dealt by a hash, and each
   pair of blocks is one task's product of 0/1 matrices, which gives a spanning forest of its links. Members of the bucket's largest component meet the others only.
   Before that a prefix filter over rare shingles drops the texts that can have no link to another component, so texts that only share boilerplate,
   however many, are not compared. Members and blocks are joined by bucket and a salt, bags by text and a salt; the two joins that first tell sizes
   to bucket members and classes to rows carry narrow rows and no salt.
3. Pairs are verified by exact multiset overlap of the shingles; links of at least the threshold stay.
4. Classes are the connected components, by alternating large and small stars, a logarithmic number of rounds; each is written to the shared folder.

Defined cases: null, empty and blank texts are all alike and form one class; rows that repeat a doc_id count each with its own text, in the class of that text;
rows with a null doc_id take part, and a class of such rows only has a null class_id; class_id is the smallest doc_id of the class, so
two classes share one only where rows repeat a doc_id; an empty table gives no
rows; other columns are ignored by `classes` and kept by `keep`, which keeps one row of each class: of the smallest doc_id, also among rows that repeat it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import free_name, row_key, stored, text_hash, text_or_empty

WORDS = 5
BANDS = 25
ROWS = 5
THRESHOLD = 0.8
SMALL_BUCKET = 12
#: Rows of a large bucket that share a salt.
SALT = 256
#: Texts and shingles of a block at most (one text at least).
BLOCK = 256
BLOCK_UNITS = 1 << 22
#: Slots that count shingles, to tell rare from frequent ones.
SLOTS = 1 << 18
#: Comparisons of one text that share a salt.
JOBS = 32
CHUNK = 1 << 20

_U = np.uint64
_BASE, _K1, _K2 = _U(0x9E3779B97F4A7C15 | 1), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _K1
        x = (x ^ (x >> _U(27))) * _K2
        return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_IS_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            a = np.full(size, _BASE)
            b = np.full(size, _U(pow(int(_BASE), -1, 1 << 64)))
            a[0] = b[0] = 1
            _POWERS[:] = [np.cumprod(a, dtype=np.uint64), np.cumprod(b, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first byte) of each word of data."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, word, False]))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * up[: len(raw)], dtype=np.uint64)])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def pieces(data: bytes) -> Iterator[bytes]:
    """Parts of about CHUNK bytes, cut at white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end]
        at = end


def batches_of_words(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, hashes of all words, words of each text) for runs of texts of about CHUNK bytes."""
    held: list[bytes] = []
    first, size = 0, 0
    for n, text in enumerate([*texts, None]):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass").lower()
        if held and (text is None or size + len(data) > CHUNK):
            offsets = np.cumsum([0] + [len(x) + 1 for x in held])
            found, start = word_hashes(b"\n".join(held))
            yield first, found, np.diff(np.searchsorted(start, offsets))
            held, size = [], 0
        if text is None:
            return
        if len(data) > CHUNK:
            found = np.concatenate([word_hashes(x)[0] for x in pieces(data)])
            yield n, found, np.array([len(found)])
            first = n + 1
            continue
        if not held:
            first = n
        held.append(data)
        size += len(data) + 1


def shingles(words: np.ndarray, sizes: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, text number), in text order."""
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = len(words)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(width):
            step = _U(2 * k + 3) * _K1
            out[: n - k if k else n] += mix(words[k:] + step) * (step | _U(1)) if k < n else 0
        out = mix(out)
    whole = np.arange(n) + width <= ends[owner]
    got, of = out[whole], owner[whole]
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        lone = np.empty(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for j, s in enumerate(short):
                part = words[ends[s] - sizes[s] : ends[s]]
                lone[j] = mix(np.sum(mix(part + np.arange(1, len(part) + 1, dtype=np.uint64) * _BASE), dtype=np.uint64, keepdims=True))[0] ^ _U(len(part))
        got, of = np.concatenate([got, lone]), np.concatenate([of, short])
    order = np.lexsort((got, of))
    return got[order], of[order]


def weighted(sh: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, text) in order, with multiplicity."""
    if not len(sh):
        return sh, of, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, (sh[1:] != sh[:-1]) | (of[1:] != of[:-1])])
    return sh[first], of[first], np.diff(np.r_[first, len(sh)])


def bag_minhash(sh: np.ndarray, of: np.ndarray, weight: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """Earliest times, one row of registers for each text (infinite without shingles)."""
    best = np.full(n_texts * registers, np.inf)
    seed, text, low, width, cap = [mix(sh)], [of], [np.zeros(len(sh))], [np.ones(len(sh))], [weight.astype(float)]
    level, over = 1, np.flatnonzero(weight > 1)
    while len(over):
        edge = float(1 << (level - 1))
        with np.errstate(over="ignore"):
            seed.append(mix(sh[over] + _U(level) * _BASE))
        text.append(of[over])
        low.append(np.full(len(over), edge))
        width.append(np.full(len(over), edge))
        cap.append(weight[over].astype(float))
        over = over[weight[over] > 2 * edge]
        level += 1
    seed, text, low, width, cap = (np.concatenate(x) for x in (seed, text, low, width, cap))
    time, done, block = np.zeros(len(seed)), np.zeros(len(seed), np.uint64), 1
    live = np.arange(len(seed))
    tiny = 2.0**-53
    while len(live):
        with np.errstate(over="ignore"):
            step = (done[live][:, None] + np.arange(1, block + 1, dtype=np.uint64)) * _BASE
            a = mix(seed[live][:, None] + step)
            b = mix(a ^ _K2)
        waits = -np.log(((a >> _U(11)).astype(float) + 1) * tiny) / width[live][:, None]
        times = time[live][:, None] + np.cumsum(waits, axis=1)
        at = text[live][:, None] * registers + (b % _U(registers)).astype(np.int64)
        under = low[live][:, None] + width[live][:, None] * ((b >> _U(32)).astype(float) * 2.0**-32) < cap[live][:, None]
        under &= times < best[at]
        np.minimum.at(best, at[under], times[under])
        time[live], done[live] = times[:, -1], done[live] + _U(block)
        latest = best.reshape(n_texts, registers).max(axis=1)
        live = live[time[live] < latest[text[live]]]
        block = min(64, block * 2) if len(live) * block < 1 << 20 else block
    return best.reshape(n_texts, registers)


_SIGNATURES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])


def digest_of(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def _signatures(batches, bands: int, rows: int):
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for first, words, sizes in batches_of_words(texts):
            sh, of, weight = weighted(*shingles(words, sizes))
            best = bag_minhash(sh, of, weight, len(sizes), bands * rows).view(np.uint64).reshape(len(sizes), bands, rows)
            with np.errstate(over="ignore"):
                hashed = mix(np.sum(mix(best + np.arange(1, rows + 1, dtype=np.uint64) * _BASE), axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _K1)
            ends = np.cumsum(sizes)
            digest = [digest_of(words[e - s : e]) for s, e in zip(sizes, ends, strict=True)]
            own = batch.slice(first, len(sizes))
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(np.arange(0, len(sizes) * bands + 1, bands, dtype=np.int32), hashed.reshape(-1).view(np.int64))],
                schema=_SIGNATURES,
            )


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, a hash of the text as it is, digest of the word sequence, one 64-bit hash for each band."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), text_or_empty().alias("text"))
    return texts.mapInArrow(partial(_signatures, bands=bands, rows=rows), "doc_id long, text_hash long, digest binary, bands array<long>")


def _bags(batches):
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for _, words, sizes in batches_of_words(texts):
            sh, of = shingles(words, sizes)
            run = np.arange(len(sh))
            if len(sh):
                starts = np.r_[True, (sh[1:] != sh[:-1]) | (of[1:] != of[:-1])]
                run = run - np.maximum.accumulate(np.where(starts, run, 0))
            with np.errstate(over="ignore"):
                unit = mix(sh + run.astype(np.uint64) * _K2).view(np.int64)
            offsets = np.searchsorted(of, np.arange(len(sizes) + 1)).astype(np.int32)
            digest = [digest_of(words[e - s : e]) for s, e in zip(sizes, np.cumsum(sizes), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.ListArray.from_arrays(offsets, unit)], names=["doc", "bag"])


def bags(docs: DataFrame) -> DataFrame:
    """Digest of each text as doc, and its multiset as distinct 64-bit units: the k-th occurrence of a shingle is a unit of its own."""
    return docs.select(text_or_empty().alias("text")).mapInArrow(_bags, "doc binary, bag array<long>")


def verified(pairs: DataFrame, bag_table: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) with weighted Jaccard similarity of at least threshold."""
    left = bag_table.select(F.col("doc").alias("a"), F.col("bag").alias("bag_a"))
    right = bag_table.select(F.col("doc").alias("b"), F.col("bag").alias("bag_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    return both.where(shared >= threshold * (F.size("bag_a") + F.size("bag_b") - shared) - 1e-9).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component; nodes without links don't appear.

    Large star: every node hands its larger neighbours to the smallest node around it. Small star: it hands the smaller ones. In turn they shorten
    any path by about half, so chains of any order need a logarithmic number of rounds; a round that changes nothing has left stars.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    before = fingerprint(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
        after = fingerprint(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and two order-free hashes of them."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def salted(df: DataFrame, by: str = "doc") -> DataFrame:
    """A salt for each row of a bucket of n texts: about SALT rows share one."""
    return df.withColumn("salt", F.pmod(F.xxhash64(by, F.lit("salt")), F.ceil(F.col("n") / SALT)).cast("int"))


def for_all_salts(df: DataFrame) -> DataFrame:
    """Rows of a table by bucket, once for each salt of the bucket's n texts."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SALT).cast("int") - 1)))


def candidate_rounds(members: DataFrame, small: int) -> DataFrame:
    """Pairs (a, b) of small buckets, and of each other bucket's hub with its members. members: bucket, doc, n (size of the bucket)."""
    few = members.where(F.col("n") <= small).groupBy("bucket").agg(F.sort_array(F.collect_set("doc")).alias("d"))
    paired = few.select(F.explode(F.expr("flatten(transform(d, (x, i) -> transform(slice(d, i + 2, size(d)), y -> named_struct('a', x, 'b', y))))")).alias("p")).select("p.a", "p.b")
    many = salted(members.where(F.col("n") > small))
    score = many.groupBy("doc").agg(F.sum("n").alias("score"))
    scored = many.join(score, "doc")
    best = scored.groupBy("bucket", "salt").agg(F.max(F.struct("score", "doc")).alias("top"), F.max("n").alias("n"))
    hubs = best.groupBy("bucket").agg(F.max("top").alias("top"), F.max("n").alias("n")).select("bucket", "n", F.col("top.doc").alias("hub"))
    hubbed = many.drop("n").join(for_all_salts(hubs), ["bucket", "salt"]).where("doc != hub").select(F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b"))
    return paired.union(hubbed).distinct()


def _block_links(frame, threshold: float):
    """Spanning forest of the links between the two sides of a job (0 and 1; 2 is on both)."""
    import pandas as pd

    docs, roots, side = (frame[k].to_numpy() for k in ("doc", "root", "side"))
    n, sizes = len(docs), np.array([len(x) for x in frame["bag"]])
    owner, unit = np.repeat(np.arange(n), sizes), np.concatenate([np.asarray(x, np.int64) for x in frame["bag"]])
    _, unit, times = np.unique(unit, return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)  # a shingle of one text is in no overlap
    place = np.full(len(times), -1)
    place[common] = np.arange(len(common))
    order = np.argsort(place[unit], kind="stable")
    owner, unit = owner[order], place[unit][order]
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    shared = np.zeros((len(left), len(right)))
    for at in range(0, len(common), 4096):
        start, end = np.searchsorted(unit, [at, at + 4096])
        has = np.zeros((n, min(4096, len(common) - at)), np.float32)
        has[owner[start:end], unit[start:end] - at] = 1
        shared += has[left] @ has[right].T
    alike = shared >= threshold * (sizes[left][:, None] + sizes[right][None, :] - shared) - 1e-9
    alike &= roots[left][:, None] != roots[right][None, :]
    linked = np.zeros((n, n), bool)
    linked[np.ix_(left, right)] = alike
    linked |= linked.T
    seen, out = np.zeros(n, bool), []
    for first in range(n):
        waiting = [] if seen[first] else [first]
        seen[first] = True
        while waiting:
            x = waiting.pop()
            new = np.flatnonzero(linked[x] & ~seen)
            seen[new] = True
            out += [(min(docs[x], docs[y]), max(docs[x], docs[y])) for y in new]
            waiting += new.tolist()
    return pd.DataFrame(out, columns=["a", "b"])


_PREFIXES = pa.schema([("doc", pa.binary()), ("root", pa.int64()), ("unit", pa.int64()), ("short", pa.bool_())])


def _prefixes(batches, seen, threshold: float):
    for batch in batches:
        bag = batch.column(2)
        sizes, units = bag.value_lengths().to_numpy(), bag.flatten().to_numpy()
        of = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((units, seen.value[units % SLOTS], of))
        place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        long, short = (sizes - np.ceil(sizes * least - 1e-6) + 1 for least in (threshold, 2 * threshold / (1 + threshold)))
        kept = place < long[of]
        of, place, unit = of[kept], place[kept], units[order[kept]]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(unit), pa.array(place < short[of])], schema=_PREFIXES)


def with_partners(texts: DataFrame, bag_table: DataFrame, threshold: float) -> DataFrame:
    """The docs of texts (doc, root) that may have a link to a text of another root; no other has one.

    All bags are put in one order, rare units first (by counts of SLOTS hashed slots, a fixed size; any order is right). Of a pair of similarity of at least
    the threshold t the smaller bag x and the larger y share one of the first |x| - 2t|x| / (1 + t) + 1 units of x and the first |y| - t|y| + 1 of y: with fewer
    units behind those they couldn't overlap enough. Units are looked up by the least and greatest root that hold them, so no pairs are formed.
    """
    slots = bag_table.select(F.explode("bag").alias("unit")).groupBy(F.pmod("unit", F.lit(SLOTS)).alias("slot")).count().toPandas()
    seen = np.zeros(SLOTS, np.int64)
    seen[slots["slot"].to_numpy(np.int64)] = slots["count"].to_numpy(np.int64)
    bagged = texts.join(bag_table, "doc").select("doc", F.xxhash64("root").alias("root"), "bag")
    found = partial(_prefixes, seen=bag_table.sparkSession.sparkContext.broadcast(seen), threshold=threshold)
    held = stored(bagged.mapInArrow(found, "doc binary, root long, unit long, short boolean"), "prefixes")
    short = F.when(F.col("short"), F.col("root"))
    units = held.groupBy("unit").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min(short).alias("short_least"), F.max(short).alias("short_most"))
    met = held.join(units.where("least < most and short_least is not null"), "unit")
    return met.where("short and (least != root or most != root) or short_least != root or short_most != root").select("doc").distinct()


def block_links(large: DataFrame, roots: DataFrame, bag_table: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that, with those behind roots (node, root), join all alike texts of each bucket. large: bucket, doc, n."""
    step = math.log(1 / threshold) + 1e-6
    sizes = bag_table.select("doc", F.floor(F.log(F.greatest(F.size("bag"), F.lit(1)).cast("double")) / step).cast("int").alias("class"))
    placed = large.join(roots.withColumnRenamed("node", "doc"), "doc", "left").join(sizes, "doc").select("bucket", "doc", "n", F.coalesce("root", "doc").alias("root"), "class")
    placed = stored(salted(placed), "placed")
    parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("held"), F.max("n").alias("n"))
    top = parts.groupBy("bucket").agg(F.max(F.struct("held", "root")).alias("top"), F.count("*").alias("roots"), F.max("n").alias("n")).where("roots > 1").select("bucket", "n", F.col("top.root").alias("largest"))
    cell = ["bucket", "class", "main"]
    split = placed.drop("n").join(for_all_salts(top), ["bucket", "salt"]).select("bucket", "doc", "root", "class", (F.col("root") == F.col("largest")).alias("main"), "n", "salt")
    split = stored(split.join(with_partners(split.select("doc", "root").distinct(), bag_table, threshold), "doc", "left_semi"), "split")
    most = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), F.floor(F.lit(float(BLOCK_UNITS)) / F.exp((F.col("class") + 1) * step)).cast("double")))
    cells = stored(split.groupBy(*cell).agg(F.count("*").alias("held"), F.max("n").alias("n")).select(*cell, "n", F.ceil(F.col("held") / most).cast("int").alias("blocks")), "cells")
    blocks = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.struct("class", "main", "part").alias("x"))
    both = blocks.join(blocks.withColumnRenamed("x", "y"), "bucket").where("x <= y and abs(x.class - y.class) <= 1 and not (x.main and y.main)")
    job = F.xxhash64("bucket", "x", "y").alias("job")
    ends = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("at"), F.lit(2).alias("side"))))
    ends = ends.otherwise(F.array(F.struct(F.col("x").alias("at"), F.lit(0).alias("side")), F.struct(F.col("y").alias("at"), F.lit(1).alias("side"))))
    sides = both.select("bucket", job, F.explode(ends).alias("e")).select("bucket", "job", "e.at.class", "e.at.main", "e.at.part", "e.side")
    dealt = split.drop("n").join(for_all_salts(cells), [*cell, "salt"]).select(*cell, F.pmod(F.xxhash64("doc", F.lit("block")), F.col("blocks")).cast("int").alias("part"), "doc", "root")
    # A text meets all blocks of its cell's neighbours, so its jobs are spread over salts by their number.
    load = sides.groupBy(*cell, "part").agg(F.ceil(F.count("*") / JOBS).cast("int").alias("salts"))
    rows = stored(dealt.join(sides.join(load, [*cell, "part"]), [*cell, "part"]).select("job", "side", "doc", "root", "salts"), "jobs")
    spread = rows.groupBy("doc").agg(F.max("salts").alias("salts")).select("doc", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    filled = rows.withColumn("salt", F.pmod(F.col("job"), F.col("salts")).cast("int")).drop("salts").join(bag_table.join(spread, "doc"), ["doc", "salt"])
    return filled.groupBy("job").applyInPandas(partial(_block_links, threshold=threshold), "a binary, b binary")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """rows (bucket, doc) of buckets with two or more texts, with n."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return stored(rows.join(sizes, "bucket"), "members")


def bags_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bags of the texts in wanted (doc, rep): read from the rows of those ids, and from all rows without an id, since an id doesn't tell those apart."""
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = some.join(wanted.select(F.col("rep").alias("doc_id")).where("doc_id is not null").distinct().hint("merge"), "doc_id", "left_semi")
    found = bags(named.union(some.where("doc_id is null")) if wanted.where("rep is null").take(1) else named)
    return stored(found.dropDuplicates(["doc"]), "bags")


def labelled(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """One row per document: doc_id, text_hash, class_id and the row that stays for its class as a struct of doc_id and text_hash."""
    sig = stored(signatures(docs, bands, rows), "signatures")
    # Null ids come last: the first field tells whether there is none.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    copies = stored(sig.groupBy("digest").agg(first.alias("first"), F.any_value("bands").alias("bands")).withColumnRenamed("digest", "doc"), "copies")
    members = shared_buckets(copies.select("doc", F.explode("bands").alias("bucket")))
    found = None
    if not members.isEmpty():
        wanted = copies.select("doc", F.col("first.doc_id").alias("rep")).join(members.select("doc").distinct(), "doc", "left_semi")
        bag_table = bags_of(docs, wanted)
        found = stored(verified(candidate_rounds(members, small_bucket), bag_table, threshold), "verified")
        large = members.where(F.col("n") > small_bucket)
        if not large.isEmpty():
            roots = stored(components(found), "components")
            found = found.union(stored(block_links(large, roots, bag_table, threshold), "block-links"))
    label = copies.select("doc", "first")
    if found is not None:
        linked = label.join(components(found).withColumnRenamed("node", "doc"), "doc")
        linked = linked.join(linked.groupBy("root").agg(F.min("first").alias("class_first")), "root").select("doc", "class_first")
        label = label.join(linked, "doc", "left").select("doc", F.coalesce("class_first", "first").alias("first"))
    label = label.select(F.col("doc").alias("digest"), F.struct("first.doc_id", "first.text_hash").alias("stays"))
    return sig.select("doc_id", "text_hash", "digest").join(label, "digest").select("doc_id", "text_hash", F.col("stays.doc_id").alias("class_id"), "stays")


def _stays():
    return F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of the class), is_representative (its text and doc_id are those that stay)."""
    return labelled(docs, threshold, bands, rows, small_bucket).select("doc_id", "class_id", _stays().alias("is_representative"))


def keep(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with its columns."""
    gone = labelled(docs, threshold).where(~_stays()).select(row_key("doc_id", F.col("text_hash")).alias("_gone")).distinct()
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, row_key("doc_id", text_hash()))
    # Rows that repeat the doc_id and the text that stay are in one partition now.
    return keyed.join(gone.hint("merge"), keyed[key] == gone["_gone"], "left_anti").dropDuplicates([key]).drop(key)
