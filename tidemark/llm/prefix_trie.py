"""Prefix trie of conversations, with subtree totals by centroid decomposition.

A node is a distinct sequence of first turns (role, text). Its key is the exclusive or of 128 hash bits of every (position, turn digest) of the sequence, so a running
aggregate gives the keys of all prefixes and one more turn undone gives the parent's; conversations that share a prefix meet by grouping, with partial sums before
the shuffle. Long conversations are numbered and hashed in chunks, with one carried row for each chunk.

Subtree totals (`rollup`): the parent edges form a tree. A node's weight is the number of conversation turns at and below it; that is a sum over its own rows, since each row
knows how many turns follow, so the centroid of a component (the deepest node with at least half of its weight) needs no totals of its own. Each round splits every component of more
than `limit` nodes at its centroid: what hangs below it is summed up, added to all nodes from the centroid up to the component's top, and cut off, with
the weights of that path lowered; each child of the centroid heads a component of its own. The path and the component that a node falls into are
looked up in the prefixes of one member conversation. Weights halve, so that takes a logarithmic number of rounds, whatever the depth of the tree. Components
of at most `limit` nodes are decomposed in the same way inside tasks.

Defined cases: rows with a null conv_id belong to no conversation and are ignored; a null role or text is empty; turns are ordered null first, rows with the same turn by role and text; repeated rows are
turns of their own; a conversation without turns (after rebuilding) is a member of the root only; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import CRC_SQL, CRC_TABLE_SQL, stored

CHUNK = 1024


def root_id() -> Column:
    return F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))


def running(rows: DataFrame, order: Sequence[Column], chunk: Column, aggregates: dict[str, tuple[Column, str, str]]) -> DataFrame:
    """rows with running aggregates over each conv_id, from the first row to the current one, by (conv_id, chunk) and one carried row for each chunk.

    aggregates: name: (value, aggregate function, the operator that combines two of its results).
    """
    cut = rows.withColumn("_chunk", chunk)
    inside = Window.partitionBy("conv_id", "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumns({f"_v_{k}": v for k, (v, _, _) in aggregates.items()})
    sums = cut.groupBy("conv_id", "_chunk").agg(*[F.expr(f"{f}(_v_{k})").alias(f"_s_{k}") for k, (_, f, _) in aggregates.items()])
    sums = sums.select("conv_id", "_chunk", *[F.coalesce(F.expr(f"{f}(_s_{k})").over(before), F.lit(0).cast("long")).alias(f"_c_{k}") for k, (_, f, _) in aggregates.items()])
    joined = cut.withColumns({k: F.expr(f"{f}(_v_{k})").over(inside) for k, (_, f, _) in aggregates.items()}).join(sums, ["conv_id", "_chunk"])
    return joined.select("conv_id", *[c for c in rows.columns if c != "conv_id"], *[F.expr(f"{k} {op} _c_{k}").alias(k) for k, (_, _, op) in aggregates.items()])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, position): all turns of each conversation, counted from 1."""
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text")).where("conv_id is not null")
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    return running(rows, order, F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))), {"position": (F.lit(1).cast("long"), "sum", "+")})


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % 9


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, position, role, text, n_turns; conversations: conv_id, n_turns), each conversation c led by the first turns of c - c % 5."""
    turns = stored(numbered(conversations).drop("turn"), "trie-turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % 5
    plan = sizes.withColumn("base", base).join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    plan = plan.withColumn("h", head_length(F.col("conv_id"))).withColumn("lead", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("n_turns", F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = stored(plan.select("conv_id", "h", "lead", "n_turns"), "trie-plan")
    near = turns.where((F.col("position") <= 8) & (F.col("conv_id") % 5 == 0)).withColumn("base", F.col("conv_id"))
    heads = near.withColumn("conv_id", F.explode(F.sequence(F.col("base") - 4, F.col("base") + 4))).where((base == F.col("base")) & (F.col("position") <= head_length(F.col("conv_id"))))
    own = turns.join(plan, "conv_id").where("position > h").withColumn("position", F.col("position") - F.col("h") + F.col("lead"))
    columns = ["conv_id", "position", "role", "text", "n_turns"]
    return heads.join(plan, "conv_id").select(columns).unionByName(own.select(columns)), plan.select("conv_id", "n_turns")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, id, parent, bytes, below) for each turn of each conversation; below: turns from this one on."""
    digest = F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), F.concat("role", "text")), 256)
    rows = turns.select("conv_id", "position", F.octet_length("text").cast("long").alias("bytes"), (F.col("n_turns") - F.col("position") + 1).alias("below"), F.xxhash64("position", digest, F.lit("a")).alias("own_a"), F.xxhash64("position", digest, F.lit("b")).alias("own_b"))
    found = running(rows, [F.asc("position")], F.floor(F.col("position") / CHUNK), {"a": (F.col("own_a"), "bit_xor", "^"), "b": (F.col("own_b"), "bit_xor", "^")})
    parent = F.struct(F.col("a").bitwiseXOR(F.col("own_a")).alias("a"), F.col("b").bitwiseXOR(F.col("own_b")).alias("b"))
    return found.select("conv_id", F.col("position").alias("depth"), F.struct("a", "b").alias("id"), parent.alias("parent"), "bytes", "below")


def trie(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node: id, parent, depth, conv_id (smallest member), n_convs, weight, saved."""
    inner = paths.groupBy("id").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("below").alias("weight"), F.min("bytes").alias("bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("n_turns") + 1).alias("weight")).where("n_convs > 0")
    root = root.select(root_id().alias("id"), F.lit(None).cast("struct<a: long, b: long>").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", "weight", F.lit(0).cast("long").alias("bytes"))
    return inner.unionByName(root).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).drop("bytes")


def decomposed(parent: Sequence[int], weight: list[int], values: list[list[int]]) -> list[list[int]]:
    """Subtree totals of one component by recursive splits at centroids. parent: index of each node's parent, -1 at the top, which comes first; weight: subtree weights."""
    children: list[list[int]] = [[] for _ in parent]
    for node, above in enumerate(parent):
        if above >= 0:
            children[above].append(node)
    weight, gone, total = list(weight), bytearray(len(parent)), [[0] * len(values[0]) for _ in parent]
    tops = [0]
    while tops:
        top = tops.pop()
        half, centre = weight[top], top
        heavier = top
        while heavier is not None:
            centre = heavier
            heavier = next((c for c in children[centre] if not gone[c] and 2 * weight[c] >= half), None)
        below, found = [centre], list(values[centre])
        for node in below:
            for child in children[node]:
                if not gone[child]:
                    below.append(child)
                    found = [x + y for x, y in zip(found, values[child], strict=True)]
        at, lost = centre, weight[centre]
        while True:  # from the centroid to the component's top
            total[at] = [x + y for x, y in zip(total[at], found, strict=True)]
            if at == top:
                break
            at = parent[at]
            weight[at] -= lost
        gone[centre] = 1
        tops.extend(c for c in children[centre] if not gone[c])
        if top != centre:
            tops.append(top)
    return total


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one component after the other, from batches sorted by component."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and held[-1][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _finish(batches, n_values: int):
    """Totals of whole components. Columns: component (2), id (2), parent (2), weight, values, totals so far."""
    names = ["a", "b", *[f"total_{k}" for k in range(n_values)]]
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=names)

    for rows in _components(batches):
        place = {r[2:4]: k for k, r in enumerate(rows)}
        parent = [-1 if k == 0 else place[r[4:6]] for k, r in enumerate(rows)]
        totals = decomposed(parent, [r[6] for r in rows], [list(r[7 : 7 + n_values]) for r in rows])
        out += [(*r[2:4], *[x + y for x, y in zip(t, r[7 + n_values :], strict=True)]) for r, t in zip(rows, totals, strict=True)]
        if len(out) > 8192:
            yield made()
            out = []
    if out:
        yield made()


def rollup(nodes: DataFrame, paths: DataFrame, values: Sequence[str], limit: int = 16_384) -> DataFrame:
    """(id, value columns summed over each node's subtree). nodes: id, parent, depth, conv_id, weight, values; paths: conv_id, depth, id of every prefix, the root's too."""
    sums = [f"_sum_{v}" for v in values]
    state = nodes.select("id", "parent", "depth", "conv_id", "weight", *values, *[F.lit(0).cast("long").alias(s) for s in sums], root_id().alias("comp"))
    small, finished = [], []
    probe = lambda name: paths.select(F.col("conv_id").alias("conv_id"), F.col("depth").alias(f"_{name}_depth"), F.col("id").alias(f"_{name}"))
    while True:
        sizes = stored(state.groupBy("comp").agg(F.count("*").alias("_n"), F.max(F.when(F.col("id") == F.col("comp"), F.col("weight"))).alias("_total")).where(F.col("_n") > limit), "trie-components")
        if sizes.isEmpty():
            small.append(state)
            break
        marked = stored(state.join(sizes, "comp", "left"), "trie-state")
        small.append(marked.where("_n is null").select(state.columns))
        large = marked.where("_n is not null")
        heaviest = large.where("2 * weight >= _total").groupBy("comp").agg(F.max(F.struct("depth", "id", "conv_id", "weight")).alias("_g"), F.min("depth").alias("_top_depth"))
        centres = stored(heaviest, "trie-centroids")
        placed = large.join(centres, "comp").withColumn("_at_depth", F.col("_g.depth")).withColumn("_next_depth", F.col("_g.depth") + 1)
        placed = placed.join(probe("at"), ["conv_id", "_at_depth"], "left").join(probe("next"), ["conv_id", "_next_depth"], "left")
        placed = placed.withColumn("_below", (F.col("depth") >= F.col("_g.depth")) & F.coalesce(F.col("_at") == F.col("_g.id"), F.lit(False)))
        placed = stored(placed, "trie-placed")
        totals = placed.where("_below").groupBy("comp").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
        # The path from each centroid to its component's top: prefixes of one of its members.
        ways = centres.select("comp", "_g", "_top_depth", F.col("_g.conv_id").alias("conv_id")).join(paths.select("conv_id", F.col("depth").alias("_d"), F.col("id").alias("_id")), "conv_id")
        ways = ways.where((F.col("_d") >= F.col("_top_depth")) & (F.col("_d") <= F.col("_g.depth"))).join(totals, "comp").select(F.col("_id").alias("id"), F.col("_g.weight").alias("_lost"), *[f"_t_{v}" for v in values])
        added = placed.join(ways, "id", "left")
        new = [(F.col(s) + F.coalesce(F.col(f"_t_{v}"), F.lit(0))).alias(s) for s, v in zip(sums, values, strict=True)]
        weight = F.when(F.col("_below"), F.col("weight")).otherwise(F.col("weight") - F.coalesce("_lost", F.lit(0))).alias("weight")
        comp = F.when(F.col("_below"), F.col("_next")).otherwise(F.col("comp")).alias("comp")
        is_centre = F.col("id") == F.col("_g.id")
        after = stored(added.select("id", "parent", "depth", "conv_id", weight, *values, *new, comp, is_centre.alias("_done")), "trie-split")
        finished.append(after.where("_done").select("id", *[F.col(s).alias(v) for s, v in zip(sums, values, strict=True)]))
        state = after.where("not _done").drop("_done")
    rest = small[0]
    for part in small[1:]:
        rest = rest.unionByName(part)
    rest = rest.repartition("comp").sortWithinPartitions("comp", "depth").select(*[F.col(f"{n}.{x}").alias(f"{n}_{x}") for n in ("comp", "id", "parent") for x in "ab"], "weight", *values, *sums)
    schema = "a long, b long, " + ", ".join(f"total_{k} long" for k in range(len(values)))
    out = rest.mapInArrow(partial(_finish, n_values=len(values)), schema).select(F.struct("a", "b").alias("id"), *[F.col(f"total_{k}").alias(v) for k, v in enumerate(values)])
    for part in finished:
        out = out.unionByName(part)
    return out


def _hashes(batches):
    """SHA-256 of each node's comma-joined blocks, in order; only the current node's state is held."""
    key, state = None, None
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out])], names=["a", "b", "ends_sha256"])

    for batch in batches:
        for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if (a, b) != key:
                if state is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if len(out) > 8192:
            yield made()
            out = []
    if state is not None:
        out.append((*key, state.hexdigest()))
    if out:
        yield made()


def ends(paths: DataFrame, block: int = 4096) -> DataFrame:
    """(id, ends_sha256) of nodes at which conversations end. Ids are joined in blocks first, so a node where a third of all end sends one row a block to its task."""
    blocks = paths.where("below = 1").groupBy("id", F.floor(F.col("conv_id") / block).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    sorted_blocks = blocks.repartition("id").sortWithinPartitions("id", "block").select("id.a", "id.b", "ids")
    return sorted_blocks.mapInArrow(_hashes, "a long, b long, ends_sha256 string").select(F.struct("a", "b").alias("id"), "ends_sha256")


def nodes_of(turns: DataFrame, convs: DataFrame, limit: int = 16_384) -> DataFrame:
    """The trie's nodes with subtree totals. turns: conv_id, position (from 1), role, text, n_turns; convs: conv_id, n_turns."""
    at_root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root_id().alias("id"), F.lit(None).cast("struct<a: long, b: long>").alias("parent"), F.lit(0).cast("long").alias("bytes"), (F.col("n_turns") + 1).alias("below"))
    inner = stored(prefixes(turns), "trie-prefixes")
    paths = inner.unionByName(at_root)
    nodes = stored(trie(inner, convs), "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, "id", "left").fillna({"n_children": 0}).withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie-counted")
    totals = rollup(nodes, paths, ["leaf", "saved"], limit).withColumnsRenamed({"leaf": "n_leaves", "saved": "saved_tokens"})
    above = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(above, "parent", "left").join(totals, "id").join(ends(paths), "id", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def shared_prefixes(conversations: DataFrame, limit: int = 16_384) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return nodes_of(*rebuilt(conversations), limit)


SQL = f"""
WITH crc AS (SELECT {CRC_TABLE_SQL} AS t),
heads AS (SELECT conv_id, {CRC_SQL.format("conv_id::VARCHAR", "t")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations),
rebuilt AS (
  SELECT h.conv_id, 0 AS part, pos, role, text FROM heads h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 5 AND pos <= h
  UNION ALL SELECT h.conv_id, 1, pos, role, text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND pos > h),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM rebuilt),
prefixes AS (
  SELECT conv_id, depth, octet_length(encode(text)) AS bytes, string_agg(md5(strlen(role) || ':' || role || text), '/') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM heads),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved FROM prefixes GROUP BY path, depth),
edges AS (SELECT n.path, n.depth, p.path AS parent FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT parent AS path, count(*) AS n_children FROM edges GROUP BY parent),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (path)),
totals AS (SELECT p.path, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM counted n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.path),
last AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM prefixes JOIN last USING (conv_id, depth) GROUP BY path)
SELECT n.conv_id, n.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM counted n JOIN totals USING (path) LEFT JOIN edges e USING (path) LEFT JOIN nodes a ON a.path = e.parent LEFT JOIN ends ON ends.path = n.path
"""
