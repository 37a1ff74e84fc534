"""The prefix trie of conversations, by one ROLLUP over positional turn-id columns.

A turn's id stands for its role and text. A conversation is one row of eight turn-id columns for each block of eight
turns, keyed by the node that the block before it ends in (a digest of all turns so far), so that blocks of any depth are
rolled up in the same job: grouping_id tells how many turns of the block a group has. A second ROLLUP, over the nodes,
sums up what lies below each of them; what later blocks hold is added to the nodes that they hang on, in as many rounds as
the longest conversation's number of blocks can be halved.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked
from .tables import settle

#: Turns in a block.
BLOCK = 8
TURNS = [f"t{i}" for i in range(1, BLOCK + 1)]
#: A conversation's turns, and its blocks, are dealt in shares of so many.
SHARE = 4096
#: Conversations whose numbers differ in the last two digits only share the first turns of the first of them.
FAMILY, SHARED_TURNS = 100, 6
#: Keys with more than this part of all rows of a join are looked up in a broadcast table: there are fewer than that of them.
HOT = 256
#: Ids that are joined to one string before a node's strings meet.
IDS = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0) and id of each turn: a digest of role and text, a colon and the text's number of code points.
    Turns with no number come first, those with the same in the order of role and text. Rows without a conv_id belong to no
    conversation."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    name = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    found = F.concat(F.substring(F.sha2(name, 256), 1, 32), F.lit(":"), F.char_length("text").cast("string"))
    return ranked(rows.withColumn("id", found), ["conv_id"], ["turn", "role", "text"], "at", keep=["conv_id", "id"])


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, id, n) of the rebuilt turns, and (conv_id, n) of all conversations, n being the rebuilt length."""
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("base", F.expr(f"conv_id - conv_id % {FAMILY}")).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % SHARED_TURNS)
    bases = sizes.where("conv_id = base").select("base", F.col("size").alias("given"))
    plan = sizes.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
    plan = settle(plan.withColumn("n", F.col("taken") + F.greatest(F.lit(0), F.col("size") - F.col("h"))))
    shares = plan.select("conv_id", "h", "taken", "n", F.explode(F.expr(f"sequence(0L, (size - 1) div {SHARE})")).alias("share"))
    kept = own.withColumn("share", F.expr(f"at div {SHARE}")).join(shares, ["conv_id", "share"]).where("at >= h")
    heads = own.where(f"at < {SHARED_TURNS} and conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), "at", "id")
    given = plan.where("taken > 0").join(heads, "base").where("at < taken").select("conv_id", "at", "id", "n")
    return kept.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "id", "n").unionByName(given), plan.select("conv_id", "n")


def _mark(lane: str, at: Column, turn: Column) -> Column:
    """What a turn adds (by exclusive or) to one of two 64-bit lanes of the digest of all turns up to it."""
    return F.when(turn.isNull(), 0).otherwise(F.xxhash64(F.lit(lane), at.cast("long"), turn))


def _xor(*parts: Column) -> Column:
    return reduce(lambda x, y: x.bitwiseXOR(y), parts)


def blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """conv_id, block, t1 to t8, n, a and b (digest of the turns before the block), x and y (of the block's own)."""
    zero = F.lit(0).cast("long")
    marked = rows.withColumns({lane: _mark(lane, F.col("at"), F.col("id")) for lane in "xy"})
    wide = marked.groupBy("conv_id", F.expr(f"at div {BLOCK}").alias("block")).agg(
        F.max("n").alias("n"), *(F.max(F.when(F.col("at") % BLOCK == i, F.col("id"))).alias(t) for i, t in enumerate(TURNS)), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"),
    )
    empty = sizes.where("n = 0").select("conv_id", zero.alias("block"), "n", *(F.lit(None).cast("string").alias(t) for t in TURNS), zero.alias("x"), zero.alias("y"))
    wide = settle(wide.unionByName(empty).withColumn("share", F.expr(f"block div {SHARE}")))
    within = Window.partitionBy("conv_id", "share").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of more than one share have any before another.
    shares = wide.where(f"n > {BLOCK * SHARE}").groupBy("conv_id", "share").agg(F.bit_xor("x").alias("p"), F.bit_xor("y").alias("q"))
    shares = shares.select("conv_id", "share", *(F.bit_xor(c).over(before).alias(c) for c in "pq"))
    out = wide.withColumns({"a": F.bit_xor("x").over(within), "b": F.bit_xor("y").over(within)}).join(shares, ["conv_id", "share"], "left")
    return settle(out.select("conv_id", "block", "n", *TURNS, "x", "y", *(_xor(F.coalesce(c, zero), F.coalesce(d, zero)).alias(c) for c, d in (("a", "p"), ("b", "q")))))


def _rolled(rows: DataFrame, sums: str) -> DataFrame:
    """A row for each prefix of the turn ids within each block: block, a, b, t1 to t8 (null from there on), d (how many)."""
    names = ", ".join(TURNS)
    found = rows.sparkSession.sql(
        f"SELECT block, a, b, {names}, {BLOCK} - bit_count(grouping_id()) AS d, {sums} FROM {{rows}} GROUP BY block, a, b, ROLLUP ({names})", rows=rows
    )
    # A group whose last turn is null holds those that ended before it. The empty prefix of a later block is the block before's last.
    last = F.element_at(F.array(F.lit(""), *TURNS), F.col("d").cast("int") + 1)
    return found.withColumn("last", last).where("last is not null and (d > 0 or block = 0)")


def looked_up(rows: DataFrame, keys: list[str], found: DataFrame, counts: DataFrame) -> DataFrame:
    """The inner join of `rows` with `found`, which has a row for each key at most. counts: how many `rows` each key has, as `many`.

    Keys with over 1/HOT of all rows, fewer than HOT by that, are looked up in a broadcast table.
    """
    total = counts.agg(F.sum("many").alias("total"))
    hot = counts.join(F.broadcast(total), F.col("many") * HOT > F.col("total")).select(*keys)
    few = F.broadcast(hot)
    return rows.join(F.broadcast(found.join(few, keys, "left_semi")), keys).unionByName(rows.join(few, keys, "left_anti").join(found, keys))


def _below(nodes: DataFrame) -> DataFrame | None:
    """For each node that ends a block and goes on in the next: block, a, b (of that next block), children, saved, leaves below it."""
    inner = nodes.where("block > 0").groupBy("block", "a", "b").agg(F.sum("own").alias("saved"), F.sum("leaf").alias("leaves"), F.count_if(F.col("d") == 1).alias("children"))
    ends = nodes.where(f"d = {BLOCK}").select((F.col("block") + 1).alias("block"), F.col("x").alias("a"), F.col("y").alias("b"), F.col("a").alias("up_a"), F.col("b").alias("up_b"))
    rows, step = inner.join(ends, ["block", "a", "b"]), 1
    last = nodes.agg(F.max("block")).first()[0] or 0
    if not last:
        return None
    rows = settle(rows)
    while step < last:
        # What is `step` to 2 * step - 1 blocks below a node comes from those that are `step` below it; then all look twice as far up.
        up = rows.where(f"block > {step}").withColumn("to", F.col("block") - step)
        gained = settle(up.groupBy("to", "up_a", "up_b").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"), F.count("*").alias("many")))
        here = rows.select(F.col("block").alias("to"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("up_a").alias("next_a"), F.col("up_b").alias("next_b"))
        jumped = looked_up(up, ["to", "up_a", "up_b"], here, gained.select("to", "up_a", "up_b", "many"))
        jumped = jumped.select("block", "a", "b", F.col("next_a").alias("up_a"), F.col("next_b").alias("up_b"), "children", "saved", "leaves")
        rows = jumped.unionByName(rows.where(f"block <= {step}"))
        rows = rows.join(gained.select(F.col("to").alias("block"), F.col("up_a").alias("a"), F.col("up_b").alias("b"), "more_saved", "more_leaves"), ["block", "a", "b"], "left")
        rows = settle(rows.select("block", "a", "b", "up_a", "up_b", "children", *((F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in ("saved", "leaves"))))
        step *= 2
    return rows.select("block", "a", "b", "children", "saved", "leaves")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, x, y, conv_id) to strings of up to IDS ids of one node: depth, x, y, first, ids."""
    key, ids = None, []
    names = ["depth", "x", "y", "first", "ids"]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, (*key, ids[0], ",".join(map(str, ids))), strict=True))], pa.schema([*((x, pa.int64()) for x in names[:-1]), (names[-1], pa.string())]))

    for batch in batches:
        out = []
        for *at, one in zip(*(batch.column(x).to_pylist() for x in ("depth", "x", "y", "conv_id")), strict=True):
            if at != key or len(ids) == IDS:
                out += [row()] if ids else []
                key, ids = at, []
            ids.append(one)
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
    if ids:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings in order to one digest of each node, whatever its length: only the digest so far is held."""
    key, state, found = None, None, []
    schema = pa.schema([*((x, pa.int64()) for x in ("depth", "x", "y")), ("ends_sha256", pa.string())])
    for batch in batches:
        for *at, ids in zip(*(batch.column(x).to_pylist() for x in ("depth", "x", "y", "ids")), strict=True):
            if at != key:
                found += [(*key, state.hexdigest())] if key else []
                key, state = at, sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if found:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in found], schema)
            found = []
    if key:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, state.hexdigest()), strict=True))], schema)


def _ends(wide: DataFrame) -> DataFrame:
    """depth, x, y and the digest of the ids of the conversations that end at that node."""
    last = wide.where(F.col("block") == F.expr(f"greatest(n - 1, 0) div {BLOCK}"))
    rows = last.select(F.col("n").cast("long").alias("depth"), _xor(F.col("a"), F.col("x")).alias("x"), _xor(F.col("b"), F.col("y")).alias("y"), "conv_id")
    by, node = ["depth", "x", "y", "conv_id"], ["depth", "x", "y"]
    parts = rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_joined, "depth long, x long, y long, first long, ids string")
    return parts.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(_hashed, "depth long, x long, y long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node.

    Null roles and texts are empty. A conversation without rebuilt turns is a member of the root alone; an empty table has no
    conversations, so no node. Turns that repeat are turns of their own. Very long texts are read once, as digests.
    """
    wide = blocks(*rebuilt(turns(conversations)))
    nodes = _rolled(wide, "min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS longest")
    depth = (F.col("block") * BLOCK + F.col("d")).cast("long")
    marks = {lane: [_mark(lane, F.col("block") * BLOCK + i, F.col(t)) for i, t in enumerate(TURNS)] for lane in "xy"}
    digests = {"x": _xor(F.col("a"), *marks["x"]), "y": _xor(F.col("b"), *marks["y"])}
    chars = F.coalesce(F.substring_index("last", ":", -1).try_cast("long"), F.lit(0).cast("long"))
    nodes = nodes.withColumns({"depth": depth, "own": (F.col("n_convs") - 1) * chars, "leaf": (F.col("longest") == depth).cast("long"), **digests})
    nodes = settle(nodes.select("block", "a", "b", *TURNS, "d", "x", "y", "conv_id", "n_convs", "own", "leaf"))
    below, zero = _below(nodes), F.lit(0).cast("long")
    if below is None:
        nodes = nodes.withColumns({"next": zero, "far_saved": zero, "far_leaves": zero})
    else:
        far = below.select((F.col("block") - 1).alias("k"), F.col("a").alias("x"), F.col("b").alias("y"), F.col("children").alias("next"), F.col("saved").alias("far_saved"), F.col("leaves").alias("far_leaves"))
        on = nodes.where(f"d = {BLOCK}").withColumn("k", F.col("block")).join(far, ["k", "x", "y"], "left").drop("k")
        nodes = on.unionByName(nodes.where(f"d < {BLOCK}"), allowMissingColumns=True)
    sums = "min(conv_id) AS conv_id, max(n_convs) AS n_convs, sum(own + coalesce(far_saved, 0)) AS saved_tokens, sum(leaf + coalesce(far_leaves, 0)) AS n_leaves, sum(coalesce(next, 0)) AS next, "
    sums += ", ".join(f"count_if(d = {i}) AS c{i}" for i in range(1, BLOCK + 1))
    full = _rolled(nodes, sums).withColumns({"depth": depth, **digests})
    children = F.element_at(F.array(*(F.col(f"c{i}") for i in range(1, BLOCK + 1)), F.col("next")), F.col("d").cast("int") + 1)
    back = [_mark(lane, F.col("depth") - 1, F.when(F.col("d") > 0, F.col("last"))) for lane in "xy"]
    full = full.withColumns({"n_children": children, "above": F.col("depth") - 1, "px": _xor(F.col("x"), back[0]), "py": _xor(F.col("y"), back[1])})
    full = settle(full.select("depth", "x", "y", "above", "px", "py", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))
    parents = full.select(F.col("depth").alias("above"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    counts = parents.where("n_children > 0").select("above", "px", "py", F.col("n_children").alias("many"))
    rows = looked_up(full.where("depth > 0"), ["above", "px", "py"], parents.drop("n_children"), counts)
    rows = rows.unionByName(full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = rows.join(_ends(wide), ["depth", "x", "y"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
