"""A Merkle manifest of a table of documents, and octopus multiproofs of its leaves.

Each language is a tree of its own over its documents in the order of their ids, eight children to a node; the trees'
roots are the leaves of a last tree. Trees grow in blocks of 4,096 leaves, four levels at a time. To prove leaves, each
block of them works out the least set of node coordinates that its own leaves can't give, fetches these nodes once, derives
the interior nodes that its leaves share, and expands the path of each leaf where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .tables import settle

#: Children of a node; levels that a block of leaves has of its own; leaves of a block.
ARITY, LEVELS = 8, 4
BLOCK = ARITY**LEVELS
#: Blocks that share a copy of a node which many blocks ask for.
SHARED = 4096
_NODE = "tree string, level int, at long, digest string"
_PATH = "path array<struct<`left`: string, `right`: string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The digest of a document: each field as its length in bytes, a colon and its value, or `-` for a null."""
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256)


def missing(own: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(level, place) of the fewest nodes that, beside the leaves `own` of a tree of n, give the paths of all of these."""
    found, level, own = [], 0, np.unique(own)
    while n > 1:
        above = np.unique(own // ARITY)
        children = (above[:, None] * ARITY + np.arange(ARITY)).ravel()
        found += [(level, int(x)) for x in np.setdiff1d(children[children < n], own, assume_unique=True)]
        own, n, level = above, -(-n // ARITY), level + 1
    return found


def expanded(own: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> dict[int, list[tuple[str, str]]]:
    """For each of the leaves `own` (place: digest) its path: at each level the digests left and right of its node in its run."""
    levels, nodes, count = [], dict(own), n
    while count > 1:
        level = len(levels)
        nodes |= {at: x for (k, at), x in fetched.items() if k == level}
        runs = {p: [nodes[c] for c in range(p * ARITY, min((p + 1) * ARITY, count))] for p in {c // ARITY for c in nodes}}
        levels.append({p: "".join(x) for p, x in runs.items()})
        nodes, count = {p: digest(x) for p, x in levels[-1].items()}, -(-count // ARITY)
    paths: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def path(level: int, at: int) -> list[tuple[str, str]]:
        if level == len(levels):
            return []
        if (level, at) not in paths:
            run, cut = levels[level][at // ARITY], 64 * (at % ARITY)
            paths[level, at] = [(run[:cut], run[cut + 64 :]), *path(level + 1, at // ARITY)]
        return paths[level, at]

    return {at: path(0, at) for at in own}


def _raised(level: int):
    """The nodes of up to LEVELS levels above a block of nodes at `level`."""

    def run(table: pa.Table) -> pa.Table:
        at = table["at"].to_numpy()
        nodes, first, out = table["digest"].take(np.argsort(at)).to_pylist(), int(at.min()), []
        for up in range(1, LEVELS + 1):
            nodes, first = [digest("".join(nodes[i : i + ARITY])) for i in range(0, len(nodes), ARITY)], first // ARITY
            out += [(level + up, first + i, x) for i, x in enumerate(nodes)]
        levels, places, digests = zip(*out, strict=True)
        tree = pa.array([table["tree"][0].as_py()] * len(out), pa.string())
        return pa.table([tree, pa.array(levels, pa.int32()), pa.array(places, pa.int64()), pa.array(digests)], ["tree", "level", "at", "digest"])

    return run


class Forest:
    """Trees over `leaves` (tree, at, digest): `sizes` (tree, n), `nodes` above the leaves, and `tops` (tree, n, top)."""

    def __init__(self, leaves: DataFrame):
        self.leaves = leaves
        self.sizes = settle(leaves.groupBy("tree").agg(F.count("*").alias("n")))
        largest = self.sizes.agg(F.max("n")).first()[0] or 0
        level, at, made = 0, leaves.select("tree", "at", "digest"), []
        while largest > 1:
            raised = settle(at.groupBy("tree", F.expr(f"at div {BLOCK}")).applyInArrow(_raised(level), _NODE))
            # A tree ends at its first level of one node; what a block alone has raised beyond that isn't in it.
            inside = raised.join(self.sizes, "tree").where("shiftleft(1L, 3 * (level - 1)) < n")
            made.append(inside)
            level, largest = level + LEVELS, -(-largest // BLOCK)
            at = inside.where((F.col("level") == level) & F.expr("shiftleft(1L, 3 * level) < n")).select("tree", "at", "digest")
        alone = leaves.join(self.sizes.where("n = 1"), "tree").select("tree", F.lit(0).alias("level"), "at", "digest", "n")
        self.nodes = reduce(DataFrame.unionByName, made or [alone.limit(0)])
        self.tops = self.nodes.where("shiftleft(1L, 3 * level) >= n").unionByName(alone).select("tree", "n", F.col("digest").alias("top"))


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tree, block, n, own in zip(*(batch.column(x).to_pylist() for x in ("tree", "block", "n", "own")), strict=True):
            need = missing(np.array(own, np.int64), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * len(need), pa.string()), pa.array([block] * len(need), pa.int64()), pa.array([x for x, _ in need], pa.int32()), pa.array([x for _, x in need], pa.int64())],
                ["tree", "block", "level", "at"],
            )


def _expand(carried: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at, digests = left["at"].to_pylist(), left["digest"].to_pylist()
        own, about = dict(zip(at, digests, strict=True)), right.slice(0, 1).to_pylist()[0]
        fetched = {(x["level"], x["at"]): x["digest"] for x in about["nodes"] or []}
        tail = [(x["left"], x["right"]) for x in about["tail"] or []]
        paths = expanded(own, fetched, about["n"])
        steps = [paths[x] + tail for x in at]
        flat = [x for path in steps for x in path]
        pairs = pa.StructArray.from_arrays([pa.array([x for x, _ in flat], pa.string()), pa.array([x for _, x in flat], pa.string())], ["left", "right"])
        ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in steps]))), pa.int32())
        top = [pa.array([about[x]] * len(at), pa.string()) for x in ("top", "root")]
        return pa.table([*(left[x] for x in ("tree", "at", "digest", *carried)), *top, pa.ListArray.from_arrays(ends, pairs)], ["tree", "at", "digest", *carried, "top", "root", "path"])

    return run


def paths(forest: Forest, above: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """The chosen leaves (all, if none are given) with top, root and path, from the leaf to the root of everything.

    above: tree, top, root and tail, the path from the tree's top on. Nodes asked for by many blocks are dealt in copies,
    each for SHARED blocks at most, so no key of the fetch has more rows than that.
    """
    leaves = forest.leaves if chosen is None else chosen
    carried = [x for x in leaves.columns if x not in ("tree", "at", "digest")]
    leaves = leaves.withColumn("block", F.expr(f"at div {BLOCK}"))
    blocks = settle(leaves.groupBy("tree", "block").agg(F.collect_list("at").alias("own")).join(forest.sizes, "tree"))
    wanted = blocks.mapInArrow(_wanted, "tree string, block long, level int, at long").withColumn("share", F.expr(f"block div {SHARED}"))
    span = f"{BLOCK * SHARED}L"
    nodes = forest.nodes
    if chosen is not None:
        nodes = nodes.unionByName(forest.leaves.select("tree", F.lit(0).alias("level"), "at", "digest").join(forest.sizes, "tree"))
    under = nodes.withColumn("first", F.expr("shiftleft(at div 8, 3 * (level + 1))")).withColumn("last", F.expr("least(first + shiftleft(1L, 3 * (level + 1)), n) - 1"))
    dealt = under.select("tree", "level", "at", "digest", F.explode(F.expr(f"sequence(first div {span}, last div {span})")).alias("share"))
    fetched = wanted.join(dealt, ["tree", "level", "at", "share"]).groupBy("tree", "block").agg(F.collect_list(F.struct("level", "at", "digest")).alias("nodes"))
    tops = above.join(forest.sizes, "tree").select("tree", "top", "root", "tail", F.explode(F.expr(f"sequence(0L, (n - 1) div {span})")).alias("share"))
    about = blocks.select("tree", "block", "n", F.expr(f"block div {SHARED}").alias("share")).join(fetched, ["tree", "block"], "left").join(tops, ["tree", "share"])
    kinds = dict(leaves.dtypes)
    schema = ", ".join([*(f"`{x}` {kinds[x]}" for x in ("tree", "at", "digest", *carried)), "top string", "root string", _PATH])
    return leaves.groupBy("tree", "block").cogroup(about.groupBy("tree", "block")).applyInArrow(_expand(carried), schema)


def manifest(docs: DataFrame) -> Forest:
    """The trees of the languages. Leaves: tree, at, digest, doc_id, lang and `tampered`, the digest with the letters A-Z of the
    text lower-cased where 3 divides the id's CRC-32, else null. A null language is one of its own; rows that repeat an id
    lie beside each other by their digests; rows without an id come first. An empty table has no trees."""
    c = {x: F.col(x) for x in ("doc_id", "source", "lang", "n_chars", "text")}
    text = c["text"].cast("string")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(**c | {"text": F.translate(text, UPPER, LOWER)}))
    leaves = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), leaf(**c).alias("digest"), tampered.alias("tampered"))
    placed = ranked(settle(leaves), ["lang"], ["doc_id", "digest"], "at")
    return Forest(placed.withColumn("tree", F.to_json(F.struct("lang"))))


def proofs(docs: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """doc_id, digest (the leaf), tampered, top (its tree's root), root, and path: `left` and `right` digests of each level.

    chosen: a table of doc_ids to prove, all if none is given. Each of its ids is proved from the nodes that the
    others leave missing. Very long texts are hashed where they are read; only digests move.
    """
    forest = manifest(docs)
    some = None if chosen is None else forest.leaves.join(chosen.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    lang = F.from_json("tree", "lang string")["lang"].alias("lang")
    last = ranked(settle(forest.tops.select("tree", lang, F.col("top").alias("digest"))), [], ["lang"], "at")
    crown = Forest(last.select(F.lit("").alias("tree"), "at", "digest", F.col("tree").alias("inner")))
    root = crown.tops.select("tree", "top", F.col("top").alias("root"), F.lit(None).cast(_PATH.removeprefix("path ")).alias("tail"))
    above = settle(paths(crown, root).select(F.col("inner").alias("tree"), F.col("digest").alias("top"), "root", F.col("path").alias("tail")))
    return paths(forest, above, some).select("doc_id", "digest", "tampered", "top", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda x, step: F.sha2(F.concat(step["left"], x, step["right"]), 256))


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row: the path of the untampered leaf is
    folded with the tampered one, where there is one. A text without A-Z isn't changed by tampering, so it verifies."""
    siblings = F.array_join(F.flatten(F.transform("path", lambda x: F.array(x["left"], x["right"]))), "")
    found = proofs(docs).withColumn("folded_root", folded(F.coalesce("tampered", "digest"), F.col("path")))
    return found.select(
        "doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
