"""Merkle manifest of a table: a tree per group hashed in aligned blocks, tampered leaves as versions of that tree."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import cut

ARITY = 8
#: Levels that a task hashes at once: a block is 8^4 neighbouring nodes and ends in one.
DEPTH = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<at: int, run: array<binary>>>"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; a text of one byte a character takes the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def leaf(values: Sequence[Column]) -> Column:
    """SHA-256 (hex) of the values in order: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _hash(nodes: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    found = 0
    while n > 1:
        n, found = -(-n // ARITY), found + 1
    return found


def block_levels(nodes: list[bytes], n: int, depth: int = DEPTH) -> list[list[bytes]]:
    """The nodes of a block of 8^``depth``, level by level, in a tree over ``n`` nodes of the lowest one."""
    found = [nodes]
    for _ in range(min(depth, levels_of(n))):
        below = found[-1]
        found.append([_hash(below[k : k + ARITY]) for k in range(0, len(below), ARITY)])
    return found


def path_of(levels: list[list[bytes]], k: int) -> list[tuple[int, list[bytes]]]:
    """(place in its run, run) of node ``k`` and of each ancestor below the top of the block."""
    found = []
    for nodes in levels[:-1]:
        found.append((k % ARITY, nodes[k - k % ARITY : k - k % ARITY + ARITY]))
        k //= ARITY
    return found


def version(node: bytes, path: list[tuple[int, list[bytes]]]) -> list[bytes]:
    """The nodes that a version with ``node`` at the bottom of ``path`` copies, up to its root; all others are shared."""
    found = [node]
    for at, run in path:
        found.append(_hash([*run[:at], found[-1], *run[at + 1 :]]))
    return found


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (group, ..) with ``pos``, counted from 0 in each group by ``order``, and ``n``, the rows of the group.

    Ranges of (group, order) are sorted and saved; a row's number is its place in the range behind the rows of its group
    in earlier ranges, so a group of any size is spread over many tasks.
    """
    ranges = cut(rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order))
    placed = ranges.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33))
    runs = placed.groupBy("group", "range").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    same = Window.partitionBy("group")
    before = F.coalesce(F.sum("held").over(same.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("group", "range", (before - F.col("first")).alias("shift"), F.sum("held").over(same).alias("n"))
    return placed.join(starts, ["group", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def _tops(nodes: DataFrame, depth: int) -> DataFrame:
    """(group, pos, n, node): the top of every block of ``nodes`` (group, pos, n, node)."""

    block = ARITY**depth

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n = rows.column("n")[0].as_py()
        top = block_levels(rows.column("node").to_pylist(), n, depth)[-1][0]
        return pa.table({"group": rows.column("group")[:1], "pos": [rows.column("pos")[0].as_py() // block], "n": [-(-n // block)], "node": pa.array([top], pa.binary())})

    own = nodes.select("group", "pos", "n", "node", F.expr(f"pos div {ARITY**depth}").alias("block"))
    return own.groupBy("group", "block").applyInArrow(run, "group string, pos long, n long, node binary")


def tiers(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """``nodes`` and the tops of their blocks, again and again, until every group has one node; one step at least."""
    found = [nodes, cut(_tops(nodes, depth))]
    while (found[-1].agg(F.max("n")).first()[0] or 0) > 1:
        found.append(cut(_tops(found[-1], depth)))
    return found


def _paths(lower: DataFrame, upper: DataFrame, depth: int) -> DataFrame:
    """``lower`` (group, pos, node) with the path of each node to the root of all, given that of the tops of their blocks."""

    def run(rows: pa.Table, top: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        levels, rest = block_levels(rows.column("node").to_pylist(), rows.column("n")[0].as_py(), depth), top.column("path")[0].as_py()
        paths = [[{"at": at, "run": own} for at, own in path_of(levels, k)] + rest for k in range(len(rows))]
        kind = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.list_(pa.binary()))]))
        same = {c: pa.array([top.column(c)[0].as_py()] * len(rows), pa.binary()) for c in ("subroot", "root")}
        return pa.table({"group": rows.column("group"), "pos": rows.column("pos"), "node": rows.column("node"), "path": pa.array(paths, kind), **same})

    own = lower.select("group", "pos", "n", "node", F.expr(f"pos div {ARITY**depth}").alias("block"))
    pairs = own.groupBy("group", "block").cogroup(upper.groupBy("group", "pos"))
    return pairs.applyInArrow(run, f"group string, pos long, node binary, path {_PATH}, subroot binary, root binary")


def manifest(docs: DataFrame, id_col: str, fields: Sequence[str], group_col: str, tampered: Column, changed: dict[str, Column], depth: int = DEPTH) -> DataFrame:
    """(<id_col>, leaf, subroot, root, proof_sha256, copied, folded_root, verified) of every row of ``docs``.

    A leaf is the digest of the ``fields`` of a row. The leaves of a group, ascending by identifier (null first, repeated
    ones by leaf), form a tree in which every 8 neighbours become one node; its last node is ``subroot``. The subroots,
    ordered by the UTF-8 bytes of ``group_col`` (null first), form a tree that ends in ``root``. Where ``tampered`` is
    true a version of the trees holds the digest of the row with the columns ``changed``; it copies the nodes from that
    leaf to the root (``copied``) and shares all others. ``proof_sha256`` is the digest of the siblings on that way.
    ``folded_root`` is computed from the tampered leaf, else from the original one, and the original siblings.

    Only digests are shuffled. A block of 8^``depth`` nodes is hashed by one task; its top is a node of the next tier, which is
    dealt out alike. The ways from the tops to the root come down tier by tier, and the versions of a block are continued
    with the one of their block. Null values count as ``-``; a null identifier isn't tampered with unless ``tampered``
    says so; an empty table gives no rows; other columns aren't read; a very long text is hashed in its row.
    """
    named = {c: F.col(f"`{c}`") for c in fields}
    other = leaf([changed.get(c, v) for c, v in named.items()])
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    digests = docs.select(group.alias("group"), F.col(f"`{id_col}`").alias("id"), F.unhex(leaf([*named.values()])).alias("leaf"), F.when(tampered, F.unhex(other)).alias("other"))
    leaves = numbered(digests, ["id", "leaf", "other"])
    hexed = lambda c: F.lower(F.hex(c)).cast("binary")
    leaves = cut(leaves.select("group", "pos", "n", "id", hexed("leaf").alias("node"), hexed("other").alias("other")))
    trees = tiers(leaves, depth)

    subroots = trees[-1].select(F.lit("").alias("group"), F.col("group").alias("own"), "node")
    upper = tiers(cut(numbered(subroots, ["own"])), depth)
    none = F.lit(None).cast("binary")
    paths = upper[-1].select("group", "pos", "node", F.expr(f"cast(array() as {_PATH})").alias("path"), none.alias("subroot"), F.col("node").alias("root"))
    for tier in reversed(upper[:-1]):
        paths = _paths(tier, paths, depth)
    own = upper[0].select("pos", F.col("own").alias("group"))
    paths = cut(paths.drop("group").join(own, "pos").select("group", F.lit(0).cast("long").alias("pos"), "node", "path", F.col("node").alias("subroot"), "root"))
    for tier in reversed(trees[1:-1]):
        paths = cut(_paths(tier, paths, depth))

    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()

    def run(rows: pa.Table, top: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        nodes, others = rows.column("node").to_pylist(), rows.column("other").to_pylist()
        levels, rest = block_levels(nodes, rows.column("n")[0].as_py(), depth), [(x["at"], x["run"]) for x in top.column("path")[0].as_py()]
        above = [y for at, own in rest for y in (*own[:at], *own[at + 1 :])]
        proofs, copied = [], []
        for k, (node, changed_node) in enumerate(zip(nodes, others, strict=True)):
            way = path_of(levels, k)
            proofs.append(_hash([y for at, own in way for y in (*own[:at], *own[at + 1 :])] + above))
            copied.append(version(node if changed_node is None else changed_node, way + rest))
        root = top.column("root")[0].as_py()
        same = {c: pa.array([top.column(c)[0].as_py().decode()] * len(rows)) for c in ("subroot", "root")}
        return pa.table({
            "id": rows.column("id"), "leaf": rows.column("node").cast(pa.string()), **same, "proof_sha256": pa.array(proofs, pa.binary()).cast(pa.string()),
            "copied": pa.array([[x.decode() for x in c] for c in copied], pa.list_(pa.string())), "verified": pa.array([c[-1] == root for c in copied]),
        })

    own = leaves.withColumn("block", F.expr(f"pos div {ARITY**depth}"))
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, copied array<string>, verified boolean"
    found = own.groupBy("group", "block").cogroup(paths.groupBy("group", "pos")).applyInArrow(run, schema)
    return found.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "copied", F.element_at("copied", -1).alias("folded_root"), "verified")
