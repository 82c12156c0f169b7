"""Prefix trie of conversations: padded matrices of turn ids in sorted shards, nodes on shard boundaries put together."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import cut

#: Bytes of a turn's digest and cells of a matrix at most (a longer single conversation is a matrix of its own).
_WIDTH, _CELLS = 16, 1 << 20
_EMPTY = hashlib.sha256().hexdigest()
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
_NODES = pa.schema([
    ("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), *[(c, pa.int64()) for c in _SUMS],
    ("ends_sha256", pa.string()), ("ends", pa.string()), ("shard", pa.int64()), ("number", pa.int64()),
])
_NODES_SQL = "key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string, shard long, number long"


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, token, size): a digest of role and text, 128 bits of SHA-256, and the text's UTF-8 bytes.

    Null role or text counts as empty. Rows without a conversation belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    own = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.unhex(F.substring(digest, 1, 2 * _WIDTH)).alias("token"), F.octet_length(text).alias("size"))
    return own.where("conv_id is not null")


def _packed(rows: DataFrame, turns_col: str) -> DataFrame:
    joined = F.array_join(F.transform(turns_col, lambda t: F.hex(t["token"])), "")
    return rows.select("conv_id", F.unhex(joined).alias("seq"), F.transform(turns_col, lambda t: t["size"]).alias("sizes"))


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes) of conversations given by ``turns``: their turns' digests in a row and the texts' sizes.

    Turns ascend by number, null first; equal numbers by digest. A conversation is one row of 20 bytes a turn.
    """
    return _packed(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "token", "size"))).alias("turns")), "turns")


def regrown(rows: DataFrame, family: int, shared: int) -> DataFrame:
    """``sequences`` in which conversation c takes its first h turns from conversation c - c % family, h = crc32(c) % shared.

    c's own turns after its first h follow. A family is ``family`` neighbouring conversations, so the turns are dealt out
    by family once and no conversation moves again.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    dealt = rows.withColumn("base", base).repartition("base")
    whole = dealt.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "token", "size"))).alias("turns"))
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, shared - 1)), ignorenulls=True).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    led = whole.withColumn("head", head).withColumn("h", h)
    taken = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", 1, F.col("h")))
    return _packed(led.withColumn("turns", F.concat(taken, F.slice("turns", F.col("h") + 1, F.size("turns")))), "turns")


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with alike."""
    n = min(len(a), len(b)) // _WIDTH
    differ = np.flatnonzero((np.frombuffer(a, np.uint8, n * _WIDTH) != np.frombuffer(b, np.uint8, n * _WIDTH)).reshape(-1, _WIDTH).any(axis=1))
    return int(differ[0]) if len(differ) else n


def _boundaries(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """For each shard the turns its first row shares with the row before and its last with the row after; -1 without one."""
    ends = cut(ordered.groupBy("shard").agg(F.min_by("seq", "at").alias("first"), F.max_by("seq", "at").alias("last")))
    shards = sorted(r[0] for r in ends.select("shard").collect())
    if not shards:
        return {}
    pairs = ordered.sparkSession.createDataFrame([*zip(shards, shards[1:], strict=False)] or [(-1, -1)], "shard long, after long")
    next_ = ends.select(F.col("shard").alias("after"), F.col("first").alias("next"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [_common(a, b) for a, b in zip(batch.column("last").to_pylist(), batch.column("next").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("after"), pa.array(same, pa.int64())], ["shard", "after", "same"])

    met = ends.join(pairs, "shard").join(next_, "after").select("shard", "after", "last", "next").mapInArrow(run, "shard long, after long, same long").collect()
    before, after = {r.after: r.same for r in met}, {r.shard: r.same for r in met}
    return {s: (before.get(s, -1), after.get(s, -1)) for s in shards}


def _keys(seq: bytes, depth: int) -> list[bytes]:
    """Names of the prefixes of 0 to ``depth`` turns."""
    found, state = [], hashlib.blake2b(digest_size=_WIDTH)
    for d in range(depth + 1):
        found.append(state.digest())
        state.update(seq[d * _WIDTH : (d + 1) * _WIDTH])
    return found


def chunk_nodes(convs: list[int], seqs: list[bytes], sizes: list[list[int]], before: int, after: int, shard: int, number: int) -> pa.RecordBatch:
    """The nodes of a chunk of sorted rows; ``before`` and ``after`` say how many turns the rows outside share with it.

    A node that goes on outside has a ``key``; its sums count what lies or begins in the chunk, so they add up.
    """
    conv, length = np.array(convs, dtype=np.int64), np.array([len(s) // _WIDTH for s in seqs])
    m, w = len(conv), int(length.max())
    flat = np.frombuffer(b"".join(seqs), dtype=">u8").reshape(-1, 2)
    by = np.lexsort((flat[:, 1], flat[:, 0]))
    new = np.ones(len(flat), dtype=np.int64)
    new[1:] = (flat[by[1:]] != flat[by[:-1]]).any(axis=1)
    ids = np.empty(len(flat), dtype=np.int32)
    ids[by] = np.cumsum(new)
    held = np.arange(w) < length[:, None]
    turn, size = np.zeros((m, w), dtype=np.int32), np.zeros((m, w), dtype=np.int64)
    turn[held], size[held] = ids, np.array([x for s in sizes for x in s], dtype=np.int64)
    order = np.lexsort((conv, *turn.T[::-1]))
    conv, length, held, turn, size = conv[order], length[order], held[order], turn[order], size[order]

    changed = np.empty((m, w), dtype=bool)
    changed[0], changed[1:] = np.arange(w) >= before, turn[1:] != turn[:-1]
    np.logical_or.accumulate(changed, axis=1, out=changed)
    starts = changed & held
    same = np.append(w - changed[1:].sum(axis=1), after)
    leaf = (same < length).astype(np.int64)
    saved = np.cumsum(np.where(starts, 0, size)[:, ::-1], axis=1)[:, ::-1]
    first, last = _keys(seqs[order[0]], max(before, 0)), _keys(seqs[order[-1]], max(after, 0))

    columns: dict[str, list] = {f.name: [] for f in _NODES}
    rows, above, above_conv, above_key = np.arange(m), np.zeros(m, dtype=np.int64), np.zeros(0, dtype=np.int64), []
    for d in range(w + 1):
        if d:
            rows = np.flatnonzero(held[:, d - 1])
        begins = starts[rows, d - 1].copy() if d else np.zeros(m, dtype=bool)
        going_on = before >= d and not begins[0]
        begins[0] = True
        at = np.flatnonzero(begins)
        n = len(at)
        sums = [np.diff(np.append(at, len(rows)))]
        sums.append(np.add.reduceat(starts[rows, d].astype(np.int64), at) if d < w else np.zeros(n, dtype=np.int64))
        sums.append(np.add.reduceat(leaf[rows], at))
        sums.append(np.add.reduceat(saved[rows, max(d - 1, 0)], at) if w else np.zeros(n, dtype=np.int64))
        least = np.minimum.reduceat(conv[rows], at)
        key: list[bytes | None] = [None] * n
        if going_on:
            key[0] = first[d]
        if after >= d and rows[-1] == m - 1:
            key[-1] = last[d]
        parent = above[rows[at]]
        over = [above_key[p] for p in parent] if d else [None] * n
        own: list[str | None] = [_EMPTY if k is None else None for k in key]
        part: list[str | None] = [None] * n
        for k in np.flatnonzero(ended := np.add.reduceat((length[rows] == d).astype(np.int64), at)):
            text = ",".join(map(str, conv[rows[at[k]] : rows[at[k]] + ended[k]].tolist()))
            if key[k] is None:
                own[k] = hashlib.sha256(text.encode()).hexdigest()
            else:
                part[k] = text
        columns["key"] += key
        columns["parent_key"] += over
        columns["depth"] += [d] * n
        columns["conv_id"] += least.tolist()
        columns["parent_conv_id"] += [None if o is not None or not d else int(above_conv[p]) for o, p in zip(over, parent, strict=True)]
        for name, s in zip(_SUMS, sums, strict=True):
            columns[name] += s.tolist()
        columns["ends_sha256"] += own
        columns["ends"] += part
        above, above_conv, above_key = np.zeros(m, dtype=np.int64), least, key
        above[rows] = np.cumsum(begins) - 1
    count = len(columns["depth"])
    columns["shard"], columns["number"] = [shard] * count, [number] * count
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _NODES], schema=_NODES)


def trie(seqs: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``seqs`` (conv_id, seq, sizes): (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256), a row a distinct prefix, the empty one included.

    Rows are sorted by (seq, conv_id) in sampled ranges, so equal conversations may lie in several shards and none is too
    large for a task. A shard streams through in chunks of bounded cells: turn ids in a padded matrix, lexsort, changes
    OR-accumulated along the columns, reduceat for every depth. The turns that neighbouring shards share are compared
    first, so each node is counted where it begins; what a chunk holds of a node that goes on outside is a row with a
    key, and these rows are summed by key. The identifiers of conversations that end in such a node go in pieces, sorted,
    through one digest (SHA-256 can't be divided) without being held together. No conversation gives no node.
    """
    ordered = cut(seqs.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id"))
    ordered = ordered.withColumn("shard", F.spark_partition_id().cast("long")).withColumn("at", F.monotonically_increasing_id())
    known = ordered.sparkSession.sparkContext.broadcast(_boundaries(ordered))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        longest, shard, number, before = 0, None, 0, -1
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not number and not held:
                    before = known.value[shard][0]
                turns_of = len(row[1]) // _WIDTH
                if held and (len(held) + 1) * (max(longest, turns_of) + 1) > _CELLS:
                    same = _common(held[-1][1], row[1])
                    yield chunk_nodes(*map(list, zip(*held, strict=True)), before, same, shard, number)
                    held, longest, number, before = [], 0, number + 1, same
                held.append(row)
                longest = max(longest, turns_of)
        if held:
            yield chunk_nodes(*map(list, zip(*held, strict=True)), before, known.value[shard][1], shard, number)

    found = cut(ordered.select("shard", "conv_id", "seq", "sizes").mapInArrow(run, _NODES_SQL))
    open_ = found.where("key is not null")
    summed = open_.groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in _SUMS])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for key, part in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if key == last:
                    state.update(b"," + part.encode())
                    continue
                if last is not None:
                    done.append((last, state.hexdigest()))
                last, state = key, hashlib.sha256(part.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["key", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])

    pieces = open_.where("ends is not null").select("key", "shard", "number", "ends")
    ends = pieces.repartition("key").sortWithinPartitions("key", "shard", "number").select("key", "ends").mapInArrow(hashed, "key binary, ends_sha256 string")
    summed = cut(summed.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))))

    whole = found.where("key is null")
    out = ["conv_id", "depth", "parent_conv_id", *_SUMS, "ends_sha256"]
    parts = ["conv_id", "depth", "parent_key", *_SUMS, "ends_sha256"]
    below = whole.where("parent_key is not null").select(*parts).union(summed.where("parent_key is not null").select(*parts))
    hung = below.join(summed.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key")
    tops = summed.where("parent_key is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return whole.where("parent_key is null").select(*out).union(hung.select(*out)).union(tops.select(*out))
