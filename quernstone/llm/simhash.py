"""Near-duplicates by SimHash fingerprints joined on pigeonhole blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import body, components, cut

_SPACES = bytes(0x20 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_HASHED = 1 << 15
_MANY_SPACES = re.compile(b" {2,}")


def fingerprint(text: str, size: int = 4) -> int:
    """Majority bits over XXH64 (seed 42) of the word shingles; zero without words, the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    raw = text.encode().translate(_SPACES).strip(b" ")
    if b"  " in raw:
        raw = _MANY_SPACES.sub(b" ", raw)
    if not raw:
        return 0
    spaces = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(raw)]
    if len(starts) > size:
        ends = ends[size - 1 :]
    else:
        starts, ends = [0], [len(raw)]
    n = len(ends)
    sums = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _HASHED):
        hashes = np.array([xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts[at : at + _HASHED], ends[at : at + _HASHED], strict=False)], dtype="<u8")
        sums += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = 4) -> DataFrame:
    """(row, id, hash, fp): fingerprint of every whole text as a signed long, and XXH64 of the text to tell rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch.column(3).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found.view(np.int64))], ["row", "id", "hash", "fp"])

    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(body(text_col)).alias("hash"), body(text_col).alias("text"))
    return rows.mapInArrow(run, f"row long, id {kind}, hash long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Signed 64-bit masks of the choices of (blocks - distance) blocks: a close pair agrees on all bits of one of them."""
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]
    masks = [sum(own[k] for k in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def spanning_links(fps: np.ndarray, labels: np.ndarray, distance: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links (a, b) between close fingerprints that join what ``labels`` still holds apart; ``split``: only across it."""
    out: list[tuple[int, int]] = []
    names = {x: x for x in set(labels.tolist())}

    def root(x: int) -> int:
        while names[x] != x:
            names[x] = x = names[names[x]]
        return x

    n, bits = len(fps), np.ascontiguousarray(fps).view(np.uint64)  # bit counts of signed numbers would be those of their absolute values
    for k in range(n - 1 if split is None else split):
        other = slice(k + 1, n) if split is None else slice(split, n)
        near = np.flatnonzero((np.bitwise_count(bits[other] ^ bits[k]) <= distance) & (labels[other] != labels[k]))
        for j in near.tolist():
            a, b = root(int(labels[k])), root(int(labels[other.start + j]))
            if a != b:
                names[a] = b
                out.append((int(fps[k]), int(fps[other.start + j])))
    return out


def near_components(distinct: DataFrame, distance: int = 4, block_rows: int = 512) -> DataFrame:
    """(node, root) for the distinct fingerprints ``fp`` that have another within ``distance`` differing bits.

    The bits are cut into more blocks than pairs may differ in, the more the more fingerprints there are, so every
    close pair shares the key of one choice of blocks. Members of a key are compared in blocks of about
    ``block_rows``; each yields no more than a spanning forest of its links. Keys with more members than that are
    finished after a first pass of components: where a key still holds different components, the members outside its
    largest one meet all others, each pair of blocks as a row of its own, dealt by key and both block numbers, so a key
    of any size spreads over all tasks. Only links between components come out. No link is lost, and no list of all
    pairs is made.
    """
    count = distinct.count()
    blocks = distance + (2 if count < 1 << 27 else 3 if count < 1 << 33 else 4)
    masks = block_masks(blocks, distance)
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])).alias("k")
    index = distinct.select("fp", keys).select("fp", "k.t", "k.key")
    sizes = index.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(index.join(sizes, ["t", "key"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / block_rows))))

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            out = [x for a, b in zip(at, at[1:], strict=False) for x in spanning_links(flat[a:b], flat[a:b], distance)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                left, left_root, right, right_root = (batch.column(c)[k].values.to_numpy() for c in range(4))
                if left_root.min() != left_root.max() or (right_root != left_root[0]).any():
                    out += spanning_links(np.concatenate([left, right]), np.concatenate([left_root, right_root]), distance, len(left))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    local = shared.groupBy("t", "key", "part").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")
    links = cut(local.mapInArrow(inner, "a long, b long").distinct())
    found = components(links)
    large = shared.where(F.col("n") > block_rows)
    if large.isEmpty():
        return found
    named = cut(large.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("t", "key", "part", "fp", F.coalesce("root", "fp").alias("root")))
    roots = named.groupBy("t", "key", "root").agg(F.count("*").alias("m"))
    mains = roots.groupBy("t", "key").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    blocks_of = lambda n: F.ceil(n / block_rows).cast("int")
    mains = cut(mains.select("t", "key", F.col("main.root").alias("main"), blocks_of(F.col("n")).alias("parts"), blocks_of(F.col("n") - F.col("main.m")).alias("stray_parts")))
    mixed = named.join(mains, ["t", "key"])
    block = lambda df, *by: df.groupBy("t", "key", *by).agg(F.collect_list(F.struct("fp", "root")).alias("m"))
    strays = block(mixed.where("root <> main").withColumn("i", F.pmod(F.xxhash64("fp", F.lit(1)), "stray_parts").cast("int")), "i", "parts")
    whole = block(mixed.withColumn("j", F.col("part").cast("int")), "j", "stray_parts")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = strays.select("t", "key", "i", upto("parts").alias("j"), F.col("m.fp").alias("l_fp"), F.col("m.root").alias("l_root"))
    right = whole.select("t", "key", upto("stray_parts").alias("i"), "j", F.col("m.fp").alias("r_fp"), F.col("m.root").alias("r_root"))
    tiles = left.join(right, ["t", "key", "i", "j"]).select("l_fp", "l_root", "r_fp", "r_root")
    more = cut(tiles.mapInArrow(across, "a long, b long").distinct())
    return components(links.union(more))


def near_dedup(docs: DataFrame, id_col: str, text_col: str, size: int = 4, distance: int = 4) -> DataFrame:
    """(id, hash, row, fp, component_id) for every row: smallest identifier among the texts reachable by links.

    Equal fingerprints are linked, those of texts without words (zero) like any other; a null text is empty. Null
    identifiers are never the smallest unless a component has no other. Repeated rows give a row each and are told apart
    by ``row``; fingerprints are saved before they are compared, so a lost executor can't renumber them half-way. A very
    long text is one fingerprint, computed from hashes in pieces. Other columns are not read.
    """
    signed = cut(fingerprints(docs, id_col, text_col, size))
    distinct = cut(signed.groupBy("fp").agg(F.min("id").alias("first")))
    found = near_components(distinct.select("fp"), distance)
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # saved, so that the join below reads two plain shuffles and a giant component can be split
    smallest = cut(named.groupBy("root").agg(F.min("first").alias("component_id")))
    return signed.join(named.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id"), "fp")
