"""Near-duplicates among embeddings by NN-descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import components, cut

_PAIRS = "v long, u long, s double"
_MET = "v long, u long, s double, bridge boolean"


@dataclass(frozen=True)
class Descent:
    """k: first length of neighbour lists; longest: last one; block: rows compared at once; tables, rounds: effort.

    rows: members of a block when all pairs of a component are settled.
    """

    k: int = 8
    longest: int = 32
    block: int = 256
    tables: int = 4
    rounds: int = 3
    recall: float = 0.97
    audited: int = 500
    seed: int = 5
    rows: int = 1024


def _units(lists) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))
    # a component near the largest double would overflow when squared
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _batch(v: list, u: list, s: list) -> pa.RecordBatch:
    join = lambda xs, kind: pa.array(np.concatenate(xs) if xs else np.zeros(0), kind)
    return pa.RecordBatch.from_arrays([join(v, pa.int64()), join(u, pa.int64()), join(s, pa.float64())], ["v", "u", "s"])


def _best(ids: np.ndarray, sims: np.ndarray, need: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its ``k`` most similar others above what it needs; those at -2 are no candidates."""
    k = min(k, len(ids) - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(ids) else np.argsort(-sims, axis=1)[:, :k]
    s = np.take_along_axis(sims, top, axis=1)
    good = (s > need[:, None]) & (s > -2.0)
    return np.repeat(ids, good.sum(axis=1)), ids[top][good], s[good]


def _bridges(ids: np.ndarray, sims: np.ndarray, roots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the group's links between different components; ``sims`` is below any threshold on the diagonal."""
    v, u, s = [], [], []
    if (roots != roots[0]).any():
        linked, roots = sims >= threshold, roots.copy()
        for a in np.flatnonzero((linked & (roots[:, None] != roots)).any(axis=1)).tolist():
            others = np.flatnonzero(linked[a] & (roots != roots[a]))
            joined, first = np.unique(roots[others], return_index=True)
            for b in others[first].tolist():
                v.append(ids[a])
                u.append(ids[b])
                s.append(sims[a, b])
            roots[np.isin(roots, joined)] = roots[a]
    return np.array(v, dtype=np.int64), np.array(u, dtype=np.int64), np.array(s, dtype=np.float64)


def _tasks(spark: SparkSession, rows: int) -> int:
    """Partitions for a step that compares ``rows`` vectors with others: one per core at least, 8,192 rows each beyond."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // 8192))


def _joined(groups: DataFrame, k: int, threshold: float) -> DataFrame:
    """Rows (ids, xs, need, roots) of vectors that meet: each one's best candidates in other components, and bridges.

    Pairs of one component are settled at the end and take no place in the lists.
    A bridge is a link that joins two components as they stand, however many better candidates its ends have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            marks = []
            for n in range(batch.num_rows):
                ids = batch.column("ids")[n].values.to_numpy()
                if len(ids) > 1:
                    x = _units(batch.column("xs")[n].values)
                    need, roots = (batch.column(c)[n].values.to_numpy() for c in ("need", "roots"))
                    sims = x @ x.T
                    np.fill_diagonal(sims, -2.0)
                    bridges = _bridges(ids, sims, roots, threshold)
                    sims[roots[:, None] == roots] = -2.0
                    for bridge, some in ((False, _best(ids, sims, need, k)), (True, bridges)):
                        for column, found in zip(out, some, strict=True):
                            column.append(found)
                        marks.append(np.full(len(some[0]), bridge))
            yield _batch(*out).append_column("bridge", pa.array(np.concatenate(marks) if marks else [], pa.bool_()))

    return groups.mapInArrow(run, _MET)


def _lists(pairs: DataFrame, lengths: DataFrame | None, k: int) -> DataFrame:
    """Of each vector's distinct candidates the most similar, as many as its list is long; fresh if not listed before.

    Bridges come out whether they are listed or not.
    """
    rank = Window.partitionBy("v").orderBy(F.desc("s"), "u")
    ranked = pairs.groupBy("v", "u").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"), F.max("bridge").alias("bridge")).withColumn("rank", F.row_number().over(rank))
    if lengths is None:
        ranked = ranked.withColumn("listed", F.col("rank") <= k)
    else:
        ranked = ranked.join(lengths, "v", "left").withColumn("listed", F.col("rank") <= F.coalesce("k", F.lit(k))).drop("k")
    return ranked.where("listed or bridge").drop("rank")


def _merged(named: DataFrame, bridges: DataFrame) -> tuple[DataFrame, bool]:
    """(v, root) of all vectors with links after ``bridges`` (v, u) join components of ``named``; whether any did."""
    root = lambda side, name: named.select(F.col("v").alias(side), F.col("root").alias(name))
    ends = bridges.select("v", "u").join(root("v", "a"), "v", "left").join(root("u", "b"), "u", "left")
    edges = cut(ends.select(F.coalesce("a", "v").alias("a"), F.coalesce("b", "u").alias("b")).where("a <> b").distinct())
    if edges.isEmpty():
        return named, False
    joined = cut(components(edges).withColumnRenamed("root", "top"))
    moved = named.join(joined.withColumnRenamed("node", "root"), "root", "left").select("v", F.coalesce("top", "root").alias("root"))
    return cut(moved.union(joined.select(F.col("node").alias("v"), F.col("top").alias("root")).join(named, "v", "left_anti"))), True


def _seed_lists(points: DataFrame, named: DataFrame, threshold: float, how: Descent, size: int, salt: int) -> DataFrame:
    """Candidates and bridges from blocks of vectors that fall on the same sides of a few random planes."""
    bits = max(0, int(np.ceil(np.log2(max(size, 1) / how.block))))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(batch.column("x")) if batch.num_rows else np.zeros((0, 1))
            rng = np.random.default_rng((how.seed, salt, x.shape[1]))
            for t in range(how.tables):
                planes = rng.standard_normal((x.shape[1], bits))
                code = ((x @ planes > 0) * (1 << np.arange(bits))).sum(axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(code), batch.column("v"), batch.column("x")], ["t", "code", "v", "x"])

    kind = points.schema["x"].dataType.simpleString()
    coded = cut(points.select("v", "x").mapInArrow(sides, f"t int, code long, v long, x {kind}"))
    sizes = coded.groupBy("t", "code").agg(F.count("*").alias("n"))
    # a crowded block is dealt out by chance; what then doesn't meet is left to the other tables and to the descent
    part = F.pmod(F.xxhash64("v", "t"), F.ceil(F.col("n") / (2 * how.block))).alias("part")
    blocks = coded.join(sizes, ["t", "code"]).select("t", "code", part, "v", "x").join(named, "v", "left").withColumn("root", F.coalesce("root", "v"))
    blocks = blocks.repartition(_tasks(points.sparkSession, how.tables * size), "t", "code", "part").groupBy("t", "code", "part")
    return _joined(blocks.agg(F.collect_list("v").alias("ids"), F.collect_list("x").alias("xs"), F.collect_list(F.lit(-2.0)).alias("need"), F.collect_list("root").alias("roots")), how.k, threshold)


def _descend(lists: DataFrame, points: DataFrame, state: DataFrame, named: DataFrame, threshold: float, how: Descent, size: int) -> DataFrame:
    """One round: the neighbours of each vector, in either direction, meet one another.

    Neighbours of a vector that got no fresh one have met before, and neighbours that are all of one component have no
    link to find, as its pairs are settled at the end; neither are moved. A vector that many others list is joined over
    several groups of them, so no group outgrows a task and none is dropped. ``state`` holds (v, k, need) of the lists.
    """
    both = lists.select(F.col("v").alias("at"), F.col("u").alias("v"), "fresh").union(lists.select(F.col("u").alias("at"), "v", "fresh"))
    both = both.groupBy("at", "v").agg(F.min("fresh").alias("fresh"))
    known = points.select("v", "x").join(named, "v", "left").withColumn("root", F.coalesce("root", "v"))
    known = cut(known.join(state.select("v", "need"), "v", "left").withColumn("need", F.coalesce("need", F.lit(-2.0))))
    rooted = cut(both.join(known.select("v", "root"), "v"))
    sizes = rooted.groupBy("at").agg(F.count("*").alias("n"), F.max("fresh").alias("news"), (F.min("root") != F.max("root")).alias("mixed")).where("news and mixed")
    part = F.pmod(F.xxhash64("v", "at"), F.ceil(F.col("n") / (4 * how.k))).alias("part")
    near = rooted.join(sizes, "at").select("at", part, "v").join(known, "v")
    # small rows, but work enough for every core: the number of partitions is given, so that none are merged
    groups = near.repartition(_tasks(points.sparkSession, size), "at", "part").groupBy("at", "part").agg(F.collect_list("v").alias("ids"), F.collect_list("x").alias("xs"), F.collect_list("need").alias("need"), F.collect_list("root").alias("roots"))
    return _joined(groups.where("size(ids) > 1"), how.k, threshold)


def _audit(points: DataFrame, named: DataFrame, threshold: float, how: Descent, size: int) -> float:
    """Recall of links for a bounded sample of vectors, each compared with all others by brute force.

    It is the mean, over sampled vectors with links, of the share of their links found: a vector in a large group counts
    no more than one in a pair. A link counts as found if one component holds both ends, since all pairs of a component are compared at the end.
    """
    drawn = points.where(F.pmod(F.xxhash64("v", F.lit(how.seed)), F.lit(max(size, 1))) < how.audited).select("v", "x").limit(2 * how.audited).toPandas()
    if not len(drawn):
        return 1.0
    ids, q = drawn["v"].to_numpy(), _units(pa.array(drawn["x"].tolist()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                others = batch.column("v").to_numpy()
                a, b = np.nonzero((q @ _units(batch.column("x")).T >= threshold) & (ids[:, None] != others))
                yield _batch([ids[a]], [others[b]], [np.ones(len(a))])

    true = points.select("v", "x").mapInArrow(compare, _PAIRS)
    roots = named.select("v", "root")
    found = true.join(roots, "v", "left").join(roots.select(F.col("v").alias("u"), F.col("root").alias("other")), "u", "left")
    shares = found.groupBy("v").agg((F.count(F.when(F.col("root") == F.col("other"), 1)) / F.count("*")).alias("share"))
    recall = shares.agg(F.avg("share")).first()[0]
    return 1.0 if recall is None else recall


def _within(points: DataFrame, named: DataFrame, threshold: float, how: Descent) -> DataFrame:
    """(v, n) links of each vector inside its component, weighed by copies.

    Every pair is settled here, so lists that had to end at ``longest`` cost no link. Members are dealt into blocks, each
    with a centre and the largest angle to it. Where these angles alone show that all pairs of two blocks are links, or
    none is, the pair of blocks is counted as a whole; the others are compared, each pair of blocks as a row of its own.
    Counts come out, not pairs.
    """
    members = named.join(points, "v").select("root", "v", "x", "copies")
    sizes = cut(members.groupBy("root").agg(F.count("*").alias("n")))
    parts = F.ceil(F.col("n") / how.rows).cast("int")
    dealt = members.join(sizes, "root").select("root", parts.alias("parts"), F.pmod(F.xxhash64("v"), parts).cast("int").alias("part"), "v", "x", "copies")
    blocks = cut(dealt.groupBy("root", "part", "parts").agg(*[F.collect_list(c).alias(c) for c in ("v", "x", "copies")]))

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, radii, weights = [], [], []
            for r in range(batch.num_rows):
                x = _units(batch.column("x")[r].values)
                centre = x.mean(axis=0)
                length = np.sqrt(centre @ centre)
                centres.append(centre / length if length > 1e-9 else x[0])
                radii.append(float(np.arccos(np.clip(x @ centres[-1], -1, 1)).max()))
                weights.append(int(batch.column("copies")[r].values.to_numpy().sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "part", "parts")), pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64()), pa.array(weights, pa.int64())], ["root", "part", "parts", "c", "r", "w"])

    ball = cut(blocks.select("root", "part", "parts", "x", "copies").mapInArrow(balls, "root long, part int, parts int, c array<double>, r double, w long"))
    one = ball.select("root", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), F.struct("c", "r", "w").alias("a"))
    other = ball.select("root", F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"), F.struct("c", "r", "w").alias("b"))
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.aggregate(F.zip_with("a.c", "b.c", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p))))
    far, slack = F.lit(float(np.arccos(threshold))), F.lit(1e-6)
    reach = F.col("a.r") + F.col("b.r")
    verdict = F.when(apart + reach <= far - slack, "all").when(apart - reach >= far + slack, "none").otherwise("look")
    tiles = cut(one.join(other, ["root", "i", "j"]).select("root", "i", "j", verdict.alias("verdict"), F.col("a.w").alias("wa"), F.col("b.w").alias("wb")))
    whole = tiles.where("verdict = 'all'")
    given = whole.select("root", F.col("i").alias("part"), F.col("wb").alias("w")).union(whole.where("i <> j").select("root", F.col("j").alias("part"), F.col("wa").alias("w")))
    own = whole.where("i = j").select("root", F.col("i").alias("part"), F.lit(True).alias("own"))
    given = cut(given.groupBy("root", "part").agg(F.sum("w").alias("w")).join(own, ["root", "part"], "left"))
    lists = blocks.select("root", "part", F.explode(F.arrays_zip("v", "copies")).alias("m")).select("root", "part", "m.v", "m.copies")
    counted = lists.join(given, ["root", "part"]).select("v", (F.col("w") - F.when(F.col("own"), F.col("copies")).otherwise(F.lit(0))).alias("n"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs, ns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r in range(batch.num_rows):
                (v, x, c), (w, y, d) = ([batch.column(f"{side}_{k}")[r].values for k in ("v", "x", "copies")] for side in ("a", "b"))
                linked = _units(x) @ _units(y).T >= threshold
                same = batch.column("same")[r].as_py()
                if same:
                    np.fill_diagonal(linked, False)
                vs.append(v.to_numpy())
                ns.append(linked @ d.to_numpy())
                if not same:
                    vs.append(w.to_numpy())
                    ns.append(linked.T @ c.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(vs), pa.int64()), pa.array(np.concatenate(ns), pa.int64())], ["v", "n"])

    side = lambda at, s: blocks.select("root", F.col("part").alias(at), *[F.col(c).alias(f"{s}_{c}") for c in ("v", "x", "copies")])
    looked = tiles.where("verdict = 'look'").select("root", "i", "j").join(side("i", "a"), ["root", "i"]).join(side("j", "b"), ["root", "j"])
    looked = looked.withColumn("same", F.expr("i = j")).drop("root", "i", "j")
    return looked.mapInArrow(compare, "v long, n long").union(counted).groupBy("v").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame, id_col: str, vector_col: str, threshold: float = 0.95, how: Descent = Descent()) -> DataFrame:
    """(id, n_links, component_id, kept, recall) for every row.

    Equal vectors are one point of the search and links of each other. Neighbour lists start from random-plane blocks;
    each round joins neighbours of neighbours and keeps the best. A list whose last entry still reaches the threshold
    is saturated: it is made twice as long, up to ``longest``, and the descent goes on. Wherever vectors meet, a
    spanning forest of the links between components comes out beside the lists, so a link that ranks below full lists
    joins them all the same. When a round joins no components and no list grows, an audit compares a bounded sample with all
    others; below ``recall`` the search goes on with fresh planes, and one that stays below it fails. Pairs at or above
    the threshold, by cosine in double precision, make components, within which every pair is then compared and counted.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, not even with equal
    ones; vectors of different lengths never meet. Rows with a null identifier take part; the smallest identifier of a
    component ignores them, and they are only ``kept`` where a component has no other. Of rows that repeat the kept
    identifier one is kept. Other columns are not read.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast(f"array<{'float' if 'float' in vectors.schema[vector_col].dataType.simpleString() else 'double'}>").alias("x"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = F.col("x").isNotNull() & F.forall("x", finite) & F.exists("x", lambda c: c != 0)
    rows = rows.withColumn("x", F.when(usable, F.col("x")))
    points = rows.where("x is not null").groupBy("x").agg(F.count("*").alias("copies"), F.min("id").alias("first")).withColumn("v", F.monotonically_increasing_id())
    points = cut(points.select("v", "x", "copies", "first"))
    # one search for each length that several vectors have; a vector without another of its length has no link
    lengths_of_x = [r.dims for r in points.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).where("n > 1").orderBy("dims").collect()]
    parts = [_links(points.where(F.size("x") == n), threshold, how) for n in lengths_of_x]
    named = parts[0][0] if parts else None
    for found, _ in parts[1:]:
        named = named.union(found)
    recall = min([r for _, r in parts], default=1.0)
    if named is None:
        named = points.select(F.col("v"), F.lit(0).cast("long").alias("n"), F.col("v").alias("root"))
    merged = points.join(named, "v", "left").withColumn("root", F.coalesce("root", "v")).withColumn("others", F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
    smallest = cut(merged.groupBy("root").agg(F.min("first").alias("component_id")))
    merged = merged.join(smallest, "root").select("x", F.col("others").alias("n_links"), "component_id")
    all_rows = rows.join(merged, "x", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    out = cut(all_rows.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id"))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n_links"))) == 1
    heads = out.where(F.col("id") == F.col("component_id")).withColumn("kept", first)
    rest = out.where(~F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).withColumn("kept", F.isnull("component_id"))
    return heads.union(rest).withColumn("recall", F.lit(recall))


def _links(points: DataFrame, threshold: float, how: Descent) -> tuple[DataFrame, float]:
    """((v, n, root) of the points with links, audited recall) for vectors of one length."""
    size = points.count()
    state = points.select("v", F.lit(how.k).alias("k"), F.lit(-2.0).alias("need")).where("false")
    named = points.select("v", F.col("v").alias("root")).where("false")
    met = cut(_lists(_seed_lists(points, named, threshold, how, size, 0).withColumn("fresh", F.lit(True)), None, how.k))
    named, _ = _merged(named, met.where("bridge"))
    missed, audits = False, 0
    while True:
        lists = met.where("listed").drop("listed", "bridge")
        found = _descend(lists, points, state, named, threshold, how, size)
        if missed:
            found = found.union(_seed_lists(points, named, threshold, how, size, audits))
        known = lists.withColumn("bridge", F.lit(False))
        met = cut(_lists(known.union(found.withColumn("fresh", F.lit(True)).select(known.columns)), state.select("v", "k"), how.k))
        full = met.where("listed").groupBy("v").agg(F.count("*").alias("held"), F.min("s").alias("worst")).join(state.select("v", "k"), "v", "left")
        k = F.coalesce("k", F.lit(how.k))
        longer = F.when((F.col("held") >= k) & (F.col("worst") >= threshold), F.least(2 * k, F.lit(how.longest))).otherwise(k)
        grown = cut(full.select("v", longer.alias("k"), F.when(F.col("held") >= longer, F.col("worst")).otherwise(F.lit(-2.0)).alias("need"), (longer > k).alias("grew")))
        state, grew = grown.drop("grew"), not grown.where("grew").isEmpty()
        named, joined = _merged(named, met.where("bridge"))
        missed = not grew and not joined
        if missed:
            audits += 1
            recall = _audit(points, named, threshold, how, size)
            if recall >= how.recall:
                counted = _within(points, named, threshold, how)
                return named.join(counted, "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("n"), "root"), recall
            if audits >= 3 * how.rounds:
                raise RuntimeError(f"links of sampled vectors found: {recall:.3f}, below {how.recall} after {audits} searches")
