"""Chains of references followed to their ends by pointer jumping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.checkpoints import cut

CYCLE, UNKNOWN = "cycle", "unknown target"


def chain_ends(links: DataFrame, any_of: list[str] = ()) -> DataFrame:
    """(node, end, hops, <any_of>.., fault) for rows (node, target, <any_of>..); a null target ends a chain.

    ``node`` is unique; ``any_of`` names flags that are true for a node if they are for any node on its way. Every round
    doubles the reach of each pointer, so a chain of n hops takes log2(n) joins, and there is no bound on n. A chain that
    leaves the table ends in its last node there (``unknown target``). Where no pointer of a round arrives any more, what
    is left runs in circles (``cycle``, end and hops null). Finished nodes leave the join, so a popular end is no hot key.
    """
    flags = [F.coalesce(F.col(f), F.lit(False)).alias(f) for f in any_of]
    links = cut(links.select("node", "target", *flags))
    known = links.select(F.col("node").alias("target"), F.lit(True).alias("known"))
    placed = links.join(known, "target", "left").select("node", "target", *any_of, (F.col("target").isNotNull() & F.col("known").isNull()).alias("lost"))
    ended = F.col("target").isNull() | F.col("lost")
    fault = F.when(F.col("lost"), F.lit(UNKNOWN)).alias("fault")
    state = cut(placed.select("node", F.when(ended, F.col("node")).otherwise(F.col("target")).alias("end"), F.when(ended, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("hops"), *any_of, fault, ended.alias("done")))
    done, open_ = [state.where("done")], state.where("not done")
    left = open_.count()
    while left:
        step = state.select(F.col("node").alias("end"), F.col("end").alias("next"), F.col("hops").alias("more"), *[F.col(f).alias(f"{f}_next") for f in any_of], F.col("fault").alias("fault_next"), F.col("done").alias("done_next"))
        jumped = cut(open_.join(step, "end").select(
            "node", F.col("next").alias("end"), (F.col("hops") + F.col("more")).alias("hops"), *[(F.col(f) | F.col(f"{f}_next")).alias(f) for f in any_of], F.col("fault_next").alias("fault"), F.col("done_next").alias("done"),
        ))
        done.append(jumped.where("done"))
        open_ = jumped.where("not done")
        state, before, left = reduce(DataFrame.union, [*done, open_]), left, open_.count()
        if left == before:
            break
    circles = open_.select("node", F.lit(None).cast(open_.schema["end"].dataType).alias("end"), F.lit(None).cast("long").alias("hops"), *any_of, F.lit(CYCLE).alias("fault"))
    return reduce(DataFrame.union, [d.select("node", "end", "hops", *any_of, "fault") for d in done]).union(circles)
