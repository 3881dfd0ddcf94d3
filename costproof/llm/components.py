"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costproof.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b); nodes of one component share their root.

    Random contraction: each round every node moves to the first, in a fresh random order, of itself
    and its neighbours, and the edges follow. The number of nodes left falls by a constant factor each
    round, whatever the shape, so rounds grow with the logarithm of the largest component. Nothing
    is gathered: a hub's neighbours are reduced by each task before the shuffle.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = stored(edges.where("a <> b").select(*ordered(F.col("a"), F.col("b"))).distinct(), "edges")
    moves = []
    while not left.isEmpty():
        turn = F.lit(len(moves))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(turn, "b").alias("h"), F.col("b").alias("v"))).alias("n"))
        own = F.struct(F.xxhash64(turn, "a").alias("h"), F.col("a").alias("v"))
        move = stored(nearest.select(F.col("a").alias("node"), F.least(own, "n")["v"].alias("root")), "moves")
        moves.append(move)
        here = move.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        there = move.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = stored(
            left.join(here, "a").join(there, "b").where("ra <> rb").select(*ordered(F.col("ra"), F.col("rb"))).distinct(),
            "edges",
        )
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves.pop()
    while moves:
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("final"))
        roots = stored(
            moves.pop().join(later, "root", "left").select("node", F.coalesce("final", "root").alias("root")), "roots"
        )
    return roots
