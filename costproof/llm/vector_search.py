"""Exact top-k search: queries and data indexed in the same cover trees and searched tree against tree.

Vectors become whole numbers and are dealt to the nearest of a few centers, a net over a bounded sample; a
center with many vectors, such as copies of one, is dealt on over as many chunks as its size asks for. A task
builds one cover tree per chunk, holding queries and data alike, and searches it for its own queries,
which gives each of them a k-th score to start from. Then the query part of every tree meets the other
trees: a pair of trees is dropped by their centers, radii and the worst k-th score of the queries; the pairs
left are brought together, a bounded number of queries and one chunk at a time, and walked as a dual tree.
The result is exact whatever the sample or the order.

Only the sample of ``SAMPLE`` vectors is seen by the driver. The queries are a stated set, met by all rows in
blocks of ``QUERIES`` queries and ``CHUNK`` vectors; nothing is capped.

Defined results: null vectors, and those with a null or non-finite component, take no part, nor do vectors
whose scaled squared length is 2^62 or more, as their scores need not fit a long. Vectors of different numbers
of components do not meet. Repeated rows and ids are rows of their own: a query leaves out its own row only,
and a repeated query row has its own ranks. A null id is never a query; as a candidate it comes after equal
scores with an id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costproof.llm import cover_trees
from costproof.llm.common import stored

SAMPLE = 4096
CENTERS = 64
CHUNK = 8192
QUERIES = 16384
LAST = np.iinfo(np.int64).max
FOUND = "query_row long, query_id long, vec_id long, row long, score long"
KEY = ["dim", "cell", "chunk"]


def points(vectors: DataFrame, queries: Column, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """``row, id, asks, dim, v`` of every vector that takes part, its components floor(scale * x)."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    size = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(F.floor(v.cast("double") * scale).cast("double"), 2.0))
    rows = vectors.where(F.coalesce(finite, F.lit(False))).where(size < float(1 << 62))
    return stored(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(vec_id).cast("long").alias("id"),
            F.coalesce(queries & F.col(vec_id).isNotNull(), F.lit(False)).alias("asks"),
            F.size(x).alias("dim"),
            F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("v"),
        ),
        "points",
    )


def centers(data: DataFrame, chunk: int) -> dict[int, np.ndarray]:
    """By number of components, centers far apart from each other: a greedy net over at most ``SAMPLE`` vectors.

    As many as there are chunks to fill, ``CENTERS`` at most; more chunks than that share a center.
    """
    most = min(CENTERS, math.ceil(data.count() / chunk))
    sample = data.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("dim", "v").collect()
    out = {}
    for dim in {r["dim"] for r in sample} - {0}:
        rows = np.array([r["v"] for r in sample if r["dim"] == dim], np.float64)
        chosen = [0]
        far = np.square(rows - rows[0]).sum(axis=1)
        while len(chosen) < min(most, math.isqrt(len(rows))) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.square(rows - rows[chosen[-1]]).sum(axis=1))
        out[dim] = rows[chosen]
    return out


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)


def _cells(data: DataFrame, nets: dict[int, np.ndarray]) -> DataFrame:
    """``data`` with the nearest center of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            dims = batch.column("dim").to_numpy()
            for dim in set(dims.tolist()) & nets.keys():
                mine = np.flatnonzero(dims == dim)
                v = _values(batch.take(pa.array(mine))).astype(np.float64)
                net = nets[dim]
                cell[mine] = (np.square(net).sum(axis=1) - 2 * (v @ net.T)).argmin(axis=1)
            yield batch.append_column("cell", pa.array(cell))

    return data.mapInArrow(run, "row long, id long, asks boolean, dim int, v array<long>, cell int")


def _tree_rows(k: int):
    """A chunk's tree, the tree of its queries with their k-th scores, and what they find in the chunk."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)).combine_chunks().to_batches()[0]
        values = cover_trees.narrow(_values(whole))
        ids = whole.column("id").fill_null(LAST).to_numpy()
        unnamed = whole.column("id").is_null().to_numpy(zero_copy_only=False)
        asks = whole.column("asks").to_numpy(zero_copy_only=False)
        rows = whole.column("row").to_numpy()
        tree = cover_trees.build(values, rows, ids, unnamed)
        queries = cover_trees.restricted(tree, np.isin(tree.rows, rows[asks]))
        found = cover_trees.Found(len(queries.points), k)
        cover_trees.search(queries, tree, found)
        least = found.least.min(initial=np.inf)
        middle = [t.center[0].astype(np.float64).tolist() for t in (tree, queries)]
        yield pa.RecordBatch.from_pydict(
            {
                **{name: [k.as_py()] for name, k in zip(KEY, key)},
                "center": [middle[0]],
                "radius": [float(tree.radius[0])],
                "tree": [pickle.dumps(tree)],
                "n_queries": [len(queries.points)],
                "query_center": [middle[1]],
                "query_radius": [float(queries.radius[0])],
                "least": [None if least == -np.inf else float(least)],
                "queries": [pickle.dumps((queries, found.least))],
                "found": [_listed(queries, found).to_pylist()],
            },
            schema=_SCHEMA,
        )

    return run


_FOUND = pa.schema([(name, pa.int64()) for name in ("query_row", "query_id", "vec_id", "row", "score")])
_SCHEMA = pa.schema(
    [
        *((name, pa.int32()) for name in KEY),
        ("center", pa.list_(pa.float64())),
        ("radius", pa.float64()),
        ("tree", pa.binary()),
        ("n_queries", pa.int64()),
        ("query_center", pa.list_(pa.float64())),
        ("query_radius", pa.float64()),
        ("least", pa.float64()),
        ("queries", pa.binary()),
        ("found", pa.list_(pa.struct(list(_FOUND)))),
    ]
)
TREES = (
    "dim int, cell int, chunk int, center array<double>, radius double, tree binary, n_queries long, "
    "query_center array<double>, query_radius double, least double, queries binary, "
    "found array<struct<query_row: long, query_id: long, vec_id: long, row: long, score: long>>"
)


def _listed(queries: cover_trees.Tree, found: cover_trees.Found) -> pa.RecordBatch:
    """Every candidate found, one row each."""
    counts = [len(best[0]) for best in found.best]
    scores, ids, unnamed, rows = (np.concatenate([best[i] for best in found.best] or [np.zeros(0)]) for i in range(4))
    at = np.repeat(np.arange(len(counts)), counts)
    arrays = [
        pa.array(queries.rows[at], pa.int64()),
        pa.array(queries.ids[at], pa.int64()),
        pa.array(ids.astype(np.int64), mask=unnamed.astype(bool)),
        pa.array(rows.astype(np.int64)),
        pa.array(scores.astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_FOUND)


def trees(data: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of vectors: its trees, and what its queries find inside."""
    placed = stored(_cells(data, centers(data, chunk)), "cells")
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    dealt = placed.join(sizes, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("row"), "chunks").cast("int"))
    return stored(dealt.drop("chunks").groupBy(*KEY).applyInArrow(_tree_rows(k), TREES), "trees")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _length(a: str) -> Column:
    return F.sqrt(_dot(a, a))


def _met(made: DataFrame, k: int, queries: int) -> DataFrame:
    """What queries find in chunks other than their own."""
    asking = made.where("n_queries > 0")
    blocks = asking.groupBy("dim").agg(F.ceil(F.sum("n_queries") / queries).alias("blocks"))
    block = F.pmod(F.xxhash64("cell", "chunk"), "blocks").cast("int").alias("block")
    asking = asking.join(F.broadcast(blocks) if _few(blocks) else blocks, "dim")
    heads = asking.select(
        "dim", F.col("cell").alias("q_cell"), F.col("chunk").alias("q_chunk"), block, "query_center", "query_radius", "least"
    )
    sides = made.select(*KEY, "center", "radius")
    size, reach = _length("center") + F.col("radius"), _length("query_center") + F.col("query_radius")
    bound = _dot("center", "query_center") + F.col("query_radius") * _length("center") + F.col("radius") * reach
    pairs = stored(
        heads.join(sides, "dim")
        .where("NOT (cell = q_cell AND chunk = q_chunk)")
        .where(F.col("least").isNull() | (bound + 1 + 1e-9 * size * reach >= F.col("least")))
        .select(*KEY, "block", "q_cell", "q_chunk"),
        "pairs",
    )
    left = asking.select("dim", F.col("cell").alias("q_cell"), F.col("chunk").alias("q_chunk"), "queries")
    left = pairs.join(left, ["dim", "q_cell", "q_chunk"]).select(*KEY, "block", "queries")
    right = pairs.select(*KEY, "block").distinct().join(made.select(*KEY, "tree"), KEY)
    right = right.toDF(*(f"data_{name}" for name in right.columns))

    def run(asked: pa.Table, data: pa.Table) -> pa.Table:
        out = [_FOUND.empty_table()]
        for packed in data.column("data_tree").to_pylist():
            tree = pickle.loads(packed)
            for other in asked.column("queries"):
                queries, least = pickle.loads(other.as_py())
                found = cover_trees.Found(len(queries.points), k, least)
                cover_trees.search(queries, tree, found)
                out.append(pa.Table.from_batches([_listed(queries, found)]))
        return pa.concat_tables(out)

    key = [*KEY, "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*(f"data_{name}" for name in key))).applyInArrow(run, FOUND)


def _few(df: DataFrame, limit: int = 10_000) -> bool:
    return df.limit(limit + 1).count() <= limit


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    scale: int = 256,
    chunk: int = CHUNK,
    block: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each row that ``queries`` marks."""
    made = trees(points(vectors, queries, vec_id, embedding, scale), k, chunk)
    found = made.select(F.inline("found")).unionByName(_met(made, k, block))
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
