"""Centroid clustering on bit planes: exact integer distances from AND and popcount.

A vector of up to 64 whole numbers is kept as its bit planes: plane i is one 64-bit word that holds bit i
of every component, in two's complement, so the last plane has a negative weight. The product of two
vectors is then the sum over pairs of planes of weight times popcount(plane AND plane), and a squared
distance follows from three such products; nothing is rounded.

Every round reads the packed planes once; a task sends one row of sums per cluster, so what is shuffled
and what the driver sees (``k`` times 64 sums) does not grow with the table, and a cluster that holds most
rows is as cheap as any other.

Defined results: a vector takes part if it has exactly ``dim`` components, none null or non-finite, and a
squared length below 2^60 after scaling (beyond that, distances need not fit a long). Rows are vectors:
repeated rows and repeated ids each count. A null id is kept; it starts a centroid only when there are too
few other vectors. Fewer vectors than ``k`` give fewer centroids, an empty table an empty result. Other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costproof.llm.common import stored

LANES = 64
# Rows whose products are in memory at once.
ROWS = 4096
MAX_SQUARE = float(1 << 60)


def weights(width: int) -> np.ndarray:
    """What each plane of a two's complement number of ``width`` bits counts."""
    out = np.int64(1) << np.arange(width, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def pack(values: np.ndarray) -> np.ndarray:
    """Bit planes, one row of words per vector, of whole numbers (n x at most 64); as wide as the largest needs."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    width = max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1
    lanes = np.zeros((len(values), LANES), np.int64)
    lanes[:, : values.shape[1]] = values
    bits = (lanes[:, None, :] >> np.arange(width)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def unpack(planes: np.ndarray) -> np.ndarray:
    """The whole numbers (n x 64) that ``planes`` hold."""
    octets = np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8)
    bits = np.unpackbits(octets, axis=2, bitorder="little")
    return np.einsum("nwl,w->nl", bits, weights(planes.shape[1]), dtype=np.int64)


def widened(planes: np.ndarray, width: int) -> np.ndarray:
    """The same numbers over ``width`` planes: the sign plane is repeated."""
    return np.concatenate([planes, np.repeat(planes[:, -1:], width - planes.shape[1], axis=1)], axis=1)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products (n x k) of the vectors in two sets of planes."""
    out = np.zeros((len(left), len(right)), np.int64)
    for i, wi in enumerate(weights(left.shape[1])):
        part = np.zeros_like(out)
        for j, wj in enumerate(weights(right.shape[1])):
            part += wj * np.bitwise_count(left[:, i, None] & right[None, :, j])
        out += wi * part
    return out


def squares(planes: np.ndarray) -> np.ndarray:
    """Exact squared lengths of the vectors in ``planes``."""
    out = np.zeros(len(planes), np.int64)
    w = weights(planes.shape[1])
    for i in range(len(w)):
        for j in range(i, len(w)):
            times = w[i] * w[j] * (1 if i == j else 2)
            out += times * np.bitwise_count(planes[:, i] & planes[:, j])
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number of equals, and the squared distance."""
    apart = squares(planes)[:, None] + squares(centroids)[None, :] - 2 * products(planes, centroids)
    label = apart.argmin(axis=1)
    return label, apart[np.arange(len(label)), label]


def _planes(column: pa.Array) -> np.ndarray:
    """The packed column of a batch, widened to its widest row."""
    rows = [np.frombuffer(v, np.uint64) for v in column.to_pylist()]
    if not rows:
        return np.zeros((0, 1), np.uint64)
    width = max(map(len, rows))
    if any(len(r) < width for r in rows):
        rows = [r if len(r) == width else widened(r[None, :], width)[0] for r in rows]
    return np.stack(rows)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def packed(vectors: DataFrame, vec_id: str, embedding: str, dim: int, scale: int) -> DataFrame:
    """``id, planes`` of every vector that takes part, its components floor(scale * x)."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    size = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(F.floor(v.cast("double") * scale).cast("double"), 2.0))
    whole = vectors.where(F.coalesce((F.size(x) == dim) & finite, F.lit(False)))
    rows = whole.where(size < MAX_SQUARE).select(F.col(vec_id).cast("long").alias("id"), ints.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            planes = [row.tobytes() for row in pack(values)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(planes, pa.binary())], ["id", "planes"])

    return rows.mapInArrow(run, "id long, planes binary")


def _assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id, cluster, distance`` of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            if len(centroids) and batch.num_rows:
                label, apart = nearest(_planes(batch.column("planes")), centroids)
                arrays = [batch.column("id"), pa.array(label.astype(np.int32)), pa.array(apart)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "cluster", "distance"])

    return points.mapInArrow(run, "id long, cluster int, distance long")


def _sums(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, n, sums``: the vectors of each cluster, added up by each task and then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros((len(centroids), LANES), np.int64)
        for batch in _slices(batches):
            planes = _planes(batch.column("planes"))
            label, _ = nearest(planes, centroids)
            values = unpack(planes)
            for c in np.unique(label):
                mine = label == c
                count[c] += mine.sum()
                total[c] += values[mine].sum(axis=0)
        seen = np.flatnonzero(count)
        arrays = [pa.array(seen.astype(np.int32)), pa.array(count[seen]), pa.array(list(total[seen]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["cluster", "n", "sums"])

    partial = points.mapInArrow(run, "cluster int, n long, sums array<long>")
    wide = partial.select("cluster", "n", F.posexplode("sums").alias("lane", "x"))
    lanes = wide.groupBy("cluster", "lane").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    return lanes.groupBy("cluster").agg(
        F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("lane", "x"))), lambda s: s["x"]).alias("sums")
    )


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 16,
    rounds: int = 3,
    seed: int = 1,
    scale: int = 64,
    dim: int = LANES,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` of every vector that takes part.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``seed:id``. A round moves every
    vector to its nearest centroid and each centroid that has vectors to the floor of their mean; after
    ``rounds`` of them vectors are assigned once more. Inertia is the sum of squared distances, null
    where it does not fit a long.
    """
    if not 0 < dim <= LANES:
        raise ValueError(f"one word holds 1 to {LANES} components")
    points = stored(packed(vectors, vec_id, embedding, dim, scale), "planes")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = points.orderBy(order.asc_nulls_last(), "planes").limit(k).collect()
    centers = [unpack(np.frombuffer(r["planes"], np.uint64)[None, :])[0].tolist() for r in first]

    def planes() -> np.ndarray:
        return pack(np.array(centers, np.int64).reshape(len(centers), LANES))

    for _ in range(rounds if centers else 0):
        for row in _sums(points, planes()).collect():
            centers[row["cluster"]] = [int(x) // row["n"] for x in row["sums"]]
    found = stored(_assigned(points, planes()), "clusters")
    totals = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["cluster"]: int(r["s"]) for r in totals}
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(c, fits(s), fits(sum(inertia.values())), centers[c][:dim]) for c, s in inertia.items()]
    sides = "cluster int, cluster_inertia long, inertia long, centroid array<long>"
    of_cluster = F.broadcast(vectors.sparkSession.createDataFrame(rows, sides))  # k rows at most
    return found.join(of_cluster, "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )
