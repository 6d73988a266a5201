"""Centroid clustering in exact integers, with a vantage-point tree over the centroids.

Each round builds the tree anew on the driver from the k centroids and broadcasts it; k
and the length of vectors are parameters, whatever the number of rows. A vector visits
the tree's nodes best first: in order of a lower bound of its distance to what lies below
each, as long as that bound is not above its best distance. The comparison is inclusive and
allows for rounding, so a centroid as near as the best one is always met and the smaller
number wins. Distances that decide are sums of 64-bit integers. The vectors of a batch
search side by side, each with its own queue of nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybook.sources.scratch import discard, stage

#: Centroids of a leaf, and cells of the queues and of the differences that a batch holds at once.
LEAF, CELLS = 2, 1 << 21
#: Components as large as this one or larger would not give a 64-bit distance.
LARGEST = 1 << 27


class Tree:
    """Nodes hold a vantage point and two children, or up to `LEAF` centroids (more where all are equally far)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        #: of each node: the numbers it holds (a leaf's, or its vantage point), and its children with the least and largest distance to them
        self.held: list[np.ndarray] = []
        self.children: list[list[tuple[int, float, float]]] = []
        waiting = [(self._new(), np.arange(len(centroids)))]
        while waiting:
            node, numbers = waiting.pop()
            if len(numbers) > LEAF:
                apart = ((self.centroids[numbers] - self.centroids[numbers[0]]) ** 2).sum(axis=1)
                middle = np.partition(apart[1:], (len(numbers) - 2) // 2)[(len(numbers) - 2) // 2]
                inner, outer = np.flatnonzero(apart[1:] <= middle) + 1, np.flatnonzero(apart[1:] > middle) + 1
                if len(outer):
                    self.held[node] = numbers[:1]
                    for part in (inner, outer):
                        child = self._new()
                        far = np.sqrt(apart[part].astype(np.float64))
                        self.children[node].append((child, far.min(), far.max()))
                        waiting.append((child, numbers[part]))
                    continue
            self.held[node] = numbers

    def _new(self) -> int:
        self.held.append(np.empty(0, np.int64))
        self.children.append([])
        return len(self.held) - 1

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row; of equally near ones the smallest number."""
        step = max(1, CELLS // max(len(self.held), vectors.shape[1]))
        parts = [self._nearest(vectors[at : at + step]) for at in range(0, len(vectors), step)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(vectors)
        best, found = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        queue = np.full((n, len(self.held)), np.inf)
        queue[:, 0] = 0
        open_ = np.arange(n)
        while len(open_):
            node = queue[open_].argmin(axis=1)
            bound = queue[open_, node]
            # bounds and roots are rounded: a relative margin far above that error keeps the comparison inclusive
            near = bound * (1 - 1e-9) <= np.sqrt(best[open_].astype(np.float64)) * (1 + 1e-9)
            near &= bound < np.inf
            open_, node, bound = open_[near], node[near], bound[near]
            queue[open_, node] = np.inf
            order = np.argsort(node, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(node[order])) + 1) if len(order) else []:
                at, here = open_[rows], int(node[rows[0]])
                for number in self.held[here].tolist():
                    apart = ((vectors[at] - self.centroids[number]) ** 2).sum(axis=1)
                    better = (apart < best[at]) | ((apart == best[at]) & (number < found[at]))
                    best[at[better]], found[at[better]] = apart[better], number
                if self.children[here]:
                    own = np.sqrt(apart.astype(np.float64))
                    for child, low, high in self.children[here]:
                        # a difference of roots can be rounded by more than its own size allows, hence the margin on both
                        queue[at, child] = np.maximum(np.maximum(low - own, own - high) - 1e-9 * (own + high), bound[rows])
        return found, best


def vectors_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def kept(rows: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows whose vector has `width` components, none null or non-finite; v is floor(64 * x) of each."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(64 * c.cast("double")))
    return rows.filter((F.size(x) == width) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def clusters(rows: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, width: int = 64) -> DataFrame:
    """One row per kept row of (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The first centroids are the k kept vectors with the smallest sha256 of `seed:vec_id`, all if
    there are fewer; rows without a vec_id come after those, and of rows with one id the smaller
    vector first. Vectors that are null, of another length, or hold a null or non-finite component
    take no part; repeated rows each count. A component of 2 ** 27 / 64 or more raises: its
    distances need not fit 64 bits. Other columns are not read. No kept row: an empty table.
    """
    spark = rows.sparkSession
    table = stage(kept(rows, width), "vectors")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = table.withColumn("mark", mark).orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()  # k rows
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = [list(r["v"]) for r in first]

    def assigned(it: Iterator[pa.RecordBatch], tree) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in it:
            vectors = vectors_of(batch, width)
            if len(vectors) and max(int(vectors.max()), -int(vectors.min())) >= LARGEST:
                raise ValueError("a component is too large for 64-bit distances")
            yield batch, vectors, *tree.value.nearest(vectors)

    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(Tree(np.array(centroids)))

        def sums(it: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(tree.value.centroids), width + 1), np.int64)  # components and count of each cluster
            for _, vectors, found, _ in assigned(it, tree):
                for c in np.unique(found).tolist():
                    own = vectors[found == c]
                    total[c] += np.append(own.sum(axis=0), len(own))
            for c in np.flatnonzero(total[:, -1]).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([total[c].tolist()], pa.list_(pa.int64()))], ["cluster", "sums"])

        parts = table.select("v").mapInArrow(sums, "cluster int, sums array<bigint>").select("cluster", F.posexplode("sums"))
        made = parts.groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total")).collect()  # k x (width + 1) rows
        tree.unpersist()
        total = {(r["cluster"], r["pos"]): int(r["total"]) for r in made}
        for c in {c for c, _ in total}:
            centroids[c] = [total[c, i] // total[c, width] for i in range(width)]

    tree = spark.sparkContext.broadcast(Tree(np.array(centroids)))

    def last(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, found, apart in assigned(it, tree):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32()), pa.array(apart)], ["vec_id", "cluster", "distance"])

    out = stage(table.select("vec_id", "v").mapInArrow(last, "vec_id long, cluster int, distance long"), "assigned")
    discard(table)
    inertia = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    all_, prints = sum(inertia.values()), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = spark.createDataFrame([(c, d, all_, prints[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
