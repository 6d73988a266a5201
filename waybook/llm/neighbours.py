"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors get one more component that brings them all to the same length; the largest
inner product is then the smallest distance. Each table hashes a vector with K Gaussian
projections cut into cells. A query visits its own bucket and, in the order of their
estimated success, buckets of neighbouring cells: the projections that lie closest to
a cell's border are moved first. Candidates of all tables are ranked by their exact inner
products on the original vectors.

Equal vectors are one class with its smallest ids; a result needs no more of them. Buckets
with many vectors or queries are cut into blocks of vectors by blocks of queries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybook.llm.words import U, mix
from waybook.sources.scratch import stage

#: Vectors on which the number of probes and the cells' width are chosen, and queries among them.
SAMPLE, TRIED = 4096, 256
#: Part of the sample's neighbours that the chosen probes must find.
RECALL = 0.96
#: Tables at most.
TABLES = 48
#: Vectors and queries of one block, and rows of blocks that meet in one call, of up to WIDE components each; fewer of longer ones.
WIDE = 64
VECTORS, QUERIES, TOGETHER = 16384, 8192, 32768
#: Queries of one call, and its pairs of a query and a block.
ASKING, MEETING = 32768, 1 << 20
#: Candidates that a call ranks at once, scores of one product, and cells that are moved at once.
RANKED, SCORES, MOVED = 1 << 18, 1 << 20, 1 << 21


@dataclass(frozen=True)
class Index:
    """A family of tables; the projections follow from the seed."""

    dims: int
    tables: int
    hashes: int
    width: float
    probes: int
    longest: float
    seed: int = 1

    def projections(self) -> tuple[np.ndarray, np.ndarray]:
        rnd = np.random.default_rng(self.seed)
        return rnd.standard_normal((self.dims + 1, self.tables * self.hashes)), rnd.random(self.tables * self.hashes)

    def cells(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """(rows, tables, hashes) places in units of cells."""
        a, b = self.projections()
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        if query:
            unit, more = vectors / size, np.zeros_like(size)
        else:
            unit = vectors / self.longest
            more = np.sqrt(np.maximum(0.0, 1 - np.square(size / self.longest)))
        return (np.hstack((unit, more)) @ a / self.width + b).reshape(-1, self.tables, self.hashes)

    def buckets(self, cells: np.ndarray) -> np.ndarray:
        """One number per (row, table, ...) from the whole cells in the last axis."""
        out = np.zeros(cells.shape[:-1], U)
        for j in range(self.hashes):
            out = mix(out + cells[..., j].astype(np.int64).view(U) + U(j + 1))
        shape = [1] * out.ndim
        shape[1] = self.tables
        return mix(out + np.arange(1, self.tables + 1, dtype=U).reshape(shape)).view(np.int64)

    def of_vectors(self, vectors: np.ndarray) -> np.ndarray:
        return self.buckets(np.floor(self.cells(vectors, False)))

    def of_queries(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, tables, probes) buckets, most promising first."""
        cells, sets = self.cells(vectors, True), templates(self.hashes, self.probes)
        out = np.empty((*cells.shape[:2], len(sets)), np.int64)
        step = max(1, MOVED // (self.tables * len(sets) * self.hashes))
        for at in range(0, len(cells), step):
            out[at : at + step] = self._moved(cells[at : at + step], sets)
        return out

    def _moved(self, cells: np.ndarray, sets: np.ndarray) -> np.ndarray:
        base = np.floor(cells)
        inside = cells - base
        order = np.argsort(np.concatenate((inside, 1 - inside), axis=-1), axis=-1)
        axis, step = order % self.hashes, np.where(order < self.hashes, -1, 1)
        moves = np.zeros((*base.shape[:2], 2 * self.hashes, self.hashes))
        np.put_along_axis(moves, axis[..., None], step[..., None].astype(float), axis=-1)
        return self.buckets(base[:, :, None, :] + np.einsum("tr,qlrk->qltk", sets, moves))


@lru_cache(32)
def templates(hashes: int, probes: int) -> np.ndarray:
    """(probes, 2 * hashes) sets of ranks to move, in ascending order of the expected squared distance to the borders moved over."""
    k = hashes
    near = [j * (j + 1) / (4 * (k + 1) * (k + 2)) for j in range(1, k + 1)]
    far = [1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(k + 1, 2 * k + 1)]
    score = near + far
    out, heap = [()], [(score[0], (0,))]
    while heap and len(out) < probes:
        s, ranks = heapq.heappop(heap)
        if all(2 * k - 1 - r not in ranks for r in ranks):  # not both ways along one projection
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (s - score[last] + score[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (s + score[last + 1], (*ranks, last + 1)))
    sets = np.zeros((len(out), 2 * k))
    for i, ranks in enumerate(out):
        sets[i, list(ranks)] = 1
    return sets


def fit(sample: np.ndarray, rows: int, longest: float, k: int, tables: int = 6, recall: float = RECALL) -> Index:
    """The index over `rows` vectors that finds enough neighbours of the sample's queries with the fewest candidates.

    The k nearest of all rows are about as near as the first k * len(sample) / rows of
    a sample; two at least are looked at, besides the query itself. Where the probes of no
    width find enough of them, the tables are doubled, up to `TABLES`; beyond that it raises.
    """
    if len(sample) < 3:
        return Index(sample.shape[1], tables, 2, 3.0, 9, longest)
    reached = 0.0
    while tables <= TABLES:
        (missing, cost), index = _fitted(sample, rows, longest, k, tables, recall)
        if not missing:
            return index
        reached, tables = -cost, 2 * tables
    raise ValueError(f"the index finds {reached:.3f} of the sample's neighbours with {tables // 2} tables, not {recall}: give `search` an index of your own")


def _fitted(sample: np.ndarray, rows: int, longest: float, k: int, tables: int, recall: float) -> tuple[tuple[bool, float], Index]:
    """((whether the recall is missed, candidates or else the recall below zero), index) of the best width."""
    dims, best = sample.shape[1], None
    queries = sample[:TRIED]
    alike = max(2, math.ceil(k * len(sample) / rows))
    truth = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, 1 : alike + 1]
    for width, bits in ((1.5, 1.5), (2.0, 1.2), (3.0, 0.8)):  # bits: entropy of a cell of this width
        hashes = int(min(12, max(2, math.log2(max(2, rows / 128)) / bits)))
        whole = min(3**hashes, 2048)
        index = Index(dims, tables, hashes, width, whole, longest)
        mine, theirs = index.of_vectors(sample), index.of_queries(queries)
        first = np.full((len(queries), len(sample)), whole + 1, np.int64)
        total = np.zeros(whole + 2, np.int64)
        for t in range(tables):
            order = np.argsort(theirs[:, t], axis=1)
            for q in range(len(queries)):
                asked = theirs[q, t][order[q]]
                at = np.minimum(np.searchsorted(asked, mine[:, t]), len(asked) - 1)
                rank = np.where(asked[at] == mine[:, t], order[q][at], whole + 1)
                total += np.bincount(rank, minlength=whole + 2)
                np.minimum(first[q], rank, out=first[q])
        found = np.take_along_axis(first, truth, axis=1)
        enough = max(1, math.ceil(recall * found.size)) - 1
        needed = int(np.partition(found.ravel(), enough)[enough]) + 1
        missing = needed > whole
        needed = min(needed, whole)
        cost = (missing, int(total[:needed].sum()) if not missing else -float((found <= whole).mean()))
        if best is None or cost < best[0]:
            best = (cost, Index(dims, tables, hashes, width, needed, longest))
    return best


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), -1)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: an id, and a vector of the most common length that is finite and not zero."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL")
    rows = rows.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("embedding") == (usual["n"] if usual else 0))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(cid, ids, embedding): distinct vectors with their k + 1 smallest ids."""
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.distinct().withColumn("nth", nth).filter(F.col("nth") <= k + 1)  # Spark applies the limit before the shuffle too
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("cid"), "ids", "embedding")


def _best(queries: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, places) of the k largest inner products of each query, first places first among equals."""
    step = max(16, SCORES // max(1, len(vectors), k * queries.shape[1]))  # scores, and later the components of what is yielded
    for at in range(0, len(queries), step):
        score = queries[at : at + step] @ vectors.T
        if score.shape[1] <= k:
            yield np.repeat(np.arange(at, at + len(score)), score.shape[1]), np.tile(np.arange(score.shape[1]), len(score))
            continue
        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(score, top, axis=1).min(axis=1)
        for i in np.flatnonzero((score >= least[:, None]).sum(axis=1) > k):  # equals at the end: the first places
            some = np.flatnonzero(score[i] >= least[i])
            top[i] = some[np.argsort(-score[i, some], kind="stable")][:k]
        yield np.repeat(np.arange(at, at + len(score)), k), top.ravel()


def _ids(left: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first ids of the classes, all their ids, where a class' ids begin in those and how many it has."""
    ids = left["ids"].combine_chunks()
    every, many = ids.flatten().to_numpy(), ids.value_lengths().to_numpy().astype(np.int64)
    start = np.cumsum(many) - many
    return every[start], every, start, many


def _nth(group: np.ndarray, many: np.ndarray) -> np.ndarray:
    """How many of its group, whose rows lie together, come before each row that counts as `many`."""
    before = np.cumsum(many) - many
    return before - before[np.searchsorted(group, group)]


def _searched(k: int):
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Blocks of vectors (block, cid, ids, embedding) against queries with their blocks (blocks, query_id, embedding): the k best of each query.

        Queries are taken a few at a time, each with all of its blocks, so that what is held does not grow with the pairs.
        """
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        order = np.lexsort((_ids(left)[0], left["block"].to_numpy()))
        left = left.take(pa.array(order))
        first, every, start, many = _ids(left)
        blocks, number = left["block"].to_numpy(), np.unique(left["cid"].to_numpy(), return_inverse=True)[1]
        vectors = _matrix(left["embedding"].combine_chunks())
        asked = right["blocks"].combine_chunks()
        lower = np.searchsorted(blocks, asked.flatten().to_numpy())
        upper = np.searchsorted(blocks, asked.flatten().to_numpy(), side="right")
        row = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())
        queries, numbers = _matrix(right["embedding"].combine_chunks()), right["query_id"].to_numpy()
        ends = np.concatenate(([0], np.cumsum(asked.value_lengths().to_numpy())))
        before = np.concatenate(([0], np.cumsum(np.minimum(upper - lower, k + 1))))[ends]
        made, at = [], 0
        while at < len(asked):
            to = max(at + 1, int(np.searchsorted(before, before[at] + RANKED, side="right")) - 1)
            pairs = slice(ends[at], ends[to])
            by = pairs.start + np.argsort(lower[pairs], kind="stable")
            found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            for some in np.split(by, np.flatnonzero(np.diff(lower[by])) + 1) if len(by) else []:
                v, q = slice(lower[some[0]], upper[some].max()), row[some[upper[some] > lower[some]]]
                for which, places in _best(queries[q], vectors[v], k + 1) if len(q) else ():
                    found.append((q[which], v.start + places, np.einsum("ij,ij->i", queries[q[which]], vectors[v.start + places])))
            query, place, score = (np.concatenate(x) for x in zip(*found, strict=True))
            once = np.unique(query * len(number) + number[place], return_index=True)[1]
            query, place, score = query[once], place[once], score[once]
            rank = np.lexsort((first[place], -score, query))
            query, place, score = query[rank], place[rank], score[rank]
            wanted = _nth(query, many[place]) <= k  # an id or none is the query's own
            query, place, score = query[wanted], place[wanted], score[wanted]
            each = many[place]
            ids = every[np.repeat(start[place] - np.cumsum(each) + each, each) + np.arange(each.sum())]
            query, score = np.repeat(query, each), np.repeat(score, each)
            other = ids != numbers[query]
            query, ids, score = query[other], ids[other], score[other]
            wanted = _nth(query, np.ones_like(query)) < k
            made.append(pa.Table.from_arrays([pa.array(x[wanted], f.type) for x, f in zip((numbers[query], ids, score), out, strict=True)], schema=out))
            at = to
        return pa.concat_tables(made)

    return run


def search(rows: DataFrame, every: int = 20, k: int = 20, index: Index | None = None) -> DataFrame:
    """The k nearest found of every row whose vec_id is divisible by `every`: query_id, rank, vec_id, score.

    Nearest is the largest inner product in double precision, ties to the smaller
    vec_id. A query's own vec_id is no candidate. Rows without an id, and vectors
    that are null, zero, of an unusual length, or hold a null or a number that is not
    finite take no part. Of a query id with several vectors the smallest one
    asks; repeated rows count once. All distinct vectors are indexed. Without an
    index, one is fitted on the SAMPLE vectors with the smallest hashes of their first ids.
    """
    spark = rows.sparkSession
    rows = usable(rows)
    vectors = stage(classes(rows, k), "vectors")
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    count, longest = vectors.agg(F.count("*"), F.max(size)).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if index is None:
        sample = vectors.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(SAMPLE).select("embedding").toArrow()
        index = fit(_matrix(sample["embedding"].combine_chunks()), count, longest, k)
    made = index

    def at_once(rows: int) -> int:
        return max(1, rows * WIDE // max(WIDE, made.dims))

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(made.of_vectors(_matrix(part.column(1)))), pa.list_(pa.int64()))], ["cid", "buckets"])

    def probed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                asked = made.of_queries(_matrix(part.column(1)))
                each = asked[0].size
                few = max(1, RANKED // each)
                for i in range(0, len(asked), few):
                    ids = np.repeat(part.column(0).to_numpy()[i : i + few], each)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(asked[i : i + few].reshape(-1))], ["query_id", "bucket"])

    queries = stage(rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding")), "queries")
    placed = stage(vectors.select("cid", "embedding").mapInArrow(hashed, "cid long, buckets array<bigint>").select("cid", F.explode("buckets").alias("bucket")), "placed")
    probes = queries.repartition(spark.sparkContext.defaultParallelism, "query_id").mapInArrow(probed, "query_id long, bucket long").distinct()
    filled = placed.groupBy("bucket").agg(F.ceil(F.count("*") / at_once(VECTORS)).cast("int").alias("parts"))
    probes = stage(probes.join(filled, "bucket"), "probes")
    asked = probes.groupBy("bucket").agg(F.first("parts").alias("parts"), F.ceil(F.count("*") / QUERIES).cast("int").alias("turns"), F.count("*").alias("asking"))
    asked = stage(asked, "buckets")

    def block() -> list:
        return [F.xxhash64("bucket", "part", "turn").alias("block")]

    def dealt(id_: str, n: str):
        return F.pmod(F.xxhash64(id_, F.lit(7)), F.col(n)).cast("int")

    held = placed.join(asked, "bucket").withColumn("part", dealt("cid", "parts")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    held = stage(held.select("cid", *block()), "held")
    sought = probes.join(asked.select("bucket", "turns"), "bucket").withColumn("turn", dealt("query_id", "turns")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    groups = max(1, math.ceil(queries.count() / at_once(ASKING)))
    pairs = asked.agg(F.sum(F.col("asking") * F.col("parts"))).first()[0] or 0
    calls = max(1, math.ceil(held.count() / at_once(TOGETHER)), math.ceil(pairs / groups / MEETING))
    call = F.pmod(F.xxhash64("block", F.lit(3)), F.lit(calls)) * groups
    left = held.select("cid", "block", call.alias("call")).join(vectors, "cid")
    left = left.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select((F.col("call") + F.col("group")).alias("call"), "block", "cid", "ids", "embedding")
    group = F.pmod(F.xxhash64("query_id", F.lit(11)), F.lit(groups))
    right = sought.select("query_id", *block()).select("query_id", "block", (call + group).alias("call")).groupBy("call", "query_id").agg(F.collect_list("block").alias("blocks"))  # at most the query's probes
    right = right.join(queries, "query_id").select("call", "blocks", "query_id", "embedding")
    found = left.groupBy("call").cogroup(right.groupBy("call")).applyInArrow(_searched(k), "query_id long, vec_id long, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
