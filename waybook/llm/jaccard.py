"""N-gram Jaccard join: universe partition and pigeonhole over size bands.

Two sets of sizes l and s with a Jaccard similarity of t differ in at most
D = floor((l + s)(1 - t)/(1 + t)) elements. The universe is hashed into
segments, differently in each band of sizes. A segment that is indexed as it is
costs the pair one difference to escape, one that is indexed with all its
one-deletion neighbours costs two; so D + 1 such units leave no way out. How many
segments of either kind a band has comes from a cost model (`allocation`). Of the
plain segments a document only indexes as many as its own size leaves needed, those
with the most shingles that are not frequent first, in an order that depends on a
segment's content alone: the first equal segment of a pair is then among those of both.

Documents with equal sets are one class from the start. In each bucket of equal
signatures the classes are first compared with the bucket's smallest one, its head,
only, and each class with one head before the others. Classes that share a head and are
still in different components are candidates of each other where they meet the bounds of
sizes and of parity bitmaps, which two similar sets cannot fail. A call that finds
candidates only returns a forest that connects them; the trees of all forests make
clusters, and each cluster's classes meet once with their whole sets, in blocks, where two
are compared as long as nothing yet joins them. So links are never many more than classes.

Joins of narrow tables (ids, prints, components) are merge joins at any size, as there are
dozens of them and each broadcast table stays in the driver's memory until it is collected.

Sets hold 64-bit hashes of shingles. Two shingles of one pair of documents meet by
chance with a probability of about |union| ** 2 / 2 ** 65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybook.llm import bloom
from waybook.llm.graph import components
from waybook.llm.words import SPACED, U, batches, hashes, mix, shingles, spans
from waybook.operators.ordered import lookup
from waybook.sources.scratch import discard, stage

#: Ratio of the ends of a band of set sizes.
RATIO = 1.5
#: Cost of a signature of one element or none, in signatures: what its chance partners cost.
WEAK = 30.0
#: Shingles in more than one of so many documents count as frequent. This only steers costs.
OFTEN = 1000
#: Counters of a task's frequent shingles.
COUNTERS = 1 << 16
#: Classes of one head or cluster that are compared with each other in one block, and rows of blocks that meet in one call.
BLOCK, TOGETHER = 2048, 16384
#: Shingles of the classes of one block, and of the blocks that meet in one call.
HEAVY, LOAD = 1 << 20, 1 << 22
#: Rows of one head from which on they are dealt to several tasks.
HOT = 512
_FIXED = U(0xA0761D6478BD642F)
_BANDS = np.arange(1, 129, dtype=U) * _FIXED


@lru_cache(None)
def bands() -> list[tuple[int, int]]:
    out, lo = [], 1
    while lo < 1 << 40:
        hi = max(lo + 1, math.ceil(lo * RATIO))
        out.append((lo, hi))
        lo = hi
    return out


def differences(l: int, s: int, percent: int) -> int:
    return (l + s) * (100 - percent) // (100 + percent)


def _at_most(n: int, share: float, k: int) -> float:
    """Probability that at most k of n elements fall into a segment with this share of the universe."""
    if share >= 1:
        return float(n <= k)
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share)) for i in range(min(n, k) + 1))


@lru_cache(None)
def allocation(hi: int, percent: int) -> tuple[int, int]:
    """(segments with deletions, plain segments) of the band that ends before `hi`; the former are twice as wide.

    Least cost of signatures per document, weak ones weighted with WEAK, among
    allocations with enough units; spare plain segments are those left out.
    """
    n = hi - 1
    units = differences(n, n, percent) + 1
    best = (math.inf, 0, units)
    for a in sorted({units * i // 24 for i in range(13)}):
        for spare in sorted({units * i // 20 for i in range(11)}):
            b = max(0, units - 2 * a + (spare if units > 2 * a else 0))
            if not a and not b:
                continue
            share = 1 / (2 * a + b)
            weak = max(0.0, b * _at_most(n, share, 1) - (2 * a + b - units))
            cost = max(0, units - 2 * a) + WEAK * weak + a * (1 + 2 * n * share + WEAK * _at_most(n, 2 * share, 2))
            best = min(best, (cost, a, b))
    return best[1:]


def signatures(sets: np.ndarray, percent: int, often: np.ndarray | None = None) -> np.ndarray:
    """Signatures of one set of distinct hashes, of all bands in which it can have a partner that is not equal; `often` marks frequent ones."""
    n = len(sets)
    top, out = n * 100 // percent, []
    for k, (lo, hi) in enumerate(bands()):
        if hi <= n:
            continue
        if lo > max(n, top):
            break
        most = differences(n, min(hi - 1, max(n, top)), percent)
        if not most:
            continue
        a, b = allocation(hi, percent)
        h = mix(sets ^ _BANDS[k])
        slot = (h % U(2 * a + b)).astype(np.int64)
        segment = np.where(slot < 2 * a, slot >> 1, slot - a)
        value = mix(h + _FIXED)
        sums = np.zeros(a + b, U)
        np.add.at(sums, segment, value)
        tag = np.arange(1, a + b + 1, dtype=U) * _FIXED + U(k)
        whole = mix(sums + tag)
        if a:
            out.append(whole[:a])
            at = segment < a
            out.append(mix(sums[segment[at]] - value[at] + tag[segment[at]]))
        need = most + 1 - 2 * a
        if need > 0:
            plain = whole[a:]
            own = segment if often is None else segment[~often]
            full = np.minimum(np.bincount(own, minlength=a + b)[a:], 4).astype(U)
            out.append(plain[np.argpartition(((U(4) - full) << U(61)) | (plain >> U(3)), need - 1)[:need]] if need < b else plain)
    return np.unique(np.concatenate(out)) if out else np.empty(0, U)


def sets_of(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct shingle hashes in order) of each whole text; empty without words."""
    for first, data, offsets in batches(column):
        start, end, rows = spans(data, offsets, SPACED)
        value, at = shingles(hashes(data, start, end), rows, width)
        owner = rows[at] if len(at) else np.empty(0, np.int64)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
        cuts = np.searchsorted(owner, np.arange(len(offsets)))
        for row in range(len(offsets) - 1):
            yield first + row, value[cuts[row] : cuts[row + 1]]


def _prints(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s).sum(dtype=U).view(np.int64)), int((mix(s ^ _FIXED).sum(dtype=U) + U(len(s))).view(np.int64))


def _parity(s: np.ndarray, each: int, most: int) -> np.ndarray:
    """`each` bits per element or up to twice as many, 64 to 2 ** most: the parity of the number of elements hashed to each.

    Cut in half and added up bit by bit it is the bitmap of half the size.
    """
    bits = 1 << min(most, max(6, (each * len(s)).bit_length()))
    odd = (np.bincount((mix(s + _FIXED) & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


class _Frequent:
    """Frequent items with bounded counters: when there are too many, all lose what the last one kept has left."""

    def __init__(self):
        self.keys, self.counts, self.held, self.size = np.empty(0, U), np.empty(0, np.int64), [], 0

    def add(self, items: np.ndarray) -> None:
        self.held.append(items)
        self.size += len(items)
        if self.size > 1 << 19:
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        value, count = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.size = [], 0
        keys, place = np.unique(np.concatenate((self.keys, value)), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, place, np.concatenate((self.counts, count)))
        if len(keys) > 4 * COUNTERS:
            counts -= np.partition(counts, -COUNTERS)[-COUNTERS]
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts


def described(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_shingles, f1, f2, parity, sharp): the size, a 128-bit print and two bitmaps of each document's set.

    Rows with a null n_shingles are a task's counts of frequent shingles: f1 the hash, f2 the count.
    """
    names = ["doc_id", "text_hash", "n_shingles", "f1", "f2", "parity", "sharp"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _Frequent()
        for batch in it:
            found = []
            for _, s in sets_of(batch.column(1), width):
                found.append((len(s), *_prints(s), _parity(s, 1, 13), _parity(s, 4, 14).tobytes()))
                frequent.add(s)
            n, f1, f2, parity, sharp = zip(*found, strict=True) if found else ((), (), (), (), ())
            longs = [pa.array(x, pa.int64()) for x in (n, f1, f2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *longs, pa.array(parity, pa.list_(pa.int64())), pa.array(sharp, pa.binary())], names)
        frequent.settle()
        keep = frequent.counts > 1
        keys, counts = frequent.keys[keep].view(np.int64), frequent.counts[keep]
        for at in range(0, len(keys), 10_000):
            part = slice(at, at + 10_000)
            empty = [pa.nulls(len(keys[part]), kind) for kind in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())]
            yield pa.RecordBatch.from_arrays([empty[0], *empty[:2], pa.array(keys[part]), pa.array(counts[part]), *empty[2:]], names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, parity array<bigint>, sharp binary")


def signed(docs: DataFrame, percent: int, width: int, frequent: DataFrame) -> DataFrame:
    """(sig, doc_id, f1): the signatures of each document and the first half of its set's print; a task signs the same set once among its last million sets."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build(frequent, "hash"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in it:
            ids, held, owners, marks, count = batch.column(0).to_numpy(zero_copy_only=False), [], [], [], 0
            for row, s in sets_of(batch.column(1), width):
                mark = _prints(s)
                if mark in seen or len(s) < 2:
                    continue
                seen.add(mark)
                got = signatures(s, percent, bloom.passes(bits.value, s.view(np.int64)))
                held.append(got)
                owners.append(np.full(len(got), ids[row], np.int64))
                marks.append(np.full(len(got), mark[0], np.int64))
                count += len(got)
                if count > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(marks))], ["sig", "doc_id", "f1"])
                    held, owners, marks, count = [], [], [], 0
            if len(seen) > 1_000_000:
                seen.clear()
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(marks))], ["sig", "doc_id", "f1"])

    return docs.select("doc_id", "text").mapInArrow(run, "sig long, doc_id long, f1 long")


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, items) of the classes (cid, doc_id, f1, f2) wanted, read again from their first document's text."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted, "doc_id"))
    longs, lists = pa.int64(), pa.list_(pa.int64())
    kinds = {"doc_id": longs, "f1": longs, "f2": longs, "items": lists}

    def packed(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            batch = batch.filter(pa.array(bloom.passes(bits.value, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            held, count = [], 0
            for row, s in sets_of(batch.column(1), width):
                held.append((batch.column(0)[row].as_py(), *_prints(s), s.view(np.int64)))
                count += len(s)
                if count > 100_000:
                    yield packed(held)
                    held, count = [], 0
            if held:
                yield packed(held)

    found = docs.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, f1 long, f2 long, items array<bigint>")
    return found.join(wanted, ["doc_id", "f1", "f2"]).dropDuplicates(["doc_id", "f1", "f2"]).select("cid", "items")


def _sizes_close(n: Column, m: Column, percent: int) -> Column:
    return (100 * n >= percent * m) & (100 * m >= percent * n)


def _bits_close(p: Column, q: Column, n: Column, m: Column, percent: int) -> Column:
    """The bound on two bitmaps of the same size; others are not compared."""
    apart = F.aggregate(F.zip_with(p, q, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda s, v: s + v)
    return (F.size(p) != F.size(q)) | ((100 + percent) * apart <= (100 - percent) * (n + m))


class _Bits:
    """The bounds of sizes and bitmaps between one row of a call and all others."""

    def __init__(self, size: np.ndarray, bits: list[bytes], percent: int):
        self.size, self.percent = size, percent
        self.width = np.array([len(x) for x in bits])
        self.rows = {int(w): np.flatnonzero(self.width == w) for w in np.unique(self.width)}
        own = {w: np.frombuffer(b"".join(bits[i] for i in at), U).reshape(len(at), -1) for w, at in self.rows.items()}
        self.own, self.half = own, {w: x[:, : w // 16] ^ x[:, w // 16 :] for w, x in own.items()}
        self.place = np.empty(len(bits), np.int64)
        for at in self.rows.values():
            self.place[at] = np.arange(len(at))

    def near(self, i: int) -> np.ndarray:
        """The other rows that row i may be similar to, in order; those with much larger or smaller bitmaps differ too much in size."""
        w, k, out = int(self.width[i]), self.place[i], []
        sides = [(w, self.own[w][k], self.own), (2 * w, self.own[w][k], self.half), (w // 2, self.half[w][k], self.own)]
        for other, mine, table in sides:
            if other not in self.rows:
                continue
            at = self.rows[other]
            apart = np.bitwise_count(table[other] ^ mine[None]).sum(axis=1, dtype=np.int64)
            n, m = self.size[i], self.size[at]
            out.append(at[((100 + self.percent) * apart <= (100 - self.percent) * (n + m)) & (100 * n >= self.percent * m) & (100 * m >= self.percent * n)])
        found = np.sort(np.concatenate(out))
        return found[found != i]


def _groups(*keys: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of each distinct key."""
    order = np.lexsort(keys[::-1])
    key = np.stack(keys, axis=1)[order]
    cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True]))) if len(order) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield order[a:b]


def _edges(found: set[tuple[int, int]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _blocked(rows: DataFrame, key: str) -> DataFrame:
    """Each row once for every pair of its key's blocks (low, high) that its own block belongs to."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", other)
    return rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})


def candidates(members: DataFrame, bounds: DataFrame, percent: int) -> DataFrame:
    """(a, b): a forest over the classes of each head (head, cid, component, blocks) that are apart and meet the bounds on `sharp`.

    Every pair of such classes is in one tree; a call returns fewer rows than it gets.
    """
    rows = stage(_blocked(members, "head").select("head", "cid", "component", "block", "low", "high"), "members")
    calls = max(1, -(-rows.count() // TOGETHER))
    bounds = bounds.join(rows.select("cid").distinct(), "cid", "left_semi")
    rows = rows.withColumn("call", F.pmod(F.xxhash64("head", "low", "high"), F.lit(calls))).join(bounds, "cid")

    def run(table: pa.Table) -> pa.Table:
        head, low, high, cid, component, block, n = (table[c].to_numpy() for c in ("head", "low", "high", "cid", "component", "block", "n"))
        bits, found = table["sharp"].to_pylist(), set()
        for at in _groups(head, low, high):
            near = _Bits(n[at], [bits[x] for x in at], percent)
            tree, one = np.arange(len(at)), low[at[0]] == high[at[0]]
            for i in range(len(at)):
                others = near.near(i)
                others = others[(tree[others] != tree[i]) & (component[at[others]] != component[at[i]])]
                for j in (others if one else others[block[at[others]] != block[at[i]]]).tolist():
                    if tree[j] != tree[i]:
                        tree[tree == tree[j]] = tree[i]
                        found.add((int(min(cid[at[i]], cid[at[j]])), int(max(cid[at[i]], cid[at[j]]))))
        return _edges(found)

    return rows.groupBy("call").applyInArrow(run, "a long, b long")


def _similar(codes: list[np.ndarray], i: int, others: np.ndarray, flags: np.ndarray, percent: int) -> np.ndarray:
    """Which of the other sets are similar to set i; sets are distinct numbers of elements."""
    flags[codes[i]] = 1
    sizes = np.array([len(codes[j]) for j in others])
    both = np.add.reduceat(flags[np.concatenate([codes[j] for j in others])], np.cumsum(sizes) - sizes)
    flags[codes[i]] = 0
    return 100 * both >= percent * (len(codes[i]) + sizes - both)


def linked(clusters: DataFrame, percent: int, done: str) -> DataFrame:
    """(a, b): links that join what is similar among the classes (cluster, cid, component, blocks, n, sharp, items) of each cluster.

    `done` picks the pairs of blocks. A call compares two classes only if neither their components
    nor the links it has found join them, so it returns fewer links than it gets classes.
    """
    rows = _blocked(clusters, "cluster").filter(done)
    load = rows.agg(F.sum("n")).first()[0]
    if load is None:
        return clusters.select(F.col("cid").alias("a"), F.col("cid").alias("b")).limit(0)
    rows = rows.withColumn("call", F.pmod(F.xxhash64("cluster", "low", "high"), F.lit(-(-load // LOAD))))

    def run(table: pa.Table) -> pa.Table:
        cluster, low, high, cid, component, block, n = (table[c].to_numpy() for c in ("cluster", "low", "high", "cid", "component", "block", "n"))
        bits, found = table["sharp"].to_pylist(), set()
        lists = table["items"].combine_chunks()
        starts, items = lists.offsets.to_numpy(), lists.values.to_numpy()
        for at in _groups(cluster, low, high):
            near, one = _Bits(n[at], [bits[x] for x in at], percent), low[at[0]] == high[at[0]]
            _, coded = np.unique(np.concatenate([items[starts[x] : starts[x + 1]] for x in at]), return_inverse=True)
            codes = np.split(coded, np.cumsum(starts[at + 1] - starts[at])[:-1])
            flags = np.zeros(int(coded.max()) + 1, np.int64)
            joined = np.unique(component[at], return_inverse=True)[1]
            for i in range(len(at)):
                others, size = near.near(i), 1
                others = others[others > i]
                others = others if one else others[block[at[others]] != block[at[i]]]
                while len(others := others[joined[others] != joined[i]]):
                    part, others = others[:size], others[size:]
                    for j in part[_similar(codes, i, part, flags, percent)].tolist():
                        if joined[j] != joined[i]:
                            joined[joined == joined[j]] = joined[i]
                            found.add((int(min(cid[at[i]], cid[at[j]])), int(max(cid[at[i]], cid[at[j]]))))
                    size = min(2 * size, 256)
        return _edges(found)

    return rows.groupBy("call").applyInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets (cid, items) are similar enough."""
    both = lookup(pairs, sets.select(F.col("cid").alias("a"), F.col("items").alias("ai")), ["a"], ["b"], "inner", BLOCK)
    both = both.join(sets.select(F.col("cid").alias("b"), F.col("items").alias("bi")), "b")
    both = both.select("a", "b", F.size("ai").alias("an"), F.size("bi").alias("bn"), F.size(F.array_intersect("ai", "bi")).alias("both"))
    return both.filter(100 * F.col("both") >= percent * (F.col("an") + F.col("bn") - F.col("both"))).select("a", "b")


def _with_component(rows: DataFrame, parts: DataFrame, key: str, name: str) -> DataFrame:
    """A class without links is a component of its own."""
    return rows.join(parts.select(F.col("node").alias(key), F.col("component").alias(name)).hint("merge"), key, "left").withColumn(name, F.coalesce(name, key))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def star_links(star: DataFrame, bitmaps: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(links, components) of classes and heads (head, head_n, cid, n): each class with its smallest head first, then with those of other components."""
    near = star.filter(_sizes_close(F.col("head_n"), F.col("n"), percent))
    near = near.join(bitmaps.select(F.col("cid").alias("head"), F.col("parity").alias("p")), "head").join(bitmaps.select("cid", F.col("parity").alias("q")), "cid")
    near = stage(near.filter(_bits_close(F.col("p"), F.col("q"), F.col("head_n"), F.col("n"), percent)).select("head", "cid"), "near")
    ids = near.select("cid").union(near.select("head")).distinct()
    wanted = stage(classes.join(ids.hint("merge"), "cid").select("cid", "doc_id", "f1", "f2"), "wanted")
    sets = stage(whole_sets(docs, wanted, width), "items")
    # a pair may be in both directions; the smaller class is the head of one of them
    one = near.groupBy("cid").agg(F.min("head").alias("head"))
    links = stage(verified(one.select(*_pair("head", "cid")).distinct(), sets, percent), "links")
    parts = components(links)
    apart = _with_component(_with_component(near, parts, "cid", "of"), parts, "head", "to").filter(F.col("of") != F.col("to"))
    more = verified(apart.select(*_pair("head", "cid")).distinct(), sets, percent)
    more = _with_component(_with_component(more, parts, "a", "of"), parts, "b", "to").groupBy(F.least("of", "to").alias("x"), F.greatest("of", "to").alias("y"))
    more = more.agg(F.min_by(F.struct("a", "b"), F.struct("a", "b")).alias("pair")).select("pair.a", "pair.b")  # one link for two components
    both = stage(links.union(more), "links")
    discard(parts, links, wanted, near, sets)
    return both, components(both)


def cluster_links(star: DataFrame, parts: DataFrame, marks: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """Links between classes that share a head and are in different components (node, component) so far."""
    shared = _with_component(star.select("head", "cid"), parts, "cid", "component")
    open_ = shared.groupBy("head").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = lookup(shared, open_.filter("least < most").select("head", "blocks"), ["head"], ["cid"], "inner", HOT)
    bounds = marks.select("cid", "n", "sharp").dropDuplicates(["cid"])
    forest = stage(candidates(members, bounds, percent), "forest")
    clusters = components(forest).select(F.col("node").alias("cid"), F.col("component").alias("cluster"))
    wanted = stage(classes.join(clusters.select("cid").hint("merge"), "cid").select("cid", "doc_id", "f1", "f2"), "wanted")
    load = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / HEAVY)).cast("int").alias("blocks")
    rows = clusters.join(bounds, "cid")
    rows = lookup(rows, rows.groupBy("cluster").agg(load), ["cluster"], ["cid"], "inner", HOT)
    rows = stage(rows.join(whole_sets(docs, wanted, width), "cid"), "clusters")
    found = forest.limit(0)
    # inside blocks, the first block with each other one, then all the rest: each step knows what the ones before have joined
    for step, done in enumerate(("low = high", "low = 0 AND high > 0", "low > 0 AND high > low")):
        if step and rows.filter("blocks > 1").isEmpty():
            break
        now = components(found.union(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))) if step else parts
        found = stage(found.union(linked(_with_component(rows, now, "cid", "component"), percent, done)).distinct(), "links")
    discard(forest, wanted, rows)
    return found


def classified(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, links) of (doc_id, text): what `described` gives, one row per distinct set, and the links between classes."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50: sets of one element can only be equal then")
    described_ = stage(described(docs, width), "sets")
    rows = described_.filter("n_shingles IS NOT NULL")
    known = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sizes = [F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")]
    classes = stage(known.groupBy("f1", "f2").agg(*sizes).withColumn("cid", F.monotonically_increasing_id()), "classes")
    frequent = described_.filter("n_shingles IS NULL").groupBy(F.col("f1").alias("hash")).agg(F.sum("f2").alias("n"))
    frequent = stage(frequent.filter(F.col("n") > max(2, rows.count() // OFTEN)).select("hash"), "frequent")

    # one shuffle of the signatures; the running first needs no bucket in memory. Heads and members are sets, as an id may have several
    first = F.first("f1").over(Window.partitionBy("sig").orderBy("doc_id", "f1"))
    met = signed(docs.filter("doc_id IS NOT NULL"), percent, width, frequent).withColumn("first", first).filter("first != f1")
    met = stage(met.select("first", "f1").distinct(), "met")
    owners = classes.filter("n > 1").select("f1", "cid", "n")
    heads = owners.select(F.col("f1").alias("first"), F.col("cid").alias("head"), F.col("n").alias("head_n"))
    star = met.join(owners.hint("merge"), "f1").join(heads.hint("merge"), "first").filter(F.col("cid") != F.col("head"))
    star = stage(star.select("head", "head_n", "cid", "n").distinct(), "star")

    # a class's bitmaps are those of its first document
    marks = described_.filter("n_shingles > 1").join(classes.select("doc_id", "f1", "f2", "cid", "n"), ["doc_id", "f1", "f2"])
    small = stage(marks.select("cid", "parity").dropDuplicates(["cid"]), "bitmaps")
    links, parts = star_links(star, small, docs, classes, percent, width)
    more = cluster_links(star, parts, marks, docs, classes, percent, width)
    both = stage(links.union(more), "links")
    discard(parts, links, more, met, star, small, frequent)
    return described_, classes, both


def join(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_shingles, component_id, text_hash.

    Links join documents whose sets have 100 * intersection >= percent * union, for a percent
    above 50. Texts without words, empty or null: no shingles, their own component. Rows
    without a doc_id are linked with nothing and have no component. Repeated rows,
    and repeated ids with other texts, stay rows of their own. Other columns of
    `docs` are not read. An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described_, classes, both = classified(docs, percent, width)
    rows = described_.filter("n_shingles IS NOT NULL")
    known = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    parts = components(both)
    discard(both)
    of = _with_component(classes.select("f1", "f2", "cid", "doc_id"), parts, "cid", "component")
    heads = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = of.join(heads.hint("merge"), "component").select("f1", "f2", "component_id")
    done = known.join(of.hint("merge"), ["f1", "f2"]).select("doc_id", "n_shingles", "component_id", "text_hash")
    return done.union(rows.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash"))


def distinct(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, all columns, that stay: of each component the document with the smallest doc_id, once.

    Documents that are linked with nothing stay, texts without words and rows without
    a doc_id among them. A document is its doc_id and text; of repeated ones any row stays.
    """
    found = stage(join(docs, **how), "components").filter("doc_id IS NOT NULL")
    out = found.filter("component_id != doc_id").select(F.col("doc_id").alias("_out_id"), F.col("text_hash").alias("_out_hash")).distinct()
    same = (docs.doc_id.cast("long") == out["_out_id"]) & (F.xxhash64(docs.text) == out["_out_hash"])
    left = docs.join(out, same, "left_anti")
    twice = found.filter("component_id = doc_id").groupBy(F.col("doc_id").alias("_out_id"), F.col("text_hash").alias("_out_hash")).count().filter("count > 1").drop("count")
    if twice.isEmpty():
        return left
    twice = stage(twice, "repeated")
    same = (docs.doc_id.cast("long") == twice["_out_id"]) & (F.xxhash64(docs.text) == twice["_out_hash"])
    return left.join(twice, same, "left_anti").union(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
