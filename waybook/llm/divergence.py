"""Source divergence audit by chunk factorization.

A chunk is a run of text without ASCII white space; terms never cross it. A task reads
documents in blocks, orders a block's documents by (lang, source), counts each document's
chunks and writes them once: the block's distinct chunks, numbered, and for each number its
entries, one per document that has it. The globally distinct chunks are cut into terms once.
A term can be in no more documents than its chunks together; those of enough are joined
back to the blocks' chunks, and entries never go through that join. Each block is
then put together again: the entries of all chunks with one term, merged by document, give
how many of its documents hold the term and how often each of its groups does. What a block holds
of a hot chunk is one row, so no chunk, language or source is gathered in one task.

Differences of sources are summed without pairing rows: terms are dealt to calls, and a call
lays its terms' p out as a matrix of terms and sources, of which it sums absolute
differences of columns, a few sources against all at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybook.sources.scratch import discard, stage

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text and documents of a block; a longer text is a block of its own.
BYTES, DOCS = 24 << 20, 1 << 16
#: Chunks whose entries stand in one row, and rows of an Arrow batch.
TOGETHER, ROWS = 1 << 14, 1 << 16
#: (term, source) counts that meet in one call, and cells of its matrices.
CALL, CELLS = 1 << 18, 1 << 20
#: How the largest tables are written: running numbers as differences, pages by zstd.
SMALL = {"compression": "zstd", "parquet.writer.version": "v2"}
_BLOCK = pa.schema([
    ("block", pa.int64()), ("code", pa.int32()), ("chunk", pa.string()), ("docs", pa.int32()), ("sizes", pa.binary()), ("held", pa.binary()), ("counts", pa.binary()),
    ("lang", pa.string()), ("source", pa.string()),
])


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _BLOCK], schema=_BLOCK)


def _block(number: int, texts: pa.Array, langs: pa.Array, sources: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of one block: its groups in order, its chunks with their documents, its entries (document less the one before, and count, 16 bits each, deflated)."""
    order = pc.sort_indices(pa.table({"l": langs, "s": sources}), sort_keys=[("l", "ascending"), ("s", "ascending")])
    texts, langs, sources = texts.take(order), langs.take(order), sources.take(order)
    runs = pa.table({"l": langs, "s": sources}).group_by(["l", "s"], use_threads=False).aggregate([([], "count_all")])
    runs = runs.sort_by([("l", "ascending"), ("s", "ascending")]).combine_chunks()
    take = lambda name: runs[name].combine_chunks()
    yield _rows(block=pa.array([number] * len(runs), pa.int64()), lang=take("l").cast(pa.string()), source=take("s").cast(pa.string()), docs=take("count_all").cast(pa.int32()))

    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    words = coded.dictionary.cast(pa.string())
    order = pc.sort_indices(words).to_numpy()  # neighbours that begin alike take less when written
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words, both = words.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)]
    del texts, lists, coded, order, rank
    both *= DOCS
    both += np.repeat(np.arange(len(length)), length)
    both.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(both)), bool), both[1:] != both[:-1])))
    both, count = both[first], np.diff(np.append(first, len(both)))
    if len(count) and count.max() >= 1 << 16:  # such a count has several entries
        times = (count + 0xFFFE) // 0xFFFF
        both, last = np.repeat(both, times), np.cumsum(times) - 1
        rest, count = count - (times - 1) * 0xFFFF, np.full(len(both), 0xFFFF)
        count[last] = rest
    held, count = (both % DOCS).astype("<u2"), count.astype("<u2")
    sizes = np.bincount(both // DOCS, minlength=len(words))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    for at in range(0, len(words), ROWS):
        part = words.slice(at, ROWS)
        docs = pa.array(sizes[at : at + len(part)].astype(np.int32))
        yield _rows(block=pa.array(np.full(len(part), number)), code=pa.array(np.arange(at, at + len(part), dtype=np.int32)), chunk=part, docs=docs)
    for at in range(0, len(words), TOGETHER):
        to = min(at + TOGETHER, len(words))
        three = {"sizes": sizes[at:to].astype("<u4"), "held": np.diff(held[ends[at] : ends[to]], prepend=held.dtype.type(0)), "counts": count[ends[at] : ends[to]]}
        yield _rows(block=pa.array([number], pa.int64()), code=pa.array([at], pa.int32()), **{n: pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for n, x in three.items()})


def chunked(docs: DataFrame) -> DataFrame:
    """Rows of three kinds, each with its block: groups (lang, source, docs), chunks (code, chunk, docs), entries (code of the first, sizes, held, counts)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, count = TaskContext.get().partitionId() << 32, [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size, count
            if held:
                yield from _block(number, *(pa.concat_arrays([h[i] for h in held]) for i in range(3)))
                pa.default_memory_pool().release_unused()
            number, held, size, count = number + 1, [], 0, 0

        for batch in it:
            columns = [c.cast(pa.large_string()).fill_null("") for c in batch.columns]
            ends = np.cumsum(pc.binary_length(columns[0]).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(int(np.searchsorted(ends, before + BYTES - size, "right")), at + (not held))
                to = min(to, at + DOCS - count)
                if to > at:
                    held.append([c.slice(at, to - at) for c in columns])
                    size, count = size + int(ends[to - 1]) - before, count + to - at
                if to < batch.num_rows:
                    yield from flush()
                at = to
        yield from flush()

    return docs.select("text", "lang", "source").mapInArrow(run, "block long, code int, chunk string, docs int, sizes binary, held binary, counts binary, lang string, source string")


def terms_of(chunk: Column) -> Column:
    """All terms in a chunk, repeated ones too."""
    lower = F.translate(chunk, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., size[0] numbers, then those from start[1] and so on."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _counts(chunks: pa.Table, rest: pa.Table) -> pa.Table:
    """Of one block (lid, tid, groups): a row per language and term, with the groups that have it, how often, and in how many documents."""
    each = pa.struct([("gid", pa.int32()), ("n", pa.int64()), ("docs", pa.int64())])
    schema = pa.schema([("lid", pa.int32()), ("tid", pa.int64()), ("groups", pa.list_(each))])
    parts = rest.filter(pc.is_valid(rest["held"])).sort_by("code")
    if not len(chunks) or not len(parts):
        return schema.empty_table()
    plane = lambda name, kind: [np.frombuffer(zlib.decompress(x), kind) for x in parts[name].to_pylist()]
    sizes, counts = np.concatenate(plane("sizes", "<u4")).astype(np.int64), np.concatenate(plane("counts", "<u2"))
    held = np.concatenate([np.cumsum(x, dtype="<u2") for x in plane("held", "<u2")])  # differences wrap around, and so do their sums
    begin = np.cumsum(sizes) - sizes
    groups = rest.filter(pc.is_valid(rest["docs"])).sort_by("gid")
    ends = np.cumsum(groups["docs"].to_numpy())
    gid, lang = groups["gid"].to_numpy(), groups["lid"].to_numpy()

    lists = chunks["tids"].combine_chunks()
    tid, coded = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    code = np.repeat(chunks["code"].to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    size = sizes[code]
    at = _ranges(begin[code], size)
    # term, document and count in one number: terms of a block are fewer than 2 ** 31, documents at most 2 ** 16
    found = held[at].astype(np.int64) << 16 | counts[at]
    found |= np.repeat(coded, size) << 32
    found.sort()
    place, count = found >> 16, found & 0xFFFF
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    place, count = place[first], np.add.reduceat(count, first)  # one row per term and document
    term, group = place >> 16, np.searchsorted(ends, place & (DOCS - 1), "right")
    new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (group[1:] != group[:-1]))))
    docs, total, term, group = np.diff(np.append(new, len(term))), np.add.reduceat(count, new), term[new], group[new]
    new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (lang[group[1:]] != lang[group[:-1]]))))
    own = pa.StructArray.from_arrays([pa.array(gid[group], pa.int32()), pa.array(total), pa.array(docs)], fields=list(each))
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(term)).astype(np.int32)), own)
    return pa.Table.from_arrays([pa.array(lang[group[new]], pa.int32()), pa.array(tid[term[new]]), lists], schema=schema)


def counted(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, names, terms), all written: groups (lid, lang, gid, source), names (tid, term), terms (lid, tid, gid, n, docs), a row per group and term.

    Every term that `least` documents of a language hold is there, with all its rows.
    """
    blocks = stage(chunked(docs), "blocks", **SMALL)
    groups = blocks.filter("lang IS NOT NULL").select("lang", "source").distinct()
    # one row per group: numbered in the order of a block's groups
    numbered = groups.withColumns({"gid": F.row_number().over(Window.orderBy("lang", "source")), "lid": F.dense_rank().over(Window.orderBy("lang"))})
    groups = stage(numbered.select("lid", "lang", "gid", "source"), "groups")
    chunks = blocks.filter("chunk IS NOT NULL").select("block", "code", "chunk", "docs")
    cut = chunks.groupBy("chunk").agg(F.sum("docs").alias("docs")).select("chunk", "docs", F.explode(terms_of(F.col("chunk"))).alias("term"))
    cut = stage(cut, "chunks", **SMALL)
    names = cut.groupBy("term").agg(F.sum("docs").alias("most")).filter(F.col("most") >= least)
    names = stage(names.select(F.monotonically_increasing_id().alias("tid"), "term"), "names")
    of = cut.select("chunk", "term").join(names, "term").groupBy("chunk").agg(F.collect_list("tid").alias("tids"))  # as many as fit in the chunk
    joined = chunks.select("block", "code", "chunk").join(of, "chunk").select("block", "code", "tids")
    rest = blocks.filter("chunk IS NULL").drop("chunk").join(groups, ["lang", "source"], "left").drop("lang", "source")
    rest = rest.toDF(*rest.columns)
    made = joined.groupBy("block").cogroup(rest.groupBy("block")).applyInArrow(_counts, "lid int, tid bigint, groups array<struct<gid:int,n:bigint,docs:bigint>>")
    made = made.select("tid", F.inline("groups")).groupBy("tid", "gid").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    made = stage(made.join(groups.select("lid", "gid"), "gid").select("lid", "tid", "gid", "n", "docs"), "terms")  # a group tells its language
    discard(blocks, cut)
    return groups, names, made


def _differences(counts: pa.Table, sums: pa.Table) -> pa.Table:
    """(gid, other, value): the sum of abs(p - q) over the terms of this call, for all sources of one language; `sums` holds them all, with base, their p of no occurrence."""
    schema = pa.schema([("gid", pa.int32()), ("other", pa.int32()), ("value", pa.int64())])
    sums = sums.sort_by("gid")
    gid, base = sums["gid"].to_numpy(), sums["base"].to_numpy()
    n = len(gid)
    tid, place = np.unique(counts["tid"].to_numpy(), return_inverse=True)
    column, p = np.searchsorted(gid, counts["gid"].to_numpy()), counts["p"].to_numpy()
    order = np.argsort(place, kind="stable")
    place, column, p = place[order], column[order], p[order]
    out, rows, tile = [], max(1, CELLS // max(1, n)), 64
    for left in range(0, n, tile):
        value = np.zeros((min(tile, n - left), n), np.int64)
        for at in range(0, len(tid), rows):
            a, b = np.searchsorted(place, (at, at + rows))
            cells = np.tile(base, (min(rows, len(tid) - at), 1))
            cells[place[a:b] - at, column[a:b]] = p[a:b]
            for i in range(len(value)):
                value[i] += np.abs(cells - cells[:, left + i, None]).sum(axis=0)
        mine, other = np.divmod(np.arange(value.size), n)
        apart = mine + left != other
        out.append(pa.Table.from_arrays([pa.array(gid[mine[apart] + left], pa.int32()), pa.array(gid[other[apart]], pa.int32()), pa.array(value.ravel()[apart])], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10 ** 9 * (count + 5) / (total + 5 * kept)), in exact numbers."""
    big = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", (big(count) + 5) * F.lit(1_000_000_000).cast("decimal(10,0)"), big(total) + 5 * big(kept))


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) of (text, lang, source).

    Null text, lang and source are the empty string. A language keeps the terms that at least
    `least` of its rows hold; p is a kept term's smoothed share in a group. Part `pair` has the
    sum of abs(p - q) against every other source of the language, 0 where no term is kept; part
    `term` the `top` kept terms of the group whose p is furthest above that of the whole language.
    Repeated rows each count; other columns are not read. An empty table gives an empty one.
    """
    groups, names, terms = counted(docs, least)
    kept = stage(terms.groupBy("lid", "tid").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lid", "tid"), "kept")
    counts = stage(terms.join(kept, ["lid", "tid"]).select("lid", "tid", "gid", "n"), "counts")
    discard(terms)

    size = F.coalesce(F.col("kept"), F.lit(0))
    kept_n = kept.groupBy("lid").agg(F.count(F.lit(1)).alias("kept"))
    sums = groups.join(counts.groupBy("gid").agg(F.sum("n").alias("total")), "gid", "left").join(kept_n, "lid", "left")
    sums = sums.withColumns({"total": F.coalesce("total", F.lit(0)), "kept": size})
    sums = sums.withColumn("base", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(0)))
    sums = stage(sums.withColumn("all", F.sum("total").over(Window.partitionBy("lid"))), "sums")  # one row per group

    calls = max(1, -(-counts.count() // CALL))
    p = share(F.col("n"), F.col("total"), F.col("kept"))
    shares = counts.join(sums.select("gid", "total", "kept"), "gid").select("lid", "tid", "gid", p.alias("p"), F.pmod(F.xxhash64("tid"), F.lit(calls)).alias("call"))
    every = sums.select("lid", "gid", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(calls - 1).cast("long"))).alias("call")).toDF("lid", "gid", "base", "call")
    pairs = shares.groupBy("lid", "call").cogroup(every.groupBy("lid", "call")).applyInArrow(_differences, "gid int, other int, value long")
    pairs = pairs.groupBy("gid", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.join(groups.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other").select("gid", F.lit("pair").alias("part"), "item", "value")

    whole = counts.groupBy("lid", "tid").agg(F.sum("n").alias("m"))
    rare = counts.join(whole, ["lid", "tid"]).join(sums.select("gid", "total", "kept", "all"), "gid")
    above = rare.select("tid", "gid", (share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("m"), F.col("all"), F.col("kept"))).alias("value")).filter("value > 0")
    above = above.join(names.select("tid", F.col("term").alias("item")), "tid").select("gid", F.lit("term").alias("part"), "item", "value")

    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", rank).union(above.withColumn("rank", rank).filter(F.col("rank") <= top))
    return ranked.join(groups.select("gid", "lang", "source"), "gid").select("lang", "source", "part", "item", "value", "rank")
