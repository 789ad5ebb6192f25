"""Ranked lexical search: a dual-sorted wavelet tree per shard, searched best-first with exact bounds.

A shard holds whole documents, numbered in ascending order of doc_id. Its postings stand term by term,
each term's by falling impact, and a wavelet tree (in the layout of one bit array per level) over the
document numbers makes the same sequence navigable by document: a node is a range of numbers, and a
term's postings in it are one interval in which the impacts still fall. So a node's bound is the sum of
each term's first impact there times the term's weight, and at a leaf that is the document's score.

A query intersects the intervals of all its terms node by node, the node of the highest bound first,
many at a time. A node goes on only while its bound beats the k-th best score so far, or equals it with
smaller ids; the k best of one shard are the start for the task's next shard. Nothing else is left out,
so the result is exact. Of each task and item only the k best leave.

Impacts need the number of documents and terms, weights the global document frequency; the first are
counted in a pass of their own, the others from the shards' term lists. Documents are never shuffled; a
shard holds about SHARD bytes of text, or one text that is longer. Queries go to the tasks in blocks of
BLOCK characters, each block one pass over the shards.

Defined results: a null or empty text, or one without terms, is in no shard; an item without terms finds
nothing; rows that repeat a doc_id or an item are documents and items of their own; documents of null
doc_id come last among equal scores; an empty table gives no row. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_schema, batch_of, by_bytes, in_batches, saved

#: Bytes of text and documents of a shard, shards of a file, characters of a block of queries.
SHARD, SHARD_DOCS, SHARDS, BLOCK = 8 << 20, 1 << 16, 4, 1 << 22
#: Most nodes that are opened side by side.
WIDTH = 256
_SHARD_DDL = "docs array<bigint>, terms binary, starts binary, impacts binary, bits binary"
_LAST = np.iinfo(np.int64).max

#: Digits, letters and all bytes of other characters make terms; A-Z are lower-cased, all else is a space.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_IN_TERM = np.frombuffer(_TERM, np.uint8) != 32


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and where each begins and the last ends."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def term_counts(texts: pa.Array) -> np.ndarray:
    """Terms of each text, with repeats."""
    data, offsets = _bytes(texts)
    inside = _IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begins[cuts] = inside[cuts]
    return np.diff(np.concatenate(([0], np.cumsum(begins)))[offsets])


def term_lists(texts: pa.Array) -> pa.Array:
    """The terms of each text in order, and empty strings where it begins or ends with other characters."""
    data, offsets = _bytes(texts)
    spaced = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data.tobytes().translate(_TERM)))
    return pc.ascii_split_whitespace(spaced)


def impact(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Of a term in documents of n terms, where `docs` documents have `terms` terms: below 10^6."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * n * docs // terms))


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def build_shard(ids: pa.Array, texts: pa.Array, docs: int, terms: int) -> tuple | None:
    """One row of _SHARD_DDL; none where no text has a term."""
    n = term_counts(texts)
    keep = np.flatnonzero(n)
    if not len(keep):
        return None
    names = pc.fill_null(ids, _LAST).to_numpy()[keep]
    keep = keep[np.argsort(names, kind="stable")]
    ids, texts, n = ids.take(pa.array(keep)), texts.take(pa.array(keep)), n[keep]
    lists = term_lists(texts)
    coded = lists.flatten().dictionary_encode()
    # Terms get their numbers in order, and the empty string, if there is one, the first.
    words = coded.dictionary
    order = pc.array_sort_indices(words).to_numpy()
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(len(words))
    words = words.take(pa.array(order))
    blank = int(len(words) > 0 and words[0].as_py() == "")
    term = number[coded.indices.to_numpy()]
    doc = np.repeat(np.arange(len(keep)), np.diff(lists.offsets.to_numpy()))
    key, tf = np.unique((term * len(keep) + doc)[term >= blank], return_counts=True)
    term, doc = key // len(keep) - blank, key % len(keep)
    value = impact(tf, n[doc], docs, terms)
    falling = np.argsort(term << 20 | ((1 << 20) - 1 - value), kind="stable")
    doc, value = doc[falling], value[falling].astype("<i4")
    starts = np.searchsorted(term, np.arange(len(words) - blank + 1)).astype("<i4")
    depth = (len(keep) - 1).bit_length()
    bits = np.empty((depth, len(doc)), bool)
    for level in range(depth):
        bits[level] = one = (doc >> (depth - 1 - level) & 1).astype(bool)
        doc = np.concatenate((doc[~one], doc[one]))
    return ids.to_pylist(), "\n".join(words.to_pylist()[blank:]).encode(), starts.tobytes(), value.tobytes(), np.packbits(bits).tobytes()


class Shard:
    """A shard's tree, with ranks and the impacts in the order of each level."""

    def __init__(self, docs: list, terms: bytes, starts: bytes, impacts: bytes, bits: bytes):
        self.docs = docs
        #: For order among equal scores.
        self.order = np.array([_LAST if d is None else d for d in docs], np.int64)
        self.terms = pa.array(terms.split(b"\n"), pa.binary())
        self.starts = np.frombuffer(starts, "<i4")
        first = np.frombuffer(impacts, "<i4")
        self.size, self.depth = len(first), (len(docs) - 1).bit_length()
        ones = np.unpackbits(np.frombuffer(bits, np.uint8))[: self.depth * self.size].reshape(self.depth, self.size)
        self.rank = np.zeros((self.depth, self.size + 1), np.int32)
        np.cumsum(ones, axis=1, out=self.rank[:, 1:])
        self.zeros = self.size - self.rank[:, -1]
        self.impact = np.empty((self.depth + 1, self.size), np.int32)
        self.impact[0] = first
        for level, one in enumerate(ones.view(bool)):
            zeros = self.zeros[level]
            self.impact[level + 1, :zeros], self.impact[level + 1, zeros:] = self.impact[level][~one], self.impact[level][one]

    def bounds(self, level: np.ndarray, a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of nodes (rows) with the intervals a to b of the terms (columns)."""
        first = self.impact.ravel()[(level * self.size)[:, None] + np.minimum(a, self.size - 1)]
        return np.where(b > a, first, 0).astype(np.int64) @ weights

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: list[tuple[int, int, int | None]]) -> None:
        """Put the k best documents into `best`, a heap of (score, -order, doc_id) that may hold some of other shards.

        terms: numbers of this shard's terms.
        """
        none = np.zeros(1, np.int64)
        a, b = self.starts[terms].astype(np.int64)[None], self.starts[terms + 1].astype(np.int64)[None]
        level, low, bound = none, none, self.bounds(none, a, b, weights)
        heap: list[tuple] = []
        rank, width = self.rank.ravel(), 16
        while True:
            # Leaves are documents; other nodes wait for their turn.
            leaf = level == self.depth
            found = leaf & (bound > 0)
            for score, at in zip(bound[found].tolist(), low[found].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (score, -int(self.order[at]), self.docs[at]))
                elif (score, -self.order[at]) > best[0][:2]:
                    heapq.heapreplace(best, (score, -int(self.order[at]), self.docs[at]))
            least, name = (best[0][0], -best[0][1]) if len(best) == k else (0, -1)
            begin = self.order[np.minimum(low, len(self.order) - 1)]
            wait = ~leaf & ((bound > least) | ((bound == least) & (begin < name)))
            for i in np.flatnonzero(wait).tolist():
                heapq.heappush(heap, (-int(bound[i]), int(low[i]), int(level[i]), a[i], b[i]))
            chosen = []
            while heap and len(chosen) < width:
                node = heapq.heappop(heap)
                if -node[0] < least:
                    heap = []
                elif -node[0] > least or self.order[node[1]] < name:
                    chosen.append(node)
            if not chosen:
                return
            width = min(2 * width, WIDTH)
            low, level = np.array([c[1] for c in chosen]), np.array([c[2] for c in chosen])
            a, b = np.stack([c[3] for c in chosen]), np.stack([c[4] for c in chosen])
            base = (level * (self.size + 1))[:, None]
            ra, rb, zeros = rank[base + a].astype(np.int64), rank[base + b].astype(np.int64), self.zeros[level][:, None]
            a, b = np.concatenate((a - ra, zeros + ra)), np.concatenate((b - rb, zeros + rb))
            low = np.concatenate((low, low + (1 << (self.depth - 1 - level))))
            level = np.concatenate((level, level)) + 1
            bound = self.bounds(level, a, b, weights)


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        n = term_counts(batch.column("text"))
        docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield batch_of([(docs, terms)], arrow_schema("docs bigint, terms bigint"))


def _sharded(docs: int, terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_SHARD_DDL)
        held: list[pa.RecordBatch] = []

        def built():
            whole = pa.Table.from_batches(held).combine_chunks()
            row = build_shard(*(whole.column(c).combine_chunks() for c in ("doc_id", "text")), docs, terms)
            if row:
                yield batch_of([row], schema)

        used = 0
        for batch in batches:
            for part in by_bytes(batch, "text", SHARD // 8):
                size = part.nbytes
                if held and (used + size > SHARD or sum(p.num_rows for p in held) + part.num_rows > SHARD_DOCS):
                    yield from built()
                    held, used = [], 0
                held.append(part)
                used += size
        if held:
            yield from built()

    return run


def build_index(spark: SparkSession, docs: DataFrame, folder: str) -> None:
    """Write the shards of all documents, and the totals, to a new folder."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    totals = docs.select("text").mapInArrow(_sized, "docs bigint, terms bigint").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms"))
    totals.write.parquet(f"{folder}/totals")
    row = spark.read.schema("docs bigint, terms bigint").parquet(f"{folder}/totals").first()
    # Few shards a file, as a reader holds one file's rows at once.
    docs.mapInArrow(_sharded(row.docs, row.terms), _SHARD_DDL).write.option("compression", "zstd").option("maxRecordsPerFile", SHARDS).parquet(f"{folder}/shards")


def _frequencies(terms: pa.Array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for words, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                at = pc.index_in(terms, value_set=pa.array(words.as_py().split(b"\n"), pa.binary()))
                known = np.flatnonzero(at.is_valid())
                total[known] += np.diff(np.frombuffer(starts.as_py(), "<i4"))[at.drop_null().to_numpy()]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], schema=arrow_schema("term bigint, df bigint"))

    return run


def _found(queries: list[tuple[int, np.ndarray, np.ndarray]], terms: pa.Array, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {row: [] for row, _, _ in queries}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(*(batch.column(c)[i].as_py() for c in ("docs", "terms", "starts", "impacts", "bits")))
                place = pc.fill_null(pc.index_in(terms, value_set=shard.terms), -1).to_numpy()
                for row, own, weights in queries:
                    here = place[own] >= 0
                    if here.any():
                        shard.search(place[own][here], weights[here], k, best[row])
        yield from in_batches(((row, doc, score) for row, held in best.items() for score, _, doc in held), arrow_schema("row bigint, doc_id bigint, score bigint"))

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items' rows and texts, a block of BLOCK characters at a time."""
    block, used = [], 0
    for row in items.select("row", "text").filter("text is not null").toLocalIterator():
        block.append((row.row, row.text))
        used += len(row.text)
        if used >= BLOCK:
            yield block
            block, used = [], 0
    if block:
        yield block


def search(spark: SparkSession, folder: str, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item, scores above 0."""
    items = saved(items.select("item_id", "text").withColumn("row", F.monotonically_increasing_id()), "items")
    shards = spark.read.schema(_SHARD_DDL).parquet(f"{folder}/shards")
    docs = spark.read.schema("docs bigint, terms bigint").parquet(f"{folder}/totals").first().docs
    results: list[DataFrame] = []
    for block in _blocks(items):
        counted = [(row, Counter(t for t in words if t)) for (row, _), words in zip(block, term_lists(pa.array([t for _, t in block])).to_pylist(), strict=True)]
        names = sorted({t for _, own in counted for t in own})
        terms, number = pa.array([t.encode() for t in names], pa.binary()), {t: i for i, t in enumerate(names)}
        df = dict(map(tuple, shards.select("terms", "starts").mapInArrow(_frequencies(terms), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()))
        queries = []
        for row, own in counted:
            weighed = [(number[t], n * weight(df[number[t]], docs)) for t, n in own.items() if number[t] in df]
            weighed = np.array([x for x in weighed if x[1]], np.int64).reshape(-1, 2)
            queries.append((row, weighed[:, 0], weighed[:, 1]))
        found = shards.mapInArrow(_found(queries, terms, k), "row bigint, doc_id bigint, score bigint")
        if results or len(block) and sum(len(t) for _, t in block) >= BLOCK:
            found = saved(found, "found")
        results.append(found)
    if not results:
        results = [spark.createDataFrame([], "row bigint, doc_id bigint, score bigint")]
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))).filter(F.col("rank") <= k)
    return ranked.join(items.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
