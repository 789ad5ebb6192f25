"""Token ids as files: canonical length-limited Huffman codes, independent blocks, bit-offset checkpoints.

A folder of three tables:

    codes   id, bits             code length of each id that occurs; the codes follow from (bits, id)
    blocks  part, block, first, tokens, doc_ids, lengths, marks, data
    parts   part, base           ids before each part

A block holds whole documents, at least BLOCK ids of them where the part has as many. Its `data` starts
at bit 0, most significant bit first, and needs no other block; `marks` are the bit offsets of every
256th id. `first` counts the part's ids before the block, `lengths` the ids of each document. Ids stand in ascending
order of doc_id. A reader decodes all stretches between marks of a block side by side, by one table from
the next 18 bits to id and length; that each stretch ends at the next mark is checked.

Code lengths come from the counts of all ids (package-merge, at most LIMIT bits). The driver sees one
count an id of the vocabulary and one row a part; a task holds one block, or one document that is longer.
Tasks that run again write the same files, and tables are committed as Spark commits them.

Defined results: a null or empty text is its end id alone; documents of null doc_id come first; rows
that repeat a doc_id are documents of their own, in the order in which they are read; an empty table
gives files without blocks. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_schema, batch_of, by_bytes, drop_saved, in_batches, remembers, saved
from tallyforge.llm.packing import tokenizer

#: Ids that a block holds at least, ids between marks, most bits of a code, ids of a part.
BLOCK, EVERY, LIMIT, PART = 1 << 16, 256, 18, 1 << 25
_CHUNK = 8 << 20
_IDS_DDL = "doc_id bigint, ids binary"
_COUNT_DDL = "id bigint, n bigint"
_BLOCK_DDL = "part bigint, block bigint, first bigint, tokens bigint, doc_ids array<bigint>, lengths array<bigint>, marks array<bigint>, data binary"
_DOC_DDL = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
_PIECE_DDL = "start bigint, ids binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code, with the least total for these counts among codes of at most `limit` bits."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights = np.asarray(counts, np.int64)[order]
    levels, packages = [], weights[:0]
    for _ in range(limit):
        both = np.concatenate((weights, packages))
        sorting = np.argsort(both, kind="stable")
        levels.append(sorting < n)
        both = both[sorting]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for own in reversed(levels):
        mine = int(own[:take].sum())
        lengths[:mine] += 1
        take = 2 * (take - mine)
    found = np.empty(n, np.int64)
    found[order] = lengths
    return found


class Codec:
    """Canonical codes of `ids` (ascending) with `bits` each: code words, and the table that decodes them."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        ids, bits = ids[order], bits[order]
        self.most = int(bits[-1]) if len(bits) else 1
        #: A code's words of the decoding table follow each other in the order of the codes.
        width = np.left_shift(1, self.most - bits)
        begin = np.cumsum(width) - width
        self.bits = np.zeros(int(ids.max(initial=0)) + 1, np.uint8)
        self.codes = np.zeros(len(self.bits), np.uint32)
        self.bits[ids], self.codes[ids] = bits, begin >> (self.most - bits)
        self.id_at = np.zeros(1 << self.most, "<u4")
        self.bits_at = np.zeros(1 << self.most, np.uint8)
        filled = int(width.sum())
        self.id_at[:filled], self.bits_at[:filled] = np.repeat(ids, width), np.repeat(bits, width)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of every EVERY-th id."""
        n = self.bits[ids].astype(np.int64)
        ends = np.cumsum(n)
        at = ends - n
        # Each code lies in a word of 32 bits and the next one; sums of disjoint bits are their union.
        code = self.codes[ids].astype(np.uint64) << (64 - n - (at & 31)).astype(np.uint64)
        word = at >> 5
        begin = np.flatnonzero(np.diff(word, prepend=-1))
        words = np.zeros(int(word[-1]) + 2, np.uint64)
        words[word[begin]] = np.add.reduceat(code >> np.uint64(32), begin)
        words[word[begin] + 1] += np.add.reduceat(code & np.uint64(0xFFFFFFFF), begin)
        return words.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8], at[::EVERY]

    def decode(self, data: bytes, marks: np.ndarray, tokens: int, lanes: slice = slice(None)) -> np.ndarray:
        """The ids of a block, or of those of its stretches between marks that `lanes` names."""
        raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        chosen = range(len(marks))[lanes]
        at, ends = marks[lanes].copy(), marks[chosen.start + 1 : chosen.stop + 1]
        last = tokens - EVERY * (len(marks) - 1) if chosen.stop == len(marks) else EVERY
        out = np.zeros((EVERY, len(at)), "<u4")
        shift = np.uint32(32 - self.most)
        for k in range(EVERY):
            if k == last:
                at = at[:-1]
            found = (window[at >> 3] << (at & 7).astype(np.uint32)) >> shift
            out[k, : len(at)] = self.id_at[found]
            at = at + self.bits_at[found]
            if at.max(initial=0) > 8 * len(data):
                raise ValueError("a block of token ids is damaged")
        if not np.array_equal(at[: len(ends)], ends[: len(at)]):
            raise ValueError("a block of token ids is damaged")
        return out.T.reshape(-1)[: EVERY * (len(chosen) - 1) + last]


def _tokens(path: str, end: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("packing", tokenizer.cache_clear)
        close, schema = np.array([end], "<u4").tobytes(), arrow_schema(_IDS_DDL)
        for batch in batches:
            for part in by_bytes(batch, "text", _CHUNK):
                ids = tokenizer(path).encode(part.column("text"))
                ids = [np.frombuffer(i + close, "<u4").astype(kind).tobytes() for i in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], schema=schema)

    return run


def _counted(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                more = np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=len(counts))
                more[: len(counts)] += counts
                counts = more
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], schema=arrow_schema(_COUNT_DDL))

    return run


def _encoded(ids: np.ndarray, bits: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, schema = Codec(ids, bits), TaskContext.get().partitionId(), arrow_schema(_BLOCK_DDL)
        docs, pieces, held, first, block, width = [], [], 0, 0, 0, np.dtype(kind).itemsize

        def row():
            data, marks = codec.encode(np.frombuffer(b"".join(pieces), kind))
            return part, block, first, held, docs, [len(p) // width for p in pieces], marks, data

        for batch in batches:
            for doc, piece in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                docs.append(doc)
                pieces.append(piece.as_py())
                held += len(pieces[-1]) // width
                if held >= BLOCK:
                    yield batch_of([row()], schema)
                    docs, pieces, held, first, block = [], [], 0, first + held, block + 1
        if docs:
            yield batch_of([row()], schema)

    return run


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str, end: int = 2) -> None:
    """Write the ids of all texts, each closed by `end`, to a new folder."""
    from tokenizers import Tokenizer

    # Ids move in two bytes where the vocabulary allows.
    kind = "<u2" if max(Tokenizer.from_file(vocabulary).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_tokens(vocabulary, end, kind), _IDS_DDL)
    tokens = saved(found.withColumn("row", F.monotonically_increasing_id()), "ids")
    counts = tokens.select("ids").mapInArrow(_counted(kind), _COUNT_DDL).groupBy("id").agg(F.sum("n").alias("n")).toArrow().sort_by("id")
    ids, n = counts.column("id").to_numpy(), counts.column("n").to_numpy()
    bits = code_lengths(n)
    spark.createDataFrame(pa.table({"id": ids, "bits": bits})).coalesce(1).write.parquet(f"{folder}/codes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n.sum()) // PART))
    ordered = tokens.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "ids")
    ordered.mapInArrow(_encoded(ids, bits, kind), _BLOCK_DDL).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    drop_saved(tokens)
    sizes = spark.read.schema(_BLOCK_DDL).parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    sizes.select("part", before.alias("base")).write.parquet(f"{folder}/parts")


def _opened(spark: SparkSession, folder: str) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """The blocks with the number of ids before each, and the codes (one row an id of the vocabulary)."""
    codes = spark.read.schema("id bigint, bits bigint").parquet(f"{folder}/codes").toArrow().sort_by("id")
    parts = spark.read.schema("part bigint, base bigint").parquet(f"{folder}/parts")
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{folder}/blocks")
    # One row a file of ids: a hundred thousand of them are 1.6 MB.
    blocks = blocks.join(F.broadcast(parts), "part").withColumn("base", F.col("base") + F.col("first"))
    return blocks, (codes.column("id").to_numpy(), codes.column("bits").to_numpy())


def _blocks(batches: Iterator[pa.RecordBatch], codes: tuple[np.ndarray, np.ndarray]):
    """Codec and row of each block."""
    codec = Codec(*codes)
    for batch in batches:
        for k in range(batch.num_rows):
            yield codec, {c: batch.column(c)[k] for c in batch.schema.names}


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids before it), n_tokens and ids (little-endian unsigned 32-bit) of every document."""
    blocks, codes = _opened(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for codec, row in _blocks(batches, codes):
                ids = codec.decode(row["data"].as_py(), np.array(row["marks"].as_py()), row["tokens"].as_py()).tobytes()
                at = 0
                for doc, n in zip(row["doc_ids"].as_py(), row["lengths"].as_py(), strict=True):
                    yield doc, row["base"].as_py() + at, n, ids[4 * at : 4 * (at + n)]
                    at += n

        yield from in_batches(rows(), arrow_schema(_DOC_DDL), 500)

    return blocks.select("base", "tokens", "doc_ids", "lengths", "marks", "data").mapInArrow(run, _DOC_DDL)


def read_slice(spark: SparkSession, folder: str, start: int, count: int) -> DataFrame:
    """Ids from number `start` on, `count` at most: a row (start, ids) for each block, decoded from the nearest marks."""
    blocks, codes = _opened(spark, folder)
    stop = start + count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for codec, row in _blocks(batches, codes):
                base, tokens, marks = row["base"].as_py(), row["tokens"].as_py(), np.array(row["marks"].as_py())
                a, b = max(start - base, 0), min(stop - base, tokens)
                lanes = slice(a // EVERY, -(-b // EVERY))
                ids = codec.decode(row["data"].as_py(), marks, tokens, lanes)
                yield base + a, ids[a - EVERY * lanes.start : b - EVERY * lanes.start].tobytes()

        yield from in_batches(rows(), arrow_schema(_PIECE_DDL), 100)

    met = blocks.filter((F.col("base") < stop) & (F.col("base") + F.col("tokens") > start) & F.lit(count > 0))
    return met.select("base", "tokens", "marks", "data").mapInArrow(run, _PIECE_DDL)
