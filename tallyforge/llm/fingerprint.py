"""Document fingerprints from closed syncmers.

A k-mer of a text's UTF-8 bytes is a closed syncmer if the least hash among its inner s-mers is that
of its first or last one; whether a k-mer is chosen depends on nothing outside it, so equal passages
give equal anchors wherever they stand. The fingerprint keeps every distinct anchor with the position of its
first occurrence, so it grows with the text: 40 bits of hash and about 8 of position for one byte in 8.5,
as text 1.0 characters a byte. Likeness matches anchors that lie at like positions.

Defined results: a null or empty text has the empty fingerprint (likeness 1 to another empty one, 0
to any other); one length of k-mers serves all texts, and a text in which none is chosen has its whole
as anchor; equal texts have equal fingerprints; rows that repeat a doc_id follow each other in order of their texts, nulls last; the
only document is its own next. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_schema, in_batches, sliced

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return (x ^ (x >> np.uint64(29))) * _B


#: Bytes of a k-mer and of its inner s-mers; bytes of an anchor's hash.
K, S, WIDTH = 20, 4, 5


def syncmers(data: bytes, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and 64-bit hashes of the closed syncmers; s is at most 8, k from 8 to 24."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    grams = np.ndarray(len(data) + 1, "<u8", raw.data, strides=(1,))
    inner = _mix(grams if s == 8 else grams & np.uint64((1 << 8 * s) - 1))[: len(data) - s + 1]
    width, least, span = k - s + 1, inner, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: n], least[width - span : width - span + n])
    at = np.flatnonzero((inner[:n] == least[:n]) | (inner[width - 1 : width - 1 + n] == least[:n]))
    return at, _mix(_mix(_mix(grams[at]) ^ grams[at + (k - 8) // 2]) ^ grams[at + k - 8])


def anchors(text: str | None, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """All anchors of a text: hashes of WIDTH bytes in rising order, and positions. Its ends are padded by k - s zero bytes,
    so that short texts have anchors of the same kind as long ones."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pad = b"\0" * (k - s)
    at, hashes = syncmers(pad + text.encode() + pad, k, s)
    if not len(at):
        at, hashes = np.zeros(1, np.int64), np.array([xxhash.xxh3_64_intdigest(text.encode())], np.uint64)
    distinct, first = np.unique(hashes >> np.uint64(64 - 8 * WIDTH), return_index=True)
    return distinct, at[first]


def encode(found: tuple[np.ndarray, np.ndarray]) -> str:
    """The fingerprint as base64: the number of anchors (4 bytes), their hashes in order of position (WIDTH bytes each),
    and the gaps between positions (7 bits a byte, lowest first, all but a gap's last byte marked)."""
    order = np.argsort(found[1], kind="stable")
    hashes, gaps = found[0][order], np.diff(found[1][order], prepend=0)
    digits = np.stack([gaps >> 7 * j for j in range(5)], axis=1)
    used = np.column_stack((np.ones(len(gaps), bool), digits[:, 1:] > 0))
    more = np.column_stack((used[:, 1:], np.zeros(len(gaps), bool)))
    packed = ((digits & 127) | more * 128).astype(np.uint8)[used]
    wide = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :]
    return base64.b64encode(len(gaps).to_bytes(4, "big") + wide.tobytes() + packed.tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a fingerprint, as anchors() gives them."""
    data = base64.b64decode(fingerprint)
    n = int.from_bytes(data[:4], "big")
    wide = np.zeros((n, 8), np.uint8)
    wide[:, 8 - WIDTH :] = np.frombuffer(data, np.uint8, n * WIDTH, 4).reshape(n, WIDTH)
    packed = np.frombuffer(data, np.uint8, offset=4 + n * WIDTH).astype(np.int64)
    last = packed < 128
    begin = np.flatnonzero(np.concatenate(([True], last[:-1]))) if n else np.zeros(0, np.int64)
    place = np.arange(len(packed)) - np.repeat(begin, np.diff(begin, append=len(packed)))
    positions = np.cumsum(np.add.reduceat((packed & 127) << 7 * place, begin)) if n else np.zeros(0, np.int64)
    hashes = wide.view(">u8").ravel().astype(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], positions[order]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of anchors that two texts hold in common at like positions (Dice), 0 to 1."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    slack = 64 + max(a[1].max(), b[1].max()) // 4
    alike = np.count_nonzero(np.abs(a[1][i] - b[1][j]) <= slack)
    return float(2 * alike / (len(a[0]) + len(b[0])))


def edited(text: str, following: str) -> str:
    """The text whose last third is replaced by the beginning of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


FINGERPRINT_DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of documents in descending order, each closed by the first document of the next range."""

    def rows():
        before = None  # group, doc_id, text, anchors
        for batch in sliced(batches):
            columns = (batch.column(c).to_pylist() for c in ("group", "ahead", "doc_id", "text"))
            for group, ahead, doc, text in zip(*columns, strict=True):
                same = before is not None and before[0] == group
                if ahead and not same:
                    continue
                text = text or ""
                found = anchors(text)
                if same:
                    changed = edited(before[2], text)
                    other = anchors(changed)
                    yield (
                        before[1], len(before[2]), hashlib.sha256(changed.encode()).hexdigest(), encode(before[3]), encode(other),
                        likeness(before[3], other), likeness(before[3], found),
                    )
                before = None if ahead else (group, doc, text, found)

    yield from in_batches(rows(), arrow_schema(FINGERPRINT_DDL), 64)


def fingerprints(spark: SparkSession, docs: DataFrame, per_range: int = 1000, max_ranges: int = 20_000) -> DataFrame:
    """Fingerprints of every document and of its edited text, with likenesses.

    The order by doc_id is cut into ranges; each range also gets the first document of the next one,
    so that texts move once. Only ids of range ends (at most max_ranges) come to the driver.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    n = docs.select("doc_id").count()
    ranges = max(1, min(max_ranges, -(-n // per_range)))
    cuts: list[float] = []
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        cuts = sorted(set(docs.filter("doc_id is not null").approxQuantile("doc_id", shares, 1 / (4 * ranges))))
    held = spark.sparkContext.broadcast([int(c) for c in cuts])

    def group_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = held.value
        for batch in batches:
            groups = [len(ends) + 1 if i is None else len(ends) - bisect.bisect_left(ends, i) for i in batch.column("doc_id").to_pylist()]
            names = [*batch.schema.names, "group"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(groups, pa.int32())], names=names)

    grouped = docs.select("doc_id").mapInArrow(group_of, "doc_id bigint, group int")
    first = {r.group: r.first for r in grouped.groupBy("group").agg(F.max("doc_id").alias("first")).collect()}
    order = sorted(first)
    ahead_of = {g: order[k - 1] for k, g in enumerate(order)}  # the first range follows the last
    heads = spark.sparkContext.broadcast((first, ahead_of))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, ahead_of = heads.value
        for batch in group_of(batches):
            groups, ids = batch.column("group").to_pylist(), batch.column("doc_id").to_pylist()
            again = [k for k, (g, i) in enumerate(zip(groups, ids, strict=True)) if i == first[g]]
            picked = [*range(len(ids)), *again]
            to = [*groups, *(ahead_of[groups[k]] for k in again)]
            texts = batch.column("text").take(pa.array(picked, pa.int64()))
            columns = [pa.array([ids[k] for k in picked], pa.int64()), texts, pa.array(to, pa.int32()), pa.array([k >= len(ids) for k in range(len(picked))], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "group", "ahead"])

    moved = docs.mapInArrow(dealt, "doc_id bigint, text string, group int, ahead boolean")
    parts = max(1, min(len(order), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    keys = [F.col("group"), F.col("ahead"), F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last()]
    return moved.repartition(parts, "group").sortWithinPartitions(*keys).mapInArrow(_ordered, FINGERPRINT_DDL)
