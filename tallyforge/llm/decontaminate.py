"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows (runs of `size` words) of the benchmark items; an item with fewer words
is one window of its own length. For each window length the matcher holds a shift table keyed by
two-word blocks, which tells how far the scan may jump, and for blocks that end a window a bucket of
the windows with that suffix, against which the document's words are compared directly.

Defined results: null or wordless texts have no words, no hits and are clean; null or wordless items
have no window, nor has an item without an id, which no result could name; ids of items are whole numbers;
repeated items and rows are answered alike; an empty benchmark leaves every document clean. Only the
named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_schema, batch_of, remembers, saved, sliced

#: Fixed by the contract: word characters are 0-9, a-z (after lower-casing A-Z) and all above 0x7F.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class WuManber:
    """Windows of one length. scan() gives (start, items) of every occurrence."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[int]]):
        self.m = m = len(next(iter(windows)))
        self.b = b = min(2, m)
        self.skip = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[tuple[bytes, ...], set[int]]] = {}
        for window, items in windows.items():
            for end in range(b, m + 1):
                block = b" ".join(window[end - b : end])
                self.shift[block] = min(self.shift.get(block, self.skip), m - end)
            self.buckets.setdefault(block, {})[window] = items

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        m, n, far, i = self.m, len(words), self.skip, self.m
        shift = self.shift.get
        while i <= n:
            block = words[i - 2] + b" " + words[i - 1] if m > 1 else words[i - 1]
            step = shift(block, far)
            if step:
                i += step
                continue
            items = self.buckets[block].get(tuple(words[i - m : i]))
            if items is not None:
                yield i - m, items
            i += 1


def matchers(items: list[tuple[int, str | None]], size: int = 10) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(size, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(words[k : k + m]), set()).add(item)
    return [WuManber(windows) for _, windows in sorted(by_length.items())]


_HITS_DDL = "row bigint, n_words bigint, positions array<bigint>, items array<bigint>"


def _scan(held, size: int, whole: bool):
    """The words of each row that lie in a window, and the windows' items; of rows without any only if whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(held, size)
        for batch in sliced(batches):
            rows = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, positions, items = _hits(tables, text)
                if whole or items:
                    rows.append((row, n, positions, items))
            yield batch_of(rows, arrow_schema(_HITS_DDL))

    return run


def _hits(tables: list[WuManber], text: str | None) -> tuple[int, list[int], list[int]]:
    words = words_of(text)
    positions: set[int] = set()
    items: set[int] = set()
    for table in tables:
        for start, got in table.scan(words):
            positions.update(range(start, start + table.m))
            items |= got
    return len(words), sorted(positions), sorted(items)


_built: dict[str, list[WuManber]] = {}


def _tables(held, size: int) -> list[WuManber]:
    """The matchers of a broadcast (name, items), built once a worker; those of an earlier block are forgotten."""
    remembers("decontaminate", _built.clear)
    name, items = held.value
    if name not in _built:
        _built.clear()
        _built[name] = matchers(items, size)
    return _built[name]


def _reported(found: list[tuple[int, list[int], list[int]]]) -> dict[str, pa.Array]:
    return {
        "n_words": pa.array([n for n, _, _ in found], pa.int64()),
        "n_hit": pa.array([len(x) for _, x, _ in found], pa.int64()),
        "n_items": pa.array([len(x) for _, _, x in found], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for _, _, x in found], pa.string()),
        "contaminated": pa.array([bool(x) for _, x, _ in found], pa.bool_()),
        "items": pa.array([x for _, _, x in found], pa.list_(pa.int64())),
    }


def _report(held, size: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(held, size)
        for batch in sliced(batches):
            made = _reported([_hits(tables, text) for text in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *made.values()], names=[*keep, *made])

    return run


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 10, carry: tuple[str, ...] = (), block_chars: int = 2_000_000) -> DataFrame:
    """docs' doc_id and carry columns with n_words, n_hit, n_items, items_sha256, contaminated, items.

    block_chars bounds the benchmark text that a task holds (about 90 bytes of tables a character): a
    larger benchmark is cut into blocks of items. Then rows are numbered and written once, every block
    passes over their texts and gives only the hits of rows that have some, and these are put together.
    """
    bench = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null and item_id is not null")
    total = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_chars))
    keep = ["doc_id", *[c for c in carry if c != "doc_id"]]

    def block(k: int):
        part = bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        return spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.item_id, r.text) for r in part.collect()]))

    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    if blocks == 1:
        kinds = dict(rows.dtypes)
        ddl = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<bigint>"
        return rows.mapInArrow(_report(block(0), size, keep), ddl)
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    hits = None
    for k in range(blocks):
        part = saved(rows.select("row", "text").mapInArrow(_scan(block(k), size, k == 0), _HITS_DDL), "hits")
        hits = part if hits is None else hits.unionByName(part)
    both = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("positions", "items")]
    found = rows.select("row", *keep).join(hits.groupBy("row").agg(F.max("n_words").alias("n_words"), *both), "row")
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        *keep, "n_words", F.size("positions").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (F.size("positions") > 0).alias("contaminated"), "items",
    )
