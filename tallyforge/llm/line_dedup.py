"""Line dedup with levelled sorted runs of line hashes.

Every batch of documents brings its line keys (128-bit hashes) with the number of documents that hold
them, sorted by hash. Keys that the runs already know as frequent are taken out by a merge-anti-join,
and the rest is added as the batch's own run. When a level holds `fanout` runs they are merged into one
run of the next level, so a store that saw N batches has about fanout * log(N) runs; keys that reach
`min_docs` in such a merge join the sorted runs of frequent keys, which later batches are joined with.
At last every run is merged once more, and the lines of all documents are anti-joined with the frequent
keys: each task merges its sorted line hashes with them, or, where they are too many to be sent to the
tasks, a salted join does.

Defined results: a null or empty text is one empty line; the empty key is never dropped; a line that
repeats inside one document counts as one document; rows that repeat a doc_id are separate documents;
an empty table gives an empty result. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_schema, drop_saved, in_batches, remembers, saved, sliced

_BLANK = " \t\n\v\f\r"
_RUN_DDL = "batch int, h1 bigint, h2 bigint, n bigint"
#: Distinct keys that one task counts before it passes its partial counts on.
_FLUSH = 150_000


def _lines(text: pa.Array) -> tuple[pa.ListArray, list[str]]:
    """The lines of every text, and the key of every line."""
    parts = pc.split_pattern(pc.fill_null(text, ""), "\n")
    flat = parts.flatten()
    return parts, pc.ascii_lower(pc.ascii_trim(flat, characters=_BLANK)).to_pylist()


def _digest(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode())


def _count(n_batches: int, spread: int):
    """Documents to partial (batch, hash, documents) counts; `spread` names the batch of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_RUN_DDL)
        remembers("line_dedup", lambda: None)
        counts: Counter[tuple[int, bytes]] = Counter()

        def flush():
            rows = ((b, *np.frombuffer(h, "<i8").tolist(), n) for (b, h), n in counts.items())
            yield from in_batches(rows, schema, 20_000)
            counts.clear()

        for batch in sliced(batches):
            parts, keys = _lines(batch.column("text"))
            ends = parts.offsets.to_pylist()
            ids = batch.column("doc_id").to_pylist()
            for i, doc in enumerate(ids):
                b = 0 if doc is None else (doc * spread & 0x7FFFFFFF) % n_batches
                counts.update((b, _digest(k)) for k in set(keys[ends[i] - ends[0] : ends[i + 1] - ends[0]]) if k)
            if len(counts) > _FLUSH:
                yield from flush()
        yield from flush()

    return run


class LineRuns:
    """A store of line keys in levels of sorted runs.

    min_docs: documents that make a key frequent. fanout: runs of a level before compaction.
    broadcast_keys: up to so many frequent keys (16 bytes each) go to every task as a broadcast;
    beyond it, lines meet them in a salted shuffle join.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 4, broadcast_keys: int = 500_000, salts: int = 32):
        self.spark, self.min_docs, self.fanout, self.broadcast_keys, self.salts = spark, min_docs, fanout, broadcast_keys, salts
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    @staticmethod
    def _merged(runs: Sequence[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("h1", "h2").agg(F.sum("n").alias("n")).sortWithinPartitions("h1", "h2")

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """One batch's counts, sorted, without the keys that the runs know as frequent."""
        rows = self._merged([counts.select("h1", "h2", "n")])
        if not self.settled:
            return rows
        return rows.join(reduce(DataFrame.unionByName, self.settled).hint("merge"), ["h1", "h2"], "left_anti").sortWithinPartitions("h1", "h2")

    def add(self, counts: DataFrame) -> None:
        """One batch's counts (h1, h2, n) become a run of level 0; full levels are compacted."""
        self.levels[0].append(saved(self.unsettled(counts), "run"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            runs, self.levels[level] = self.levels[level], []
            merged = saved(self._merged(runs), "run")
            self.settled.append(saved(merged.filter(F.col("n") >= self.min_docs).select("h1", "h2"), "settled"))
            self.levels[level + 1].append(merged.filter(F.col("n") < self.min_docs))
            for run in runs:
                drop_saved(run)
            level += 1

    def add_documents(self, docs: DataFrame, n_batches: int = 8) -> None:
        """Deal the documents into batches and add each batch's run, in one pass over the texts."""
        staged = saved(
            docs.select("doc_id", "text").mapInArrow(_count(n_batches, 0x9E3779B1), _RUN_DDL), "lines", ["batch"]
        )
        for b in range(n_batches):
            self.add(staged.filter(F.col("batch") == b))
        drop_saved_parts(staged)

    def frequent(self) -> DataFrame:
        """Keys that at least min_docs of all documents added so far hold."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        found = self._merged(runs).filter(F.col("n") >= self.min_docs).select("h1", "h2")
        return reduce(DataFrame.unionByName, [found, *self.settled]).distinct()

    def clean(self, docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """docs without the lines whose keys are frequent: doc_id, carry, kept, n_lines, n_dropped, kept_sha256."""
        frequent = saved(self.frequent(), "frequent")
        docs = docs.select("doc_id", "text", *carry)
        ddl = ", ".join(f"{n} {k}" for n, k in docs.drop("text").dtypes) + ", kept string, n_lines bigint, n_dropped bigint, kept_sha256 string"
        if frequent.count() <= self.broadcast_keys:
            held = self.spark.sparkContext.broadcast(SortedRun(frequent.toArrow()))
            return docs.mapInArrow(_drop(lambda _: held.value, ddl), ddl)
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))))
        seen = docs.mapInArrow(_occurrences(self.salts), "doc_id bigint, h1 bigint, h2 bigint, salt int")
        hits = (
            seen.join(salted, ["h1", "h2", "salt"])
            .groupBy("doc_id")
            .agg(F.collect_set(F.concat(F.hex("h1"), F.lit(":"), F.hex("h2"))).alias("_hits"))
        )
        marked = docs.join(hits, docs["doc_id"].eqNullSafe(hits["doc_id"]), "left").drop(hits["doc_id"])
        return marked.mapInArrow(_drop(None, ddl), ddl)


class SortedRun:
    """Frequent keys in rising order, to be merged with other sorted keys."""

    def __init__(self, rows: pa.Table):
        h1, h2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        order = np.lexsort((h2, h1))
        self.h1, self.h2 = h1[order], h2[order]
        _, sizes = np.unique(self.h1, return_counts=True)
        self.widest = int(sizes.max(initial=0))

    def holds(self, digests: list[bytes]) -> np.ndarray:
        """Which of the keys the run holds: they are sorted and merged with it."""
        wanted = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        order = np.argsort(wanted[:, 0], kind="stable")
        first, second = wanted[order, 0], wanted[order, 1]
        found, at = np.zeros(len(order), bool), np.searchsorted(self.h1, first)
        for step in range(self.widest):  # keys that share their first half lie side by side
            here = np.minimum(at + step, len(self.h1) - 1)
            found |= (self.h1[here] == first) & (self.h2[here] == second)
        out = np.empty(len(order), bool)
        out[order] = found
        return out


def drop_saved_parts(df: DataFrame) -> None:
    """Delete a partitioned table that saved() wrote."""
    spark = df.sparkSession
    for folder in {name.rpartition("/batch=")[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _occurrences(salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("doc_id bigint, h1 bigint, h2 bigint, salt int")
        for batch in sliced(batches):
            parts, keys = _lines(batch.column("text"))
            ends = parts.offsets.to_pylist()
            rows = (
                (doc, *np.frombuffer(_digest(k), "<i8").tolist(), (doc or 0) % salts)
                for i, doc in enumerate(batch.column("doc_id").to_pylist())
                for k in set(keys[ends[i] - ends[0] : ends[i + 1] - ends[0]])
                if k
            )
            yield from in_batches(rows, schema, 20_000)

    return run


def _drop(held, ddl: str):
    """Rewrite texts without frequent lines; held: keys for all rows, else each row brings its own in _hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split(" ", 1)[0] for f in ddl.split(",")]
        remembers("line_dedup", lambda: None)
        frequent = held(None) if held else None
        for batch in sliced(batches):
            parts, line_keys = _lines(batch.column("text"))
            lines, ends = parts.flatten().to_pylist(), parts.offsets.to_pylist()
            gone: set[str] = set()
            if frequent is not None and (keys := [k for k in set(line_keys) if k]):
                gone = set(compress(keys, frequent.holds(list(map(_digest, keys))).tolist()))
            own = batch.column("_hits").to_pylist() if frequent is None else None
            kept, n_lines, n_dropped, shas = [], [], [], []
            for i in range(batch.num_rows):
                a, b = ends[i] - ends[0], ends[i + 1] - ends[0]
                if own is not None:
                    hits = {np.array([int(x, 16) for x in h.split(":")], "<u8").tobytes() for h in own[i] or ()}
                    gone = {k for k in set(line_keys[a:b]) if k and _digest(k) in hits}
                stay = [line for line, key in zip(lines[a:b], line_keys[a:b], strict=True) if key not in gone]
                text = "\n".join(stay)
                kept.append(text)
                n_lines.append(b - a)
                n_dropped.append(b - a - len(stay))
                shas.append(hashlib.sha256(text.encode()).hexdigest())
            made = {"kept": pa.array(kept, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names=names)

    return run


def dedupe_lines(spark: SparkSession, docs: DataFrame, min_docs: int = 10, carry: Sequence[str] = (), n_batches: int = 8, **options) -> DataFrame:
    """Add all documents to a new store of runs, then clean them against it."""
    runs = LineRuns(spark, min_docs, **options)
    runs.add_documents(docs, n_batches)
    return runs.clean(docs, carry)
