"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A document is cut at full windows; its
remainder goes best-fit into the fullest open window that can take it. When none can, the fullest
window is topped up with the front of the piece if its gap is larger than `tolerance` tokens, and
emitted, and the search goes on with what is left. The open windows that remain are merged: groups of
`merge` partitions pack them again in the same way, until one group is left.

Space per task: `open_windows` windows of `size` tokens, whatever the partition holds. The pieces of
one window lie together and gapless from 0. A sequence is named by round, task and order in the task.

Defined results: a null or empty text is one end token; repeated rows and ids are packed as rows of
their own; an empty table gives no piece. Only the named columns are read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_schema, by_bytes, in_batches, remembers, saved

PIECE_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, window int, ids binary"
#: Words that each of a worker's two generations of remembered words holds.
_WORDS = 500_000
#: Bytes of text whose words are looked up together.
_CHUNK = 8 << 20


#: The settings under which the ids of a text are those of its parts between spaces and line feeds: the
#: splitter's pattern takes no white space, and only letters next to each other influence each other.
_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


#: Words that need no normalizing, are letters in every version of Unicode, and so are one part.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: The splitter cuts between these letters and digits and the marks that follow; a space there changes no id.
_MARKS = r"([a-z0-9ß-öø-ÿ])([,.!?;:%&#*])"


class WordTokenizer:
    """Token ids of whole texts, word by word.

    A vocabulary with the settings of _BY_WORDS never joins across a space or line feed, so the ids of a
    text are those of its parts; the distinct parts of many texts are looked up once and the ids gathered
    by position, and each part is encoded once and remembered. The vocabulary ignores case and cuts
    between letters and marks, so texts without a special token are lower-cased and cut there first. New
    words are encoded many at a time. With any other settings whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        built = Tokenizer.from_file(path)
        made = json.loads(built.to_str())
        suffix = made["model"].get("end_of_word_suffix")
        self.by_words = bool(suffix) and all(made[key] == value for key, value in _BY_WORDS.items()) and not made["post_processor"]
        self._encode = built.encode_batch_fast
        self._special = {t.content: i for i, t in built.get_added_tokens_decoder().items()}
        if self.by_words:
            # Plain words meet the model at once; each is cut after its one closing token.
            byte_level = _BY_WORDS["pre_tokenizer"]["pretokenizers"][1]
            made.update(normalizer=None, added_tokens=[], pre_tokenizer={"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]})
            self._encode_plain = Tokenizer.from_str(json.dumps(made)).encode_batch_fast
            self._closing = np.zeros(built.get_vocab_size() + 1, bool)
            self._closing[[i for token, i in built.get_vocab().items() if token.endswith(suffix)]] = True
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _alone(self, text: str) -> bytes:
        return np.array(self._encode([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode words into the young generation."""
        plain, rest = [], []
        for word in words:
            (plain if _PLAIN.fullmatch(word) else rest).append(word)
        self._learn_joined(plain, self._encode_plain, " ", lambda ids: np.flatnonzero(self._closing[ids]) + 1, 0)
        if self._special:
            content, number = max(self._special.items(), key=lambda x: x[1])
            self._learn_joined(rest, self._encode, f" {content} ", lambda ids: np.append(np.flatnonzero(ids == number), len(ids)), 1)
        else:
            self._young.update((w, self._alone(w)) for w in rest)

    def _learn_joined(self, words: list[str], encode, between: str, ends, gap: int) -> None:
        """Encode words side by side; ends() finds where each one's ids end, and `gap` ids part them."""
        groups = [words[k : k + 200] for k in range(0, len(words), 200)]
        for group, got in zip(groups, encode([between.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            cuts = ends(ids)
            if len(cuts) != len(group):  # a word holds the special token itself
                self._young.update((w, self._alone(w)) for w in group)
                continue
            data, begin = ids.tobytes(), 0
            for word, cut in zip(group, cuts.tolist(), strict=True):
                self._young[word] = data[4 * begin : 4 * cut]
                begin = cut + gap

    def _entries(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self._young) > _WORDS:
            self._young, self._old = {}, self._young
        young, old = self._young, self._old
        learn = []
        for word in words:
            if word not in young:
                if (known := old.get(word)) is None:
                    learn.append(word)
                else:
                    young[word] = known
        for k in range(0, len(learn), 4000):
            self._learn(learn[k : k + 4000])
        return list(map(young.__getitem__, words))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            return [self._alone(t) for t in texts.to_pylist()]
        if not len(texts):
            return []
        easy = pc.replace_substring_regex(pc.ascii_lower(texts), _MARKS, r"\1 \2")
        for content in self._special:
            easy = pc.if_else(pc.match_substring(texts, content, ignore_case=True), texts, easy)
        parts = pc.split_pattern(pc.replace_substring(easy, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        entries = self._entries(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) >> 2
        data, starts = np.frombuffer(b"".join(entries), "<u4"), np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        counts = sizes[which]
        ends = np.cumsum(counts)
        ids = data[np.arange(ends[-1]) + np.repeat(starts[which] - ends + counts, counts)].tobytes()
        cuts = parts.offsets.to_numpy().astype(np.int64)
        cuts = 4 * np.concatenate(([0], ends))[cuts - cuts[0]]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Packer:
    """Open windows of one task; place() takes token pieces, closed windows come out as piece rows."""

    def __init__(self, size: int, open_windows: int, tolerance: int, first_id: int, keep_ids: bool):
        self.size, self.open_windows, self.tolerance, self.keep_ids = size, open_windows, tolerance, keep_ids
        self.windows: list[list] = []  # each: [used, pieces]
        self.next_id = first_id

    def _close(self, window: list, left_over: bool = False) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in window[1]:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, self.next_id, offset, int(left_over), ids if left_over or self.keep_ids else None
            offset += n
        self.next_id += 1

    def place(self, doc: int | None, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        size = self.size
        while len(ids) >= 4 * size:
            yield from self._close([size, [(doc, start, ids[: 4 * size], total)]])
            ids, start = ids[4 * size :], start + size
        while ids:
            n = len(ids) // 4
            fits = [w for w in self.windows if w[0] + n <= size]
            if fits or len(self.windows) < self.open_windows:
                if fits:
                    best = max(fits, key=lambda w: w[0])
                else:
                    self.windows.append(best := [0, []])
                best[1].append((doc, start, ids, total))
                best[0] += n
                if best[0] == size:
                    self.windows.remove(best)
                    yield from self._close(best)
                return
            fullest = max(self.windows, key=lambda w: w[0])
            if (gap := size - fullest[0]) > self.tolerance:
                fullest[1].append((doc, start, ids[: 4 * gap], total))
                ids, start = ids[4 * gap :], start + gap
            self.windows.remove(fullest)
            yield from self._close(fullest)

    def rest(self, left_over: bool) -> Iterator[tuple]:
        for window in self.windows:
            yield from self._close(window, left_over)
        self.windows = []


def _pack_documents(path: str, end: int, size: int, open_windows: int, tolerance: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("packing", tokenizer.cache_clear)
        packer = Packer(size, open_windows, tolerance, TaskContext.get().partitionId() << 36, keep_ids)
        close = np.array([end], "<u4").tobytes()

        def rows():
            for batch in batches:
                for part in by_bytes(batch, "text", _CHUNK):
                    encoded = tokenizer(path).encode(part.column("text"))
                    for doc, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                        yield from packer.place(doc, 0, ids + close, len(ids) // 4 + 1)
            yield from packer.rest(left_over=True)

        yield from in_batches(rows(), arrow_schema(PIECE_DDL), 4000)

    return run


def _pack_left_over(merge: int, level: int, last: bool, size: int, open_windows: int, tolerance: int, keep_ids: bool):
    """The open windows of `merge` tasks, sorted by group, packed as pieces; documents stay in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            group, packer = None, None
            for batch in batches:
                names = ("doc_id", "start", "ids", "doc_tokens", "group")
                for doc, start, ids, total, g in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    if g != group:
                        if packer:
                            yield from packer.rest(not last)
                        group, packer = g, Packer(size, open_windows, tolerance, (level << 58) + (g << 36), keep_ids)
                    yield from packer.place(doc, start, ids, total)
            if packer:
                yield from packer.rest(not last)

        yield from in_batches(rows(), arrow_schema(PIECE_DDL), 4000)

    return run


def pack(spark: SparkSession, docs: DataFrame, path: str, size: int = 4096, end: int = 2, open_windows: int = 16, tolerance: int = 16, merge: int = 64, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if kept."""
    if size < 1 or open_windows < 1 or merge < 2:
        raise ValueError("size and open_windows are at least 1, merge at least 2")
    parts = docs.select("doc_id", "text")
    tasks = parts.rdd.getNumPartitions()
    state = saved(parts.mapInArrow(_pack_documents(path, end, size, open_windows, tolerance, keep_ids), PIECE_DDL), "pieces")
    done, level = state.filter("window = 0"), 1
    while True:
        groups = -(-tasks // merge)
        left = state.filter("window = 1").withColumn("group", F.shiftright(F.col("sequence_id").bitwiseAND((1 << 58) - 1), 36) % groups)
        left = left.repartition(groups, "group").sortWithinPartitions("group", "doc_tokens", "doc_id", "start", ascending=[True, False, True, True])
        packed = left.mapInArrow(_pack_left_over(merge, level, groups == 1, size, open_windows, tolerance, keep_ids), PIECE_DDL)
        if groups == 1:
            return done.unionByName(packed).drop("window", *[] if keep_ids else ["ids"])
        state = saved(packed, "pieces")
        done, tasks, level = done.unionByName(state.filter("window = 0")), groups, level + 1
