"""Binary token files, ranked search, Merkle manifest: against brute force."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import merkle as mk
from tallyforge.llm import queries
from tallyforge.llm import ranked_search as rs
from tallyforge.llm import token_files as tf

DDL = "doc_id bigint, source string, lang string, n_chars bigint, text string, grp string, pos string, n string"


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def climb(level):
    """Levels of a tree of runs of three, from its leaves to its one root."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        yield run[: at % 3], run[at % 3 + 1 :]
        at //= 3


def merkle_by_hand(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = climb([leaf(r) for r in groups[name]])
    top = climb([trees[name][-1][0] for name in names])
    for k, name in enumerate(names):
        for at, row in enumerate(groups[name]):
            proof = [*siblings(trees[name], at), *siblings(top, k)]
            tampered = list(row)
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                tampered[4] = row[4].replace("\n", "")
            now = leaf(tampered)
            for left, right in proof:
                now = sha(*left, now, *right)
            yield row[0], leaf(row), trees[name][-1][0], top[-1][0], sha(*(x for left, right in proof for x in [*left, *right])), now, now == top[-1][0]


def merkle_of(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DDL)
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return [tuple(r) for r in mk.manifest(spark, mk.leaves(docs, {"text": text})).drop("path").collect()]


def some_rows(n, names, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(names), rng.choice(["en", None]), rng.choice([None, i, 3]), rng.choice([None, "", "é\nß", "a\n\nb", f"plain {i}", "x" * 70_000 if i % 97 == 0 else "\n"])) for i in range(n)]


@pytest.mark.parametrize("n, names", [(0, ["a"]), (1, ["a"]), (1, [None]), (3, ["a"]), (4, ["a", "b"]), (60, ["a", "ä", None, "", "Z"]), (400, [f"s{k}" for k in range(90)])])
def test_manifest(spark, n, names):
    rows = some_rows(n, names, n)
    rows += [(None, names[0], None, None, None), (5, names[0], "de", 1, "twice"), (5, names[0], "de", 1, "twice"), (5, names[0], "de", 1, "else\n")] if n > 5 else []
    assert sorted(merkle_of(spark, rows), key=str) == sorted(merkle_by_hand(rows), key=str)


def test_manifest_of_several_stages(spark, monkeypatch):
    """Blocks of nine leaves, so that groups need one to four stages."""
    monkeypatch.setattr(mk, "BLOCK", 9)
    monkeypatch.setattr(mk, "_WIDTHS", "filter(array(1, 3), w -> w < n)")
    rows = some_rows(1200, ["hot"] * 800 + [f"s{k}" for k in range(40)], 7)
    assert sorted(merkle_of(spark, rows), key=str) == sorted(merkle_by_hand(rows), key=str)


def test_manifest_at_block_borders(spark):
    rows = [(i, f"s{n}", "en", i, f"t\n{i}") for n in (mk.BLOCK - 1, mk.BLOCK, mk.BLOCK + 1) for i in range(n)]
    assert sorted(merkle_of(spark, rows), key=str) == sorted(merkle_by_hand(rows), key=str)


# Token files

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def huffman_total(counts):
    """Bits of all symbols under an unlimited Huffman code."""
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=2, max_size=60))
def test_code_lengths(counts):
    free = tf.code_lengths(np.array(counts), 60)
    assert int((free * counts).sum()) == huffman_total(counts)
    held = tf.code_lengths(np.array(counts), 6)
    assert held.max() <= 6 and sum(2.0**-b for b in held) == 1.0
    assert (held * counts).sum() >= (free * counts).sum()


def test_limited_lengths_are_the_best():
    """Against all lengths that the Kraft sum allows."""
    from itertools import product

    rng = random.Random(4)
    for _ in range(20):
        counts = [rng.choice([1, 2, 3, 50, 400]) for _ in range(6)]
        best = min(sum(c * b for c, b in zip(counts, bits)) for bits in product(range(1, 5), repeat=6) if sum(2.0**-b for b in bits) <= 1)
        assert int((tf.code_lengths(np.array(counts), 4) * counts).sum()) == best
    with pytest.raises(ValueError):
        tf.code_lengths(np.ones(17), 4)


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 512, 70_001])
def test_codec_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 40_000).astype("<u4") * 7
    seen, counts = np.unique(ids, return_counts=True)
    codec = tf.Codec(seen.astype(np.int64), tf.code_lengths(counts))
    data, marks = codec.encode(ids)
    # Bit by bit, from the codes alone.
    by_code = {(int(codec.bits[i]), int(codec.codes[i])): int(i) for i in seen}
    bits, at, got = "".join(f"{b:08b}" for b in data), 0, []
    for k in range(min(n, 600)):
        assert k % tf.EVERY or marks[k // tf.EVERY] == at
        size = next(s for s in range(1, 26) if (s, int(bits[at : at + s], 2)) in by_code)
        got.append(by_code[size, int(bits[at : at + size], 2)])
        at += size
    assert got == ids[:600].tolist()
    assert np.array_equal(codec.decode(data, marks, n), ids)
    if n > 600:
        assert np.array_equal(codec.decode(data, marks, n, slice(1, 3)), ids[tf.EVERY : 3 * tf.EVERY])
        with pytest.raises(ValueError):
            codec.decode(bytes(len(data)), marks, n)


def ids_by_hand(texts):
    from tokenizers import Tokenizer

    return [[*e.ids, 2] for e in Tokenizer.from_file(VOCABULARY).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files(spark, tmp_path):
    rng = random.Random(8)
    words = ["the", "Cat", "#", "ünïcode", "naïve!", "123", "<|endoftext|>", "\n", "数", "x" * 40]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "same", "same", "lorem # ipsum " * 60_000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    folder = f"file://{tmp_path}/tokens"
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id bigint, text string, ids string, row string, part int").repartition(5)
    tf.write_tokens(spark, docs, folder, VOCABULARY)
    expected = ids_by_hand(texts)
    got = {r.doc_id: r for r in tf.read_tokens(spark, folder).collect()}
    at = 0
    for i, ids in enumerate(expected):
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    everything = [i for ids in expected for i in ids]
    for start, count in [(0, 1), (5, 700), (at - 3, 10), (1000, 150_000), (at, 5), (7, 0)]:
        pieces = sorted((r.start, bytes(r.ids)) for r in tf.read_slice(spark, folder, start, count).collect())
        assert b"".join(p for _, p in pieces) == np.array(everything[start : start + count], "<u4").tobytes()
        assert not pieces or pieces[0][0] == start


def test_token_files_edges(spark, tmp_path):
    for k, (rows, expected) in enumerate([
        ([], []),
        ([(1, None), (2, "")], [(1, 0, [2]), (2, 1, [2])]),
        ([(None, "a"), (3, "a"), (3, "a"), (3, "b")], None),
    ]):
        tf.write_tokens(spark, spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), f"file://{tmp_path}/{k}", VOCABULARY)
        got = [(r.doc_id, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in tf.read_tokens(spark, f"file://{tmp_path}/{k}").orderBy("start").collect()]
        if expected is None:
            ids = ids_by_hand([t for _, t in rows])
            expected = [(rows[i][0], sum(map(len, ids[:i])), ids[i]) for i in range(len(rows))]
        assert got == expected


def test_op11_query(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    at, expected = 0, []
    for row, ids in zip(docs, ids_by_hand([r.text for r in docs]), strict=True):
        expected.append((row.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op11_token_files(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == expected


# Ranked search

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked_by_hand(docs, items, k):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    weigh = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 25 + 25 * c.total() * n_docs // n_terms
            score = sum(weigh[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1):
            yield item, rank, i, -score


def ranked(spark, tmp_path, docs, items, k, name):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, terms string, row int").repartition(3)
    rs.build_index(spark, frame, f"file://{tmp_path}/{name}")
    asked = spark.createDataFrame([(i, t, 0, 0) for i, t in items], "item_id string, text string, row int, score int")
    return rs.search(spark, f"file://{tmp_path}/{name}", asked, k)


@pytest.mark.parametrize("shard, shard_docs", [(16 << 20, 1 << 16), (2000, 1 << 16), (16 << 20, 7)])
def test_ranked_search(spark, tmp_path, monkeypatch, shard, shard_docs):
    rng = random.Random(shard)
    words = [f"w{k}" for k in range(120)] + ["É", "é", "Ab", "aB", "1a", "数", "x" * 300]
    common = [1 / (k + 1) for k in range(len(words))]
    docs = [(i, rng.choice(["", "  "]) + rng.choice([" ", "\t", "-"]).join(rng.choices(words, common, k=rng.randint(0, 40)))) for i in range(500)]
    docs += [(1000 + i, "copy w3 w50 w90 w90") for i in range(80)] + [(1, "w3 w7"), (1, "w3 w7"), (None, "w3 w7"), (None, None), (2000, ""), (2001, "--- "), (2002, "w1 w2 w99 " * 30_000)]
    items = [(f"i{k}", " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(40)] + [("copies", "w90 copy w50 w90"), ("ties", "w3 W7!"), (None, "w5"), ("null", None), ("none", "absent"), ("empty", ""), ("signs", "---")]
    # Tasks get these through the closures of the driver.
    monkeypatch.setattr(rs, "_sharded", with_sizes(rs._sharded, shard, shard_docs))
    for k in (1, 20):
        expected = list(ranked_by_hand(docs, items, k))
        assert sorted(map(tuple, ranked(spark, tmp_path, docs, items, k, k).collect()), key=str) == sorted(expected, key=str)


def with_sizes(make, shard, shard_docs):
    def made(*totals):
        run = make(*totals)

        def sized(batches):
            from tallyforge.llm import ranked_search

            kept = ranked_search.SHARD, ranked_search.SHARD_DOCS
            ranked_search.SHARD, ranked_search.SHARD_DOCS = shard, shard_docs
            try:
                yield from run(batches)
            finally:
                ranked_search.SHARD, ranked_search.SHARD_DOCS = kept

        return sized

    return made


def test_ranked_search_edges(spark, tmp_path, monkeypatch):
    assert ranked(spark, tmp_path, [], [("a", "b")], 20, "none").count() == 0
    assert ranked(spark, tmp_path, [(1, "b")], [], 20, "no-items").count() == 0
    assert ranked(spark, tmp_path, [(1, None), (2, "?")], [("a", "b")], 20, "no-terms").count() == 0
    docs, items = [(1, "a b"), (2, "b c"), (3, "c d d")], [("x", "b d"), ("x", "b d"), ("y", "c")]
    expected = list(ranked_by_hand(docs, items, 2))
    assert sorted(map(tuple, ranked(spark, tmp_path, docs, items, 2, "one").collect())) == sorted(expected)
    monkeypatch.setattr(rs, "BLOCK", 2)
    assert sorted(map(tuple, ranked(spark, tmp_path, docs, items, 2, "blocks").collect())) == sorted(expected)


def test_terms_of_slices():
    texts = pa.array(["drop", "a b", None, "", "-c", "d-", "É é"])[1:]
    assert rs.term_counts(texts).tolist() == [2, 0, 0, 1, 1, 2]
    assert [[t for t in x if t] for x in rs.term_lists(texts).to_pylist()] == [["a", "b"], [], [], ["c"], ["d"], ["É", "é"]]
