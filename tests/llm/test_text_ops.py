"""Toxicity, line dedup, near dedup, decontamination, fingerprints, packing: against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import decontaminate as dc
from tallyforge.llm import fingerprint as fp
from tallyforge.llm import line_dedup as ld
from tallyforge.llm import near_dedup as nd
from tallyforge.llm import packing as pk
from tallyforge.llm import toxicity as tx

DDL = "doc_id bigint, text string, h1 string, salt string, n string"
LONG = "lorem ipsum dolor " * 20_000


def frame(spark, texts, first=0):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(first + i, t, "x", "y", "z") for i, t in enumerate(texts)], DDL)


# Line dedup


def kept_lines(texts, least):
    docs = [(t or "").split("\n") for t in texts]
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    counts = Counter(k for d in docs for k in {key(x) for x in d} if k)
    return ["\n".join(x for x in d if counts[key(x)] < least) for d in docs]


@pytest.mark.parametrize("options", [{}, {"broadcast_keys": 0, "salts": 3}, {"fanout": 2}])
def test_lines(spark, options):
    rng = random.Random(3)
    pool = ["Footer ", "\tfooter", "É", "é", "", " ", "a\rb", "x" * 5000, *map(str, range(8))]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 7))) for _ in range(120)] + [None, "", "\n\n", LONG]
    got = {r.doc_id: r for r in ld.dedupe_lines(spark, frame(spark, texts), min_docs=10, **options).collect()}
    for i, expected in enumerate(kept_lines(texts, 10)):
        assert (got[i].kept, got[i].kept_sha256) == (expected, hashlib.sha256(expected.encode()).hexdigest())
        assert got[i].n_lines - got[i].n_dropped == (0 if got[i].n_lines == got[i].n_dropped else expected.count("\n") + 1)


def test_lines_edges(spark):
    assert ld.dedupe_lines(spark, frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a\nb")], "doc_id bigint, text string")
    for options in ({}, {"broadcast_keys": 0}):
        got = ld.dedupe_lines(spark, rows, min_docs=3, **options).collect()
        assert sorted((str(r.doc_id), r.kept, r.n_dropped) for r in got) == [("1", "", 1), ("1", "b", 1), ("None", "", 1)]


def test_runs_compact_and_settle(spark):
    runs = ld.LineRuns(spark, min_docs=8, fanout=2)
    batch = lambda n: spark.createDataFrame([(1, 2, n), (1, 5, 1), *((k, k, 1) for k in range(10, 400, 7))], "h1 bigint, h2 bigint, n bigint")
    for n in (3, 4, 1, 0, 5):
        runs.add(batch(n))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(r.h1, r.h2) for r in runs.frequent().collect()} == {(1, 2)}
    for run in (r for level in runs.levels for r in level):
        for part in run.rdd.map(lambda r: (r.h1, r.h2)).glom().collect():
            assert part == sorted(part)
    # What the runs know as frequent is taken out of a later batch by a merge join, before it adds its own run.
    later = runs.unsettled(batch(1))
    assert "SortMergeJoin" in (plan := later._jdf.queryExecution().executedPlan().toString()) and "LeftAnti" in plan
    assert (1, 2) not in {(r.h1, r.h2) for r in later.collect()} and later.count() == 57
    runs.add(batch(2))
    assert (1, 5) not in {(r.h1, r.h2) for r in runs.frequent().collect()}
    runs.add(batch(2))
    runs.add(batch(2))
    assert {(r.h1, r.h2) for r in runs.frequent().collect()} == {(1, 2), (1, 5), *((k, k) for k in range(10, 400, 7))}


# Near dedup


def sets_of(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def components_of(texts, width=2, percent=80):
    sets = [sets_of(t, width) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_texts(rng):
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice((3, 12, 60, 200)))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 9))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return [*texts, *texts[:5], texts[0].upper(), None, "", " \n", "one", "One", "é É", LONG, LONG + "x"]


@pytest.mark.parametrize("options", [{}, {"block_rows": 3, "salts": 2}, {"width": 5}])
def test_near(spark, options):
    texts = near_texts(random.Random(5))
    rows = nd.near_duplicates(spark, frame(spark, texts), **options).collect()
    components, sizes = components_of(texts, options.get("width", 2))
    got = {r.doc_id: r for r in rows}
    assert [got[i].component_id for i in range(len(texts))] == components
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (components[i] == i) for i in range(len(texts)))


def test_near_buckets_of_several_components(spark):
    """Few wide bands put documents together that the bucket's smallest member doesn't link."""
    rng, words = random.Random(3), [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randint(4, 16)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    components, _ = components_of(texts)
    assert 1 < len(set(components)) < 40
    for options in ({"bands": 64, "rows": 1}, {"bands": 64, "rows": 1, "block_rows": 4}, {"bands": 64, "rows": 1, "block_rows": 8, "together": 2}):
        got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark, frame(spark, texts), least=0.4, **options).collect()}
        assert [got[i] for i in range(40)] == components


def test_components_raise_when_not_settled(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    with pytest.raises(RuntimeError, match="settled"):
        nd.components(links, rounds=1)


def test_near_edges(spark):
    assert nd.near_duplicates(spark, frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "x y z"), (3, "a B c"), (4, "x y z")], "doc_id bigint, text string")
    got = nd.near_duplicates(spark, rows).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("4", "4"), ("7", "3"), ("7", "4"), ("None", "3")]
    assert {str(r.doc_id): r.kept for r in got}["None"] is False


def test_chain_of_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 1)], "a bigint, b bigint")
    got = {r.node: r.component for r in nd.components(links).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 2: 1}


def test_components_plan_one_join_at_a_time(spark, monkeypatch):
    """The driver holds the plans of all queries of a session, so a round is written out in short steps."""
    joins, write = [], nd.saved

    def counted(df, tag, *more):
        joins.append(len(re.findall(r"\bJoin \w+", df._jdf.queryExecution().optimizedPlan().toString())))
        return write(df, tag, *more)

    monkeypatch.setattr(nd, "saved", counted)
    rng = random.Random(5)
    pairs = [(a, rng.randrange(a)) for a in range(1, 40) if a % 7] + [(9, 8), (8, 9), (3, 3), (50, 51), (52, 51)]
    least = {i: i for p in pairs for i in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.component for r in nd.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: c for i, c in least.items() if i != c}
    assert max(joins) == 1
    joins.clear()
    stars = spark.createDataFrame([(1, i) for i in range(2, 9)], "a bigint, b bigint")
    assert nd.components(stars).count() == 7 and joins == [0]  # stars need no round


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        s = nd.sketch(a, 512)
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (s == nd.sketch(a, 512)).all()
    base = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for shared in (500, 1500, 2700):
        a, b = base[:3000], np.concatenate([base[3000 - shared :], rng.integers(0, 1 << 63, 3000 - shared).astype(np.uint64)])
        exact = shared / (6000 - shared)
        assert abs((nd.sketch(np.sort(a), 512) == nd.sketch(np.sort(b), 512)).mean() - exact) < 0.1


# Decontamination


def hits_of(text, items, size):
    words = dc.words_of(text)
    hit, found = [False] * len(words), set()
    for item, body in items:
        w = dc.words_of(body)
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            for i in range(len(words) - m + 1):
                if words[i : i + m] == w[k : k + m]:
                    found.add(item)
                    hit[i : i + m] = [True] * m
    return len(words), sum(hit), sorted(found)


@pytest.mark.parametrize("block_chars", [2_000_000, 60])
def test_decontamination(spark, block_chars):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("aA b,b c é d1".split()) for _ in range(n))
    items = [(i, say(rng.choice((1, 3, 4, 7, 12)))) for i in range(12)] + [(50, None), (51, "?!"), (3, "zz yy xx ww"), (None, "q")]
    texts = [say(rng.randint(0, 60)) for _ in range(60)] + [None, "", "...", "ZZ-yy xx\nww", LONG]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in dc.decontaminate(spark, frame(spark, texts), bench, size=4, block_chars=block_chars).collect()}
    known = [(i, t) for i, t in items if i is not None]
    for i, text in enumerate(texts):
        n, hit, found = hits_of(text, known, 4) if len(text or "") < 10_000 else (60_000, 0, [])
        assert (got[i].n_words, got[i].n_hit, got[i].items) == (n, hit, found)
        assert got[i].contaminated == (hit > 0) and got[i].items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_decontamination_empty(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.contaminated for r in dc.decontaminate(spark, frame(spark, ["a b"]), bench).collect()] == [False]
    assert dc.decontaminate(spark, frame(spark, []), bench).count() == 0


# Fingerprints


def slow_syncmers(data, k, s):
    """By definition, with the operator's hash of inner strings."""
    def h(x):
        return int(fp._mix(np.array([int.from_bytes(x.ljust(8, b"\0"), "little")], np.uint64))[0])

    for i in range(len(data) - k + 1):
        inner = [h(data[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            yield i


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=0, max_size=120))
def test_syncmers_by_definition(text):
    for k, s in ((20, 4), (12, 4), (16, 8), (8, 4), (24, 5)):
        assert fp.syncmers(text.encode(), k, s)[0].tolist() == list(slow_syncmers(text.encode(), k, s))


def test_fingerprints(spark):
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = [say(rng.choice((0, 1, 5, 50, 500, 4000))) for _ in range(90)] + [None, "", LONG]
    texts[7] = texts[8] = say(900)
    for per_range in (1000, 10):
        rows = {r.doc_id: r for r in fp.fingerprints(spark, frame(spark, texts, first=100), per_range=per_range).collect()}
        assert len(rows) == len(texts)
        for i, text in enumerate(texts):
            row, text, following = rows[100 + i], text or "", texts[i - 1] or ""
            changed = fp.edited(text, following)
            assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
            a, b, c = (fp.anchors(x) for x in (text, changed, following))
            assert (row.fingerprint, row.edited_fingerprint, row.near_edited, row.near_next) == (fp.encode(a), fp.encode(b), fp.likeness(a, b), fp.likeness(a, c))
        assert rows[107].fingerprint == rows[108].fingerprint and rows[108].near_next == 1.0
        long = [r for r in rows.values() if r.n_chars >= 500 and r.doc_id not in (108, 192)]
        assert min(r.near_edited for r in long) > max(r.near_next for r in long)


def test_fingerprints_keep_a_passage_of_long_texts():
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = say(300)
    long, other = (fp.anchors(f"{say(30_000)}{passage}{say(90_000)}") for _ in range(2))
    own = set((fp.syncmers(passage.encode())[1] >> np.uint64(24)).tolist())
    assert len(own) > 20 and own <= set(long[0].tolist()) & set(other[0].tolist())
    assert fp.likeness(long, other) > 0
    assert 2 * len(fp.encode(long)) < 2.5 * 120_000  # both fingerprints, in characters a byte of text


def slow_anchors(text):
    """By definition, with integers: hash and first position of each closed syncmer of the padded text."""
    word = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & word
        return ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & word

    data, found = b"\0" * 16 + text.encode() + b"\0" * 16, {}
    for at in slow_syncmers(data, 20, 4):
        a, b, c = (int.from_bytes(data[at + k : at + k + 8], "little") for k in (0, 6, 12))
        found.setdefault(mix(mix(mix(a) ^ b) ^ c) >> 24, at)
    return found


@settings(max_examples=80, deadline=None)
@given(st.text("ab cdé数", max_size=300), st.text("ab cdé数", max_size=300))
def test_fingerprints_by_definition(one, two):
    found = {x: slow_anchors(x) for x in (one, two) if x}
    for x, slow in found.items():
        if slow:
            hashes, positions = fp.decode(fp.encode(fp.anchors(x)))
            assert dict(zip(hashes.tolist(), positions.tolist(), strict=True)) == slow
    if len(found) == 2 and all(found.values()):
        a, b = found[one], found[two]
        slack = 64 + max(*a.values(), *b.values()) // 4
        alike = sum(h in b and abs(a[h] - b[h]) <= slack for h in a)
        assert fp.likeness(fp.anchors(one), fp.anchors(two)) == 2 * alike / (len(a) + len(b))
    assert fp.decode(fp.encode(fp.anchors("")))[0].tolist() == []


def test_likeness_has_no_jump_between_lengths():
    rng = random.Random(6)
    words = "the quick brown fox jumps over a lazy dog while many small birds sing near old river banks".split()
    for n in range(24, 220, 4):
        found = []
        for _ in range(20):
            text, other = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(2))
            found.append(fp.likeness(fp.anchors(text[:n]), fp.anchors(text[: n - n // 3])))  # as if the next text were empty
            found.append(fp.likeness(fp.anchors(text[:n]), fp.anchors(fp.edited(text[:n], other))))
        assert 0.3 < sum(found) / len(found) < 0.95, n


def test_fingerprint_edges(spark):
    assert fp.fingerprints(spark, frame(spark, [])).count() == 0
    assert fp.fingerprints(spark, frame(spark, ["only one text here, long enough for anchors"])).first().near_next == 1.0
    rows = spark.createDataFrame([(5, "b"), (5, "a"), (None, "z"), (1, "c")], "doc_id bigint, text string")
    assert fp.fingerprints(spark, rows, per_range=1).count() == 4


# Packing


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aBéÉΣςİ ,.'s\n\t\r!1ﬁẞ中<|>́"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_word_tokenizer_is_exact(text):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    whole = test_word_tokenizer_is_exact.__dict__.get("whole") or Tokenizer.from_file(path)
    test_word_tokenizer_is_exact.__dict__["whole"] = whole
    for t in (text, f"{text} <|endoftext|>x {text}, İ.", f"{text}<|STARTOFTEXT|>{text}.,!?É:{text}"):
        assert np.frombuffer(pk.tokenizer(path).encode(pa.array([t]))[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("options", [{}, {"merge": 2, "open_windows": 2}, {"merge": 2, "tolerance": 0}])
def test_packing(spark, vocabulary, options):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = [" ".join(rng.choice(("alpha", "beta,", "Gamma.", "12")) for _ in range(rng.choice((0, 3, 40, 400)))) for _ in range(150)] + [None, "", LONG]
    docs = frame(spark, texts).repartition(5)
    rows = pk.pack(spark, docs, vocabulary, size=256, keep_ids=True, **options).collect()
    whole = Tokenizer.from_file(vocabulary)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length > 0
    for i, text in enumerate(texts):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist() == ids
        assert [p.start for p in pieces] == list(np.cumsum([0, *[p.length for p in pieces[:-1]]])) and {p.doc_tokens for p in pieces} == {len(ids)}
    used = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0, *[p.length for p in pieces[:-1]]]))
        assert sum(p.length for p in pieces) <= 256
        used += sum(p.length for p in pieces)
    assert used / (256 * len(by_sequence)) > 0.9
    plain = pk.pack(spark, docs, vocabulary, size=256, **options)
    assert "ids" not in plain.columns


def test_packing_empty(spark, vocabulary):
    assert pk.pack(spark, frame(spark, []), vocabulary).count() == 0


def test_packing_repeated_and_null_ids(spark, vocabulary):
    """Rows that share an id, or have none, are packed as rows of their own; columns that clash are not read."""
    rows = [(1, "alpha beta", "x"), (1, "alpha beta", "y"), (1, "gamma", "z"), (None, "alpha", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sequence_id string")
    got = pk.pack(spark, docs, vocabulary, size=64).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "None", "None"] and len({(r.sequence_id, r.offset) for r in got}) == 5
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got)


# Toxicity


def toxic_tables(spark, n=500):
    rng = random.Random(8)
    plain = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "ter") for b in ("na", "ri", "su") for c in ("", "te", "no", "ka")]
    bad = [f"zvuq{c}" for c in ("", "te", "no", "ka", "xi", "pa", "ro")]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        for _ in range(max(1, len(words) // 20) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (n, None, "x"), (n + 1, "", "x"), (n + 2, "?!", "x"), (None, "zvuqte", "x")], "doc_id bigint, text string, toxic string")
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), dict(labels)


def test_toxicity_held_out(spark):
    docs, labels, truth = toxic_tables(spark)
    rows = tx.score(spark, docs, tx.fit(spark, docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert len(held) > 50 and right / len(held) > 0.95


def test_toxicity_never_reads_held_out_labels(spark):
    docs, labels, truth = toxic_tables(spark, 200)
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in truth.items()], "doc_id bigint, toxic int")
    a, b = ({r.doc_id: r.score for r in tx.score(spark, docs, tx.fit(spark, docs, x)).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels(spark):
    docs, labels, _ = toxic_tables(spark, 50)
    for some in (labels.filter("false"), labels.filter("toxic = 0")):
        assert {r.predicted for r in tx.score(spark, docs, tx.fit(spark, docs, some)).collect()} == {0}
    assert tx.score(spark, docs.filter("false"), tx.fit(spark, docs, labels)).count() == 0


def test_toxicity_fit_makes_no_string_a_gram(spark):
    rng = random.Random(2)
    texts = [(i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(400))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    tracemalloc.start()
    try:
        pair = tx.fit(spark, docs, labels).pair
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(pair.grams) > 60_000
    assert peak < 230 * len(pair.grams)


def test_toxicity_keeps_every_gram(spark):
    rng = random.Random(9)
    rare = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéя") for _ in range(9)) for _ in range(200_000)]
    texts = {i: " ".join(rare[i * 25_000 : (i + 1) * 25_000]) for i in range(8)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    model = tx.fit(spark, docs, spark.createDataFrame([(i, i % 2) for i in texts], "doc_id bigint, toxic int"))
    learnt = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 > 1]
    grams = {g for t in learnt for w in tx.words_of(t) for g in tx._grams(w, 8)}
    assert len(model.pair.grams) == len(grams)


def slow_kneser_ney(counts, order):
    """Log-likelihood ratio of a word from two interpolated Kneser-Ney models, by definition."""
    endings = {g[k:] for c in counts for g in c for k in range(len(g))}

    def shared(gram):  # over continuation counts: different characters before a string
        before = lambda x: len({e for e in endings if len(e) == len(x) + 1 and e[1:] == x})
        below = shared(gram[1:]) if len(gram) > 1 else 1e-4
        next_ = {e[-1] for e in endings if len(e) == len(gram) and e[:-1] == gram[:-1] and before(e)}
        total = sum(before(gram[:-1] + c) for c in next_)
        return (max(before(gram) - 0.75, 0) + 0.75 * len(next_) * below) / total if total else below

    def chance(c, gram):
        ones, twos = (sum(n == k for n in c.values()) for k in (1, 2))
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        after = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        base = shared(gram[1:])
        return (max(c.get(gram, 0) - d, 0) + d * len(after) * base) / sum(after.values()) if after else base

    return lambda word: sum(np.log(chance(counts[1], g) / chance(counts[0], g)) for g in tx._grams(word, order))


def pair_of(counts, order):
    grams = sorted(counts[0].keys() | counts[1].keys())
    return tx.KneserNeyPair(grams, np.array([[c.get(g, 0) for g in grams] for c in counts]), order)


@pytest.mark.parametrize("order", [2, 3, 5])
def test_kneser_ney_by_definition(order):
    rng = random.Random(order)
    say = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    for _ in range(6):
        counts = tuple(dict(Counter(g for _ in range(rng.choice((0, 3, 25))) for g in tx._grams(say(), order))) for _ in range(2))
        words = [say() for _ in range(12)]
        slow = slow_kneser_ney(counts, order)
        assert pair_of(counts, order).words(words) == pytest.approx([slow(w) for w in words], abs=1e-4)


def test_kneser_ney_prefers_the_class_of_a_word():
    words = ["banana", "bandana", "cabana", "zvuq"]
    counts = tuple(dict(Counter(g for w in part for g in tx._grams(w, 4))) for part in (words[:3], words[3:]))
    toxic, plain = pair_of(counts, 4).words(["zvuq", "banana"])
    assert toxic > 2 > 0 > plain


def test_toxicity_long_repeated_and_twice_labelled(spark):
    docs, labels, _ = toxic_tables(spark, 200)
    long = spark.createDataFrame([(900, "bana " * 300_000, "x"), (901, "bana " * 300_000 + "zvuqte zvuqno " * 60_000, "x"), (900, "bana " * 300_000, "x")], "doc_id bigint, text string, toxic string")
    twice = labels.unionByName(labels.filter("doc_id = 7")).unionByName(spark.createDataFrame([(8, 1)], "doc_id bigint, toxic int"))
    rows = tx.score(spark, docs.unionByName(long), tx.fit(spark, docs, twice)).collect()
    got = [(r.doc_id, r.predicted) for r in rows if r.doc_id in (900, 901)]
    assert sorted(got) == [(900, 0), (900, 0), (901, 1)]
