"""MinHash near-dedup with fast similarity sketches.

A document's set is its distinct 2-word shingles as 64-bit hashes. The sketch throws every element
into one of t bins in each of up to t rounds (round i beats round i+1, lower hashes beat higher ones)
and stops once all bins are filled; the t rounds after those visit each bin in turn, so every
coordinate fills for any non-empty set. Equal coordinates estimate Jaccard similarity with the
concentration of independent samples, at a cost of |set| + t log t. Sketches are cut into `bands` of
`rows`; documents that agree on a band are candidates, and candidates are confirmed on full sets.

How buckets are handled without pairing all their members: equal sets are one class with one
representative. In a bucket each member is compared with the bucket's smallest member; links make
components. Only buckets that then hold several components are looked at again (those of a small group
of candidates together): the members outside the largest component meet all others in blocks of sketches. Members with a partner of another
component, of fitting size and with an estimated similarity of at least `least`, stay in their block;
only their texts move, and the blocks' pairs are confirmed on full sets, giving links. Pairs inside one
component can change nothing and are skipped. With 512 coordinates the estimate of a pair at 0.8 falls
below 0.7 with a probability of about 1e-8, so that bound costs less than the bands themselves.
A small group is looked at as a whole, so there also pairs meet that share no band; in a larger one only pairs of
a bucket do. So a pair at exactly 0.8 is missed with a probability of up to 8e-6 in a large group, and of less in a small one.

Defined results: texts without words (null and empty ones too) have no shingles and stand alone; a
one-word text is one shingle; each row takes the component of its own text, also where rows repeat a
doc_id; a null doc_id represents nothing: such a row is kept if no other document has its set; an
empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_schema, drop_saved, in_batches, remembers, saved, sliced

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Words whose hash a worker remembers.
_WORDS = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def shingles(text: str | None, width: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of `width` words (or of the whole if shorter)."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > _WORDS:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    m = min(width, len(h))
    s = np.full(len(h) - m + 1, m, np.uint64)
    for k in range(m):
        s = _mix(s * _A + h[k : len(h) - m + 1 + k])
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def sketch(elements: np.ndarray, t: int = 512) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: t values, (round << 48) + hash; t is a power of two."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(t, full)
    down, low, n, i = np.uint64(64 - t.bit_length() + 1), np.uint64((1 << 48) - 1), len(elements), 0
    while i < t:
        rounds = min(t - i, max(1, 4 * t // n))
        seeds = np.arange(i, i + rounds, dtype=np.uint64)
        h = _mix(elements[None, :] + _mix(seeds * _A + _A)[:, None])
        value = (h & low) | (seeds << np.uint64(48))[:, None]
        np.minimum.at(out, (h >> down).astype(np.int64).ravel(), value.ravel())
        i += rounds
        if not (out == full).any():
            return out
    for b in np.flatnonzero(out == full):  # the rounds that visit each bin in turn
        h = _mix(elements + _mix(np.array([t + int(b)], np.uint64) * _A + _A))
        out[b] = (h & low).min() | (np.uint64((t + int(b)) << 48))
    return out


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union|, on sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


_SIGN_DDL = "doc_id bigint, fp string, n_shingles bigint, bands array<bigint>, small binary"


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_SIGN_DDL)
        remembers("near_dedup", _hashes.clear)
        tags = _mix(np.arange(bands, dtype=np.uint64) * _A + _B)

        def sign(doc, text):
            found = shingles(text, width)
            if not len(found):
                return doc, None, 0, [], b""
            s = sketch(found, bands * rows)
            keys = tags
            for column in s.reshape(bands, rows).T:
                keys = _mix(keys * _A + column)
            return doc, hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest(), len(found), keys.view(np.int64), (s & np.uint64(0xFF)).astype(np.uint8).tobytes()

        for part in sliced(batches):
            yield from in_batches((sign(*x) for x in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)), schema, 500)

    return run


def _confirm(width: int, percent: int):
    """Rows sorted by (hub, salt, the hub's own row first): links of the hub to members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            remembers("near_dedup", _hashes.clear)
            at, bases = None, []
            for part in sliced(batches):
                for hub, salt, member, text in zip(*(part.column(c).to_pylist() for c in ("a", "salt", "b", "text")), strict=True):
                    found = shingles(text, width)
                    if (hub, salt) != at:
                        at, bases = (hub, salt), []
                    if hub == member:
                        bases.append(found)
                    elif any(_similar(base, found, percent) for base in bases):
                        yield hub, member

        yield from in_batches(rows(), arrow_schema("a bigint, b bigint"), 10_000)

    return run


def _texts(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """docs whose doc_id is among ids (a table), roughly: up to `most` ids (8 bytes each) are sent to the
    tasks so that other texts don't move; beyond it all pass and the join that follows does the work."""
    if ids.count() > most:
        return docs
    wanted = np.sort(ids.toArrow().column(0).to_numpy())
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value
        for batch in batches:
            column = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy()
            at = np.minimum(np.searchsorted(wanted, column), max(0, len(wanted) - 1))
            mask = (wanted[at] == column) if len(wanted) else np.zeros(len(column), bool)
            if mask.any():
                yield batch.filter(pa.array(mask))

    return docs.mapInArrow(run, docs.schema)


def _links(docs: DataFrame, pairs: DataFrame, width: int, percent: int, salts: int, most_ids: int) -> DataFrame:
    """The pairs (a, b) that full sets confirm. A hub's members are dealt over salts, its text with them."""
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int").alias("salt"))
    needed = salted.unionByName(salted.select("a", F.col("a").alias("b"), "salt").distinct())
    ids = saved(needed.select("b").distinct(), "ids")
    texts = _texts(docs, ids, most_ids).select(F.col("doc_id").alias("b"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = needed.join(texts, "b").repartition(parts, "a", "salt")
    dealt = dealt.sortWithinPartitions("a", "salt", F.col("a") != F.col("b"), "b")
    return dealt.select("a", "salt", "b", "text").mapInArrow(_confirm(width, percent), "a bigint, b bigint")


def _ends(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """A row (u, v) for each pair of columns of every row; rows stand once in the plan, unlike in a union."""
    pairs = F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends))
    return rows.select(F.explode(pairs).alias("end")).select("end.u", "end.v")


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v) are stars: every u has one v, and no v is a u."""
    roles = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("end"))
    nodes = roles.groupBy("end.node").agg(F.sum("end.up").alias("ups"), F.min("end.up").alias("least"))
    return nodes.filter("ups > 1 or ups = 1 and least = 0").limit(1).count() == 0


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every linked node, component being its smallest node.

    Rounds of large-star and small-star; hubs' neighbours are met in partial aggregates and, for the
    joins, by adaptive skew handling. Each half of a round is written out, so that its plan has one join
    and the driver holds short plans only; stars end the rounds. The rounds needed grow with the
    logarithm of a component's size; a state that hasn't settled after `rounds` raises.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(rounds):
        if _settled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = _ends(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = saved(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        met = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        after = saved(_ends(met, ("v", "m"), ("u", "m")).filter("u <> v").distinct(), "edges")
        drop_saved(edges, large)
        edges = after
    raise RuntimeError(f"the components have not settled after {rounds} rounds")


def _fits(rows: list[tuple], k: int, theirs: np.ndarray, signs: np.ndarray, sizes: np.ndarray, percent: int, least: float) -> np.ndarray:
    """Those of theirs whose size and sketch allow the similarity with row k, the likest first."""
    near = theirs[100 * np.minimum(sizes[theirs], sizes[k]) >= percent * np.maximum(sizes[theirs], sizes[k])]
    like = (signs[near] == signs[k]).mean(axis=1)
    return near[np.argsort(-like, kind="stable")[: np.count_nonzero(like >= least)]]


def _blocks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((bucket, i, j), rows) of sorted batches, rows without these three."""
    at, held = None, []
    for part in sliced(batches):
        for bucket, i, j, *row in zip(*(part.column(c).to_pylist() for c in ("bucket", "i", "j", *names)), strict=True):
            if (bucket, i, j) != at:
                if held:
                    yield at, held
                at, held = (bucket, i, j), []
            held.append(tuple(row))
    if held:
        yield at, held


def _sides(rows: list[tuple]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Positions of ours and theirs, sketches and sizes of the rows of a block."""
    ours = [k for k, r in enumerate(rows) if r[0]]
    theirs = np.array([k for k, r in enumerate(rows) if not r[0]], np.int64)
    signs = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
    return ours, theirs, signs, np.array([r[3] for r in rows], np.int64)


_BLOCK = ("ours", "doc_id", "comp", "n_shingles", "small")
_BLOCK_DDL = "bucket string, i int, j int, ours boolean, doc_id bigint, comp bigint, n_shingles bigint, small binary"


def _promising(percent: int, least: float):
    """Blocks of sketches (bucket, i, j): the rows that have a possible partner of another component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for at, held in _blocks(batches, _BLOCK):
                ours, theirs, signs, sizes = _sides(held)
                comps = np.array([r[2] for r in held], np.int64)
                some: set[int] = set()
                for k in ours:
                    found = _fits(held, k, theirs[comps[theirs] != comps[k]], signs, sizes, percent, least)
                    if len(found):
                        some.add(k)
                        some.update(found.tolist())
                for k in sorted(some):
                    yield *at, *held[k]

        yield from in_batches(rows(), arrow_schema(_BLOCK_DDL), 5000)

    return run


def _cross(width: int, percent: int, least: float):
    """Blocks of the rows that _promising() left, with texts: links of different components.

    Components that a link of the block has joined count as one from then on.
    """

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        joined: dict[int, int] = {}

        def top(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        sets: dict[int, np.ndarray] = {}

        def found(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingles(rows[k][5], width)
            return sets[k]

        ours, theirs, signs, sizes = _sides(rows)
        for k in ours:
            for other in _fits(rows, k, theirs, signs, sizes, percent, least).tolist():
                a, b = top(rows[k][2]), top(rows[other][2])
                if a != b and _similar(found(k), found(other), percent):
                    joined[max(a, b)] = min(a, b)
                    yield min(rows[k][1], rows[other][1]), max(rows[k][1], rows[other][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("near_dedup", _hashes.clear)
        pairs = (pair for _, held in _blocks(batches, (*_BLOCK, "text")) for pair in links(held))
        yield from in_batches(pairs, arrow_schema("a bigint, b bigint"), 10_000)

    return run


def _main(placed: DataFrame, *keys: str) -> DataFrame:
    """Per key of placed (keys, doc_id, comp) with several components: members n, a sign of them, and the largest component."""
    per_comp = placed.groupBy(*keys, "comp").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(doc_id))").alias("sign"))
    sizes = per_comp.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("comps"), F.expr("bit_xor(sign)").alias("sign"), F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"))
    return sizes.filter("comps > 1 and n > 2").drop("comps")


def _open_blocks(buckets: DataFrame, stars: DataFrame, found: DataFrame, block_rows: int, together: int) -> DataFrame:
    """(bucket, i, j, ours, doc_id, comp) of the candidates (buckets: key, hub, doc_id) that lie in several components.

    Documents that buckets hold together, directly or by others, are a group. A group of up to `together`
    documents is looked at as a whole, so that a document stands in it once and not in each of its buckets; in a
    larger one every bucket is, and buckets with the same members count once. Both ways every two members of a
    bucket meet. Block i holds members outside the largest component and meets every block j.
    """
    groups = components(stars)
    groups = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    linked = found.select("node", F.col("component").alias("linked"))
    placed = saved(groups.join(linked, "node", "left").select(F.col("component").alias("group"), F.col("node").alias("doc_id"), F.coalesce("linked", "node").alias("comp")), "placed")
    sizes = saved(_main(placed, "group"), "sizes")
    whole = placed.join(sizes.filter(F.col("n") <= together), "group").select(F.concat(F.lit("g"), "group").alias("bucket"), "doc_id", "comp", "main", "n")
    large = placed.join(sizes.filter(F.col("n") > together).select("group"), "group").select("doc_id", "comp")
    members = buckets.join(large, "doc_id")
    per_bucket = _main(members, "key", "hub").groupBy("hub", "n", "sign").agg(F.min(F.struct("key", "main")).alias("x")).select(F.col("x.key").alias("key"), "x.main", "n")
    parts = members.drop("hub").join(per_bucket, "key").select(F.concat(F.lit("b"), "key").alias("bucket"), "doc_id", "comp", "main", "n")
    rows = whole.unionByName(parts).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    rows = saved(rows.select("bucket", "doc_id", "comp", "blocks", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), (F.col("comp") != F.col("main")).alias("minor")), "open")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sought = rows.filter("minor").select("bucket", F.col("block").alias("i")).distinct()
    ours = rows.filter("minor").select("bucket", F.col("block").alias("i"), each.alias("j"), F.lit(True).alias("ours"), "doc_id", "comp")
    theirs = rows.join(sought, "bucket").select("bucket", "i", F.col("block").alias("j"), F.lit(False).alias("ours"), "doc_id", "comp")
    return ours.unionByName(theirs)


def near_duplicates(
    spark: SparkSession, docs: DataFrame, width: int = 2, percent: int = 80, bands: int = 64, rows: int = 8, block_rows: int = 1024, salts: int = 256, most_ids: int = 4_000_000, least: float = 0.7, together: int = 4096
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = saved(docs.mapInArrow(_sign(width, bands, rows), _SIGN_DDL), "signed")
    classes = saved(signed.filter("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    reps = signed.join(classes, "fp").filter("doc_id = rep").dropDuplicates(["doc_id", "fp"])
    entries = reps.select("doc_id", F.explode("bands").alias("key"))
    hubs = entries.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("most")).filter("hub < most").select("key", "hub")
    buckets = saved(entries.join(hubs, "key").select("key", "hub", "doc_id").distinct(), "buckets")
    stars = saved(buckets.filter("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    links = saved(_links(docs, stars, width, percent, salts, most_ids), "links")
    found = components(links)

    blocks = _open_blocks(buckets, stars, found, block_rows, together)
    sketches = signed.filter("n_shingles > 0").select("doc_id", "n_shingles", "small").dropDuplicates(["doc_id", "small"])
    dealt = blocks.join(sketches, "doc_id").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    promising = saved(dealt.select("bucket", "i", "j", *_BLOCK).mapInArrow(_promising(percent, least), _BLOCK_DDL), "promising")
    if not promising.isEmpty():
        ids = saved(promising.select("doc_id").distinct(), "ids")
        dealt = promising.join(_texts(docs, ids, most_ids), "doc_id").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        more = saved(dealt.select("bucket", "i", "j", *_BLOCK, "text").mapInArrow(_cross(width, percent, least), "a bigint, b bigint"), "more")
        if not more.isEmpty():
            before, found = found, components(more.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
            drop_saved(before)

    named = classes.join(found, classes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    named = saved(named, "named")
    drop_saved(classes, buckets, stars, links, promising, found)
    joined = signed.select("doc_id", "n_shingles", "fp").join(named, "fp", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
