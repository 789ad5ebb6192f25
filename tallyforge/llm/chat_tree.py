"""Chat formatting as prefix trees.

Conversations that begin with the same turns share them: turns become nodes of a tree, each node's text
is emitted once, depth-first, and carries position ids (its depth in characters) and the intervals of
its ancestors, which are what it may attend to.

A row holds a bounded part of a tree. Equal conversations are one leaf; a first turn with at most
`shard` leaves is one row. A prefix that more than `shard` leaves share is large: its last turn is a row
of its own, once, and the leaves below it that share no deeper large prefix are dealt by their next turn
over rows of about `shard` leaves. Such rows name the rows of their ancestors in `context`, from the
first turn on; they attend to the whole of these, and their positions begin at `context_chars`. So every
shared turn is emitted exactly once, whatever the size of its group. Template:
<|im_start|>role\\ntext<|im_end|>\\n. Control strings inside roles and texts are escaped by a backslash
after their first character (one more if there are some already), which unescape() takes back.

Defined results: null roles and texts are empty; turns are ordered by (turn, role, text), nulls
first, so repeated turn numbers and rows stay; rows without a conv_id form one conversation; an empty
table gives no tree. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_schema, drop_saved, in_batches, saved

#: The control strings of the template and of other common templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(\\\\*){re.escape(c[1:])}" for c in sorted(CONTROL, key=len, reverse=True)))
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text begins and ends."""
    head = f"{START}{escape(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(turn: str, begin: int, end: int) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    return unescape(turn[len(START) : begin - 1]), unescape(turn[begin:end])


def _chain(parent: bytes, role: str, text: str) -> bytes:
    r, t = role.encode(), text.encode()
    return hashlib.blake2b(b"%b%d:%b%b" % (parent, len(r), r, t), digest_size=16).digest()


_CONV_DDL = "conv_id bigint, leaf string, prefixes array<string>, sizes array<int>, roles array<string>, texts array<string>"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turn rows in order of (conv_id, turn, role, text) to one row per conversation."""

    def rows():
        nothing = object()
        at, prefixes, sizes, roles, texts = nothing, [], [], [], []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != at or at is nothing:
                    if at is not nothing:
                        yield at, prefixes[-1], prefixes, sizes, roles, texts
                    at, prefixes, sizes, roles, texts, node = conv, [], [], [], [], b""
                role, text = role or "", text or ""
                node = _chain(node, role, text)
                prefixes.append(node.hex())
                sizes.append(len(render(role, text)[0]))
                roles.append(role)
                texts.append(text)
        if at is not nothing:
            yield at, prefixes[-1], prefixes, sizes, roles, texts

    yield from in_batches(rows(), arrow_schema(_CONV_DDL), 500)


TREE_DDL = (
    "tree string, context array<string>, context_chars int, text string, node_start array<int>, node_end array<int>, node_parent array<int>, position_start array<int>, "
    "attention_node array<int>, attention_start array<int>, attention_end array<int>, "
    "body_start array<int>, body_end array<int>, loss array<int>, leaf_node array<int>, leaf array<string>"
)


class _Tree:
    """The trie of one row, below its context, and its depth-first emission."""

    def __init__(self, name: str, context: Sequence[str], context_chars: int):
        self.name, self.context, self.context_chars = name, context, context_chars
        self.children: list[dict[tuple[str, str], int]] = [{}]
        self.turns: list[tuple[str, str]] = [("", "")]
        self.leaves: list[tuple[int, str]] = []

    def add(self, leaf: str | None, roles: Sequence[str], texts: Sequence[str]) -> None:
        at = 0
        for turn in zip(roles, texts, strict=True):
            below = self.children[at]
            if turn not in below:
                below[turn] = len(self.turns)
                self.turns.append(turn)
                self.children.append({})
            at = below[turn]
        if leaf is not None:
            self.leaves.append((at, leaf))

    def emit(self) -> tuple:
        parts, size = [], 0
        number: dict[int, int] = {}
        starts, ends, parents, positions, body_starts, body_ends, loss = [], [], [], [], [], [], []
        sees: list[list[tuple[int, int]]] = []
        stack = [(child, -1) for child in reversed(list(self.children[0].values()))]
        while stack:
            node, parent = stack.pop()
            turn, begin, end = render(*self.turns[node])
            number[node] = me = len(starts)
            starts.append(size)
            ends.append(size + len(turn))
            parents.append(parent)
            positions.append(self.context_chars if parent < 0 else positions[parent] + ends[parent] - starts[parent])
            body_starts.append(size + begin)
            body_ends.append(size + end)
            loss.append(int(self.turns[node][0] == "assistant"))
            # What a node sees in its row: what its parent sees, and its parent; intervals that touch are one.
            seen = list(sees[parent]) if parent >= 0 else []
            if parent >= 0:
                joined = seen.pop()[0] if seen and seen[-1][1] == starts[parent] else starts[parent]
                seen.append((joined, ends[parent]))
            sees.append(seen)
            parts.append(turn)
            size += len(turn)
            stack += [(child, me) for child in reversed(list(self.children[node].values()))]
        whom = [k for k, seen in enumerate(sees) for _ in seen]
        seen_from, seen_to = ([x[side] for seen in sees for x in seen] for side in (0, 1))
        leaves = [number[n] for n, _ in self.leaves]
        return self.name, self.context, self.context_chars, "".join(parts), starts, ends, parents, positions, whom, seen_from, seen_to, body_starts, body_ends, loss, leaves, [x for _, x in self.leaves]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns below the context, sorted by tree, to one row per tree."""

    def rows():
        tree = None
        for batch in batches:
            names = ("tree", "context", "context_chars", "leaf", "roles", "texts")
            for name, context, chars, leaf, roles, texts in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if tree is None or tree.name != name:
                    if tree:
                        yield tree.emit()
                    tree = _Tree(name, context, chars)
                tree.add(leaf, roles, texts)
        if tree:
            yield tree.emit()

    yield from in_batches(rows(), arrow_schema(TREE_DDL), 50)


_READ_DDL = "leaf string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every leaf's conversation, read from its row's text and intervals and from the rows of its context."""

    def rows():
        for batch in batches:
            for tree in batch.to_pylist():
                text, parents = tree["text"], tree["node_parent"]
                before = [(*parse(x["text"], x["begin"], x["end"]), x["loss"], len(x["text"])) for x in tree["before"] or ()]
                turns: dict[int, tuple[str, str, int, int]] = {}
                for leaf_node, leaf in zip(tree["leaf_node"], tree["leaf"], strict=True):
                    path = []
                    while leaf_node >= 0:
                        path.append(leaf_node)
                        leaf_node = parents[leaf_node]
                    for node in path:
                        if node not in turns:
                            begin, end = tree["node_start"][node], tree["node_end"][node]
                            turns[node] = *parse(text[begin:end], tree["body_start"][node] - begin, tree["body_end"][node] - begin), tree["loss"][node], end - begin
                    said, masked, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                    whole = before + [turns[node] for node in reversed(path)]
                    for role, body, loss, size in whole:
                        said.update(f"{role}\n{body}\n".encode())
                        chars += size
                        if loss:
                            masked.update(body.encode())
                            loss_chars += len(body)
                    yield leaf, len(whole), said.hexdigest(), loss_chars, masked.hexdigest(), chars

    yield from in_batches(rows(), arrow_schema(_READ_DDL), 1000)


def gather(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, leaf hash, prefix hashes, sizes, roles, texts. A conversation fits in memory, as a text does."""
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "role", "text"]
    return turns.repartition(parts, "conv_id").sortWithinPartitions(*keys).select("conv_id", "role", "text").mapInArrow(_gather, _CONV_DDL)


def deal(leaves: DataFrame, shard: int) -> DataFrame:
    """Rows of trees (tree, conv_id, leaf, first, last): which conversation's turns from first to last go where.

    leaves: leaf, conv_id, prefixes. A row without a leaf holds the last turn of a large prefix. first and
    last count turns from 0 and 1; the turns before first are the context.
    """
    large_roots = leaves.groupBy(F.get("prefixes", F.lit(0)).alias("root")).count().filter(F.col("count") > shard).select("root")
    below_large = leaves.join(large_roots, F.get("prefixes", F.lit(0)) == F.col("root"), "left_semi")
    turns = below_large.select("leaf", "conv_id", F.posexplode("prefixes").alias("at", "prefix"))
    large = turns.groupBy("prefix").agg(F.count("*").alias("n"), F.min(F.struct("leaf", "conv_id", "at")).alias("x")).filter(F.col("n") > shard)
    depths = turns.join(large.select("prefix"), "prefix", "left_semi").groupBy("leaf").agg(F.count("*").cast("int").alias("depth"))
    known = leaves.join(depths, "leaf", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    ends = F.col("depth") == F.size("prefixes")  # the whole conversation is a large prefix
    stem = F.when(F.col("depth") > 0, F.get("prefixes", F.col("depth") - 1)).otherwise(F.get("prefixes", F.lit(0)))
    known = known.select("leaf", "conv_id", stem.alias("stem"), "depth", ends.alias("ends"), F.size("prefixes").alias("last"), F.get("prefixes", F.col("depth")).alias("next"))
    per_stem = known.groupBy("stem").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("next"), F.col("parts")).cast("string")
    name = F.when(F.col("ends") | (F.col("depth") == 0), F.col("stem")).otherwise(F.concat_ws("-", "stem", part))
    rows = known.join(per_stem, "stem").select(name.alias("tree"), "conv_id", "leaf", (F.col("depth") - F.col("ends").cast("int")).alias("first"), "last")
    own = large.select(F.col("prefix").alias("tree"), "x.conv_id", F.lit(None).cast("string").alias("leaf"), F.col("x.at").alias("first"), (F.col("x.at") + 1).alias("last"))
    return rows.unionByName(own)


def format_chats(spark: SparkSession, conversations: DataFrame, shard: int = 256) -> tuple[DataFrame, DataFrame]:
    """(trees, membership): the formatted trees, and conv_id to leaf."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    convs = saved(gather(conversations), "convs")
    first = saved(convs.groupBy("leaf").agg(F.min(F.struct("conv_id", "prefixes")).alias("x")).select("leaf", "x.*"), "leaves")
    dealt = deal(first, shard).withColumnRenamed("conv_id", "_id")
    turns = F.lit(1) + F.col("first"), F.col("last") - F.col("first")
    rows = convs.select("conv_id", "prefixes", "sizes", "roles", "texts").join(dealt, F.col("conv_id").eqNullSafe(F.col("_id"))).select(
        "tree", F.slice("prefixes", F.lit(1), F.col("first")).alias("context"), F.aggregate(F.slice("sizes", F.lit(1), F.col("first")), F.lit(0), lambda a, x: a + x).alias("context_chars"),
        "leaf", F.slice("roles", *turns).alias("roles"), F.slice("texts", *turns).alias("texts"),
    )
    trees = saved(rows.repartition(parts, "tree").sortWithinPartitions("tree", "leaf").mapInArrow(_build, TREE_DDL), "trees")
    drop_saved(first)
    return trees, convs.select("conv_id", "leaf")


def read_back(trees: DataFrame, membership: DataFrame) -> DataFrame:
    """conv_id with the digests of its conversation as the formatted output holds it."""
    first = F.lit(0)
    named = trees.filter(F.size("context") > 0).select(F.col("tree").alias("of"), F.posexplode("context").alias("at", "tree"))
    ancestors = trees.join(named.select("tree").distinct(), "tree", "left_semi").select("tree", "text", F.get("body_start", first).alias("begin"), F.get("body_end", first).alias("end"), F.get("loss", first).alias("loss"))
    before = named.join(ancestors, "tree").groupBy("of").agg(F.array_sort(F.collect_list(F.struct("at", "text", "begin", "end", "loss"))).alias("before"))
    whole = trees.join(before, F.col("tree") == F.col("of"), "left").select("text", "node_start", "node_end", "node_parent", "body_start", "body_end", "loss", "leaf_node", "leaf", "before")
    return membership.join(whole.mapInArrow(_read_back, _READ_DDL), "leaf").drop("leaf")
