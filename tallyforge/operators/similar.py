"""A similarity join of names: the pairs of a block whose Ratcliff-Obershelp ratio reaches a threshold.

Names meet in cells: a block's names are dealt by length band and by salt, so that a cell holds about CELL
names of either side whatever the block's size, and only bands whose lengths allow the ratio meet. In
a cell the right names are an inverted index of grams, and a pair's cost is the sum of its shared grams.

Grams. Let M characters match, of S = |a| + |b|, so that U = S - 2M don't. Between two matched characters
that follow each other lie u unmatched ones of either side, and all u together are at most U. At
least M - 1 - U/2 = 2M - S/2 - 1 of these neighbours have u < 2: the characters are next to each other in one name
and next to each other or but one in the other. So with the pairs of characters at distance one and two as
grams, names of ratio t share at least (t - 1/2) S - 1 of them, counted with repeats. (Grams of
distance one alone prove nothing below a ratio of 2/3.) The shared grams bound M from above,
as the letters that both names hold do; candidates are compared in order of that bound, and a source
stops when it has `top` names better than the next bound. Nothing else is left out.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of a cell on either side, on average; the factor between length bands.
CELL, BAND = 2048, 1.25
_CELL = ("block", "left_band", "left_salt", "right_band", "right_salt")
_FOUND = "block string, left_name string, right_name string, ratio double"


def grams(name: str) -> Counter:
    """The pairs of characters at distance one and two, with repeats."""
    return Counter(map(str.__add__, name, name[1:])) + Counter(map(str.__add__, name, name[2:]))


def _numbered(counts: Counter) -> list[tuple]:
    """A multiset as a set: each member with the number of its repeat."""
    return [(x, k) for x, n in counts.items() for k in range(n)]


class GramIndex:
    """Names by gram and by letter."""

    def __init__(self, names: list[str]):
        self.names, self.sizes = names, np.array([len(n) for n in names])
        self.by_gram, self.by_letter = self._postings(grams), self._postings(Counter)

    def _postings(self, parts) -> dict[tuple, np.ndarray]:
        found = defaultdict(list)
        for k, name in enumerate(self.names):
            for part in _numbered(parts(name)):
                found[part].append(k)
        return {part: np.array(ks, np.int32) for part, ks in found.items()}

    def _shared(self, postings: dict, parts: Counter) -> np.ndarray:
        held = [postings[x] for x in _numbered(parts) if x in postings]
        return np.bincount(np.concatenate(held), minlength=len(self.names)) if held else np.zeros(len(self.names), np.int64)

    def alike(self, name: str, least: float, top: int | None) -> list[tuple[str, float]]:
        """Names of a ratio of `least` or more: all of the best `top`, ties included, and maybe others; without top all."""
        total = self.sizes + len(name)
        matched = np.minimum((self._shared(self.by_gram, grams(name)) + 1 + total / 2) / 2, self._shared(self.by_letter, Counter(name)))
        bound = np.where(total > 0, 2 * matched / np.maximum(total, 1), 1.0) + 1e-9
        hopeful = np.flatnonzero(bound >= least)
        found: list[tuple[str, float]] = []
        best: list[float] = []
        for k in hopeful[np.argsort(-bound[hopeful], kind="stable")].tolist():
            if top and len(best) >= top and best[top - 1] > bound[k]:
                break
            ratio = SequenceMatcher(None, name, self.names[k]).ratio()
            if ratio >= least:
                found.append((self.names[k], ratio))
                if top:
                    best = sorted([*best, ratio], reverse=True)[:top]
        return found


def _compared(least: float, top: int | None):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            index, block = GramIndex(right.column("name").to_pylist()), left.column("block")[0].as_py()
            rows = [(block, name, other, ratio) for name in left.column("name").to_pylist() for other, ratio in index.alike(name, least, top)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)], names=["block", "left_name", "right_name", "ratio"])

    return run


def _dealt(names: DataFrame) -> DataFrame:
    """Distinct names of blocks with band and salt: cells of about CELL names."""
    rows = names.select("block", "name").distinct().withColumn("band", F.floor(F.log(F.greatest(F.length("name"), F.lit(1))) / math.log(BAND)).cast("int"))
    sizes = rows.groupBy("block", "band").agg(F.ceil(F.count("*") / CELL).alias("salts"))
    return rows.join(sizes, ["block", "band"]).withColumn("salt", F.pmod(F.xxhash64("name"), F.col("salts")).cast("int")).drop("salts")


def similar_names(left: DataFrame, right: DataFrame, least: float, top: int | None) -> DataFrame:
    """(block, left_name, right_name, ratio): of each left name its best `top` right names in the block of at
    least `least`, ties included, and maybe others of that ratio.

    left, right: block, name. Ratios are of (left, right), in that order.
    """
    if least < 0.5:
        raise ValueError("names below a ratio of one half need share no gram")
    sides = {side: _dealt(names).withColumnsRenamed({"band": f"{side}_band", "salt": f"{side}_salt"}) for side, names in (("left", left), ("right", right))}
    cells = [sides[side].select("block", f"{side}_band", f"{side}_salt").distinct() for side in ("left", "right")]
    # A name of n characters reaches the ratio with one of n (2 / least - 1) characters at most; bands are one apart at their ends.
    reach = math.log(2 / least - 1) / math.log(BAND) + 1
    meet = cells[0].join(cells[1], "block").filter(F.abs(F.col("left_band") - F.col("right_band")) <= reach)
    rows = {side: own.join(meet, ["block", f"{side}_band", f"{side}_salt"]).select(*_CELL, "name") for side, own in sides.items()}
    other = [f"_{c}" for c in _CELL]
    return rows["left"].groupBy(*_CELL).cogroup(rows["right"].toDF(*other, "name").groupBy(*other)).applyInArrow(_compared(least, top), _FOUND)


def similar_pairs(left: DataFrame, right: DataFrame, least: float, top: int, order: Column) -> DataFrame:
    """(left_key, right_key, ratio): of each left row the first `top` right rows of its block by ratio, then `order`.

    left: key, block, name; right: the same; order: a column over right_key. Of equal right names only
    the first `top` can count, so a name that many rows share stays small.
    """
    from tallyforge.operators.relational import top_k

    named = similar_names(left, right, least, top)
    named_rows = right.select(F.col("key").alias("right_key"), "block", F.col("name").alias("right_name"))
    first = top_k(named_rows, ["block", "right_name"], [order], top).drop("rank")
    own = left.select(F.col("key").alias("left_key"), "block", F.col("name").alias("left_name"))
    rows = own.join(named, ["block", "left_name"]).join(first, ["block", "right_name"])
    return top_k(rows, ["left_key"], [F.desc("ratio"), order], top).select("left_key", "right_key", "ratio")
