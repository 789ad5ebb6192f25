"""Toxicity by two class-conditional Kneser-Ney models over the characters of words.

Each class has its own interpolated Kneser-Ney model at full history (up to order-1 characters, from
the word's start); below it both share one Kneser-Ney backoff whose continuation counts come from all
training texts. An expression that neither class has seen costs both the same, so rare words weigh
nothing, while rare forms of a toxic stem are recognised by their first characters. A toxic document is
ordinary text with some toxic expressions: its words come from the toxic class's model with probability
`share` and from the ordinary one's else. A text's value is the difference of its two length-normalised
log-likelihoods, toxic less ordinary (of texts that were toxic in every word the difference would be that of the two
models themselves, but such texts there are none, and rare ordinary words would drown the toxic ones); logistic calibration on training documents that the counts leave
out turns it into a score.

Labels are learnt from at most `max_per_class` documents of each class (those with the smallest id
hash); counting runs on the executors, and the tables hold every character sequence of those documents.

Defined results: null, empty and wordless texts have value 0 and get the calibrated score of 0;
repeated rows get equal scores; a document counts once for each of its label rows, and one with labels of
both kinds counts in both classes; without training rows of both classes every score is the share of
toxic labels (0 if none); a null doc_id is not held out. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_schema, give_back, in_batches, remembers, sliced

_WORD = re.compile(r"\w+")
#: Words whose value a worker remembers; the memory starts anew beyond it.
_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _grams(word: str, order: int) -> Iterator[str]:
    """Each character of the word and its end, after its history; histories begin at the word's start."""
    padded = f"^{word}$"
    for i in range(1, len(padded)):
        yield padded[max(0, i - order + 1) : i + 1]


_A, _B = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


def _hashed(sums: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    out = (sums + np.asarray(sizes).astype(np.uint64)) * _A
    return (out ^ (out >> np.uint64(32))) * _A


def _tails(points: np.ndarray, start: np.ndarray, longest: int) -> np.ndarray:
    """At each position the hash of up to `longest` characters that end there, not reaching before start."""
    at = np.arange(len(points))
    out = np.zeros(len(points), np.uint64)
    for j in range(longest):
        ok = np.flatnonzero(at - start >= j)
        out[ok] += points[ok - j] * np.uint64(pow(_B, j, 1 << 64))
    return _hashed(out, np.minimum(at - start + 1, longest))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def _joined(grams: Sequence[str] | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all grams in a row, four bytes each, and the size of each gram; no string a gram is made."""
    if not isinstance(grams, pa.ChunkedArray):
        grams = pa.chunked_array([pa.array(grams, pa.string())])
    points = [np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(c)], c), "")[0].as_py().encode("utf-32-le"), "<u4") for c in grams.chunks if len(c)]
    return np.concatenate(points), pc.utf8_length(grams).to_numpy().astype(np.int64)


class KneserNeyPair:
    """Log-likelihood ratio of two classes; counts[c] says how often each gram stands in class c.

    A gram is a history with its next character; grams are distinct. The tables are sorted 64-bit hashes
    of grams and of histories with their values: a few bytes an entry, looked up many at a time.
    """

    def __init__(self, grams: Sequence[str] | pa.ChunkedArray, counts: Sequence[np.ndarray], order: int):
        self.order = order
        if not len(grams):
            self.grams = self.histories = np.zeros(0, np.uint64)
            self.ratio = self.shift = np.zeros(0, np.float32)
            return
        points, sizes = _joined(grams)
        gram, history, shared = self._shared(points, np.cumsum(sizes), sizes)
        histories, of = np.unique(history, return_inverse=True)
        logs, shift = [], np.zeros(len(histories))
        for n, sign in zip(counts, (-1, 1), strict=True):
            n = np.asarray(n, float)
            ones, twos = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
            d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            total, kinds = np.bincount(of, n), np.bincount(of, n > 0)
            seen = total > 0
            total = np.maximum(total, 1)
            weight = np.where(seen, d * kinds / total, 1.0)  # of the backoff: all of it after unseen histories
            logs.append(np.log(np.maximum(n - d, 0) / total[of] + weight[of] * shared))
            shift += sign * np.log(weight)
        at = np.argsort(gram)
        self.grams, self.ratio = gram[at], (logs[1] - logs[0])[at].astype(np.float32)
        self.histories, self.shift = histories, shift.astype(np.float32)

    @staticmethod
    def _shared(points: np.ndarray, ends: np.ndarray, sizes: np.ndarray, d: float = 0.75) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of grams and their histories, and the probability that the backoff gives to each gram
        without its first character.

        Continuation counts say how many different characters stand before a history and its next one,
        in all grams and their endings; lower orders are interpolated from single characters upwards.
        """
        sums, before = points[ends - 1].astype(np.uint64), np.zeros(len(ends), np.uint64)
        shared = np.full(len(ends), 1e-4)
        for size in range(1, int(sizes.max())):  # the grams' proper endings of this size
            some = np.flatnonzero(sizes > size)
            ending, history = _hashed(sums[some], size), _hashed(before[some], size - 1)
            further = points[ends[some] - 1 - size].astype(np.uint64)
            sums[some] += further * np.uint64(pow(_B, size, 1 << 64))
            before[some] += further * np.uint64(pow(_B, size - 1, 1 << 64))
            _, one = np.unique(_hashed(sums[some], size + 1), return_index=True)
            _, first, which = np.unique(ending, return_index=True, return_inverse=True)
            low = np.bincount(which[one], minlength=len(first))
            _, of = np.unique(history[first], return_inverse=True)
            total, kinds = np.bincount(of, low), np.bincount(of)
            shared[some] = (np.maximum(low[which] - d, 0) + d * kinds[of[which]] * shared[some]) / total[of[which]]
        return _hashed(sums, sizes), _hashed(before, sizes - 1), shared

    @staticmethod
    def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.float32)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, values[at]

    def words(self, words: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each word."""
        if not words:
            return np.zeros(0)
        points = _points("".join(f"^{w}$" for w in words))
        begins = np.flatnonzero(points == ord("^"))
        start = np.repeat(begins, np.diff(begins, append=len(points)))
        known, ratio = self._found(self.grams, self.ratio, _tails(points, start, self.order))
        seen, shift = self._found(self.histories, self.shift, np.roll(_tails(points, start, self.order - 1), 1))
        value = np.where(known, ratio, np.where(seen, shift, 0)).astype(float)
        value[begins] = 0
        return np.add.reduceat(value, begins)


class _Values(dict):
    """Remembered differences of words' log-likelihoods in toxic and in ordinary documents."""

    def __init__(self, pair: KneserNeyPair, share: float):
        super().__init__()
        self.pair, self.logs = pair, (math.log1p(-share), math.log(share))

    def texts(self, texts: list[str | None]) -> list[tuple[float, int]]:
        """Difference of the length-normalised log-likelihoods, and words, of each text."""
        if len(self) > _WORDS:
            self.clear()
        split = [words_of(t) for t in texts]
        new = list(set().union(*split).difference(self)) if split else []
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            self.update(zip(part, np.logaddexp(self.logs[0], self.logs[1] + self.pair.words(part)).tolist(), strict=True))
        return [(sum(map(self.__getitem__, words)) / len(words) if words else 0.0, len(words)) for words in split]


def _features(value: float) -> tuple[float, float]:
    """Intercept, and the value on a scale of orders of magnitude."""
    return 1.0, math.copysign(math.log1p(100 * abs(value)), value)


def _count_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("toxicity", lambda: None)
        words: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in sliced(batches):
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words[label].update(words_of(text))
        schema = arrow_schema("label int, gram string, n bigint")
        for label, found in words.items():
            grams: Counter = Counter()
            for word, n in found.items():
                for gram in _grams(word, order):
                    grams[gram] += n
            yield from in_batches(((label, g, n) for g, n in grams.items()), schema, 20_000)

    return run


def _measure(held, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, schema = _Values(held.value, share), arrow_schema("label int, value double, n int")
        for batch in sliced(batches):
            found = values.texts(batch.column("text").to_pylist())
            yield from in_batches(((y, *x) for y, x in zip(batch.column("toxic").to_pylist(), found, strict=True)), schema)

    return run


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the first column is the intercept."""
    beta, keep = np.zeros(x.shape[1]), np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + keep
        step = np.linalg.solve(hessian, x.T @ (w * (y - p)) - keep @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


class ToxicityModel:
    """What fit() learns: the pair of language models, the share of toxic words and the calibration."""

    def __init__(self, pair: KneserNeyPair | None, share: float, beta: np.ndarray):
        self.pair, self.share, self.beta = pair, share, beta


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, order: int = 8, max_per_class: int = 1600, share: float = 0.002) -> ToxicityModel:
    """Learn from labelled documents whose crc32(doc_id as text) mod 5 is not 0; remainder 1 calibrates."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"), fold.alias("fold")).filter("fold <> 0 and toxic in (0, 1)")
    totals = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    if len(totals) < 2:
        return ToxicityModel(None, share, np.array([math.log(max(prior, 1e-12) / max(1 - prior, 1e-12))]))
    chosen = None
    for label in (0, 1):
        part = usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text", "fold")
    counted = (
        texts.filter("fold <> 1").select("toxic", "text")
        .mapInArrow(_count_grams(order), "label int, gram string, n bigint")
        .groupBy("gram").agg(*(F.sum(F.when(F.col("label") == k, F.col("n"))).alias(f"n{k}") for k in (0, 1)))
    )
    grams = counted.toArrow()
    pair = KneserNeyPair(grams.column("gram"), [grams.column(c).fill_null(0).to_numpy() for c in ("n0", "n1")], order)
    del grams
    give_back()
    held = spark.sparkContext.broadcast(pair)
    measured = texts.filter("fold = 1").select("toxic", "text").mapInArrow(_measure(held, share), "label int, value double, n int").toArrow().to_pydict()
    held.destroy()
    y = np.array(measured["label"], float)
    if len(set(measured["label"])) < 2:
        return ToxicityModel(pair, share, np.array([math.log(prior / (1 - prior)), 1.0]))
    x = np.array([_features(v) for v in measured["value"]])
    drawn = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = np.where(y == 1, prior / drawn[1], (1 - prior) / drawn[0]) * len(y)
    return ToxicityModel(pair, share, _logistic(x, y, weight))


def score(spark: SparkSession, docs: DataFrame, model: ToxicityModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and carry columns with held_out, score, predicted, value (per word) and n_words."""
    held = spark.sparkContext.broadcast(model)
    columns = list(dict.fromkeys(["doc_id", "text", *carry]))
    kept = [c for c in columns if c != "text" or "text" in carry]
    kinds = dict(docs.dtypes)
    ddl = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", held_out boolean, score double, predicted int, value double, n_words bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("toxicity", lambda: None)
        pair, beta = held.value.pair, held.value.beta
        values = _Values(pair, held.value.share) if pair else None
        for batch in sliced(batches):
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            found = values.texts(texts) if values is not None else [(0.0, 0)] * len(texts)
            x = np.array([_features(v) for v, _ in found]).reshape(-1, 2)[:, : len(beta)]
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
            made = {
                "held_out": pa.array([i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids], pa.bool_()),
                "score": pa.array(p, pa.float64()),
                "predicted": pa.array((p >= 0.5).astype(np.int32), pa.int32()),
                "value": pa.array([v for v, _ in found], pa.float64()),
                "n_words": pa.array([n for _, n in found], pa.int64()),
            }
            names = [*kept, *made]
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names=names)

    return docs.select(*columns).mapInArrow(run, ddl)
