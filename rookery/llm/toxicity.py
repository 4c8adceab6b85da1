"""Toxicity by maximum-scoring segments.

Tokens (words, and stems of rare words) get log-odds between toxic and clean
labelled texts under an informative Dirichlet prior, or 0 where their standard
score is low. A linear-time scan over the log-odds of all tokens, negative ones
too, finds all maximal scoring segments of a text; each is given an expected count
under chance (extreme-value statistics whose scale and rate are fitted on clean
texts), and their sum is calibrated to a probability on labelled texts kept apart.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._batches import rows_of
from ._common import blocks, cut

#: Bounds of the labelled samples, taken by hash: texts of each class to fit token scores, and texts to calibrate.
FIT_TOXIC, FIT_CLEAN, CALIBRATE = 8_000, 12_000, 10_000
#: Bytes of a sample's texts at most; they bound the vocabulary, and with it what is collected and broadcast.
SAMPLE_BYTES = 64 << 20
#: Labelled texts longer than this aren't sampled, so that none takes the place of many; all are scored.
SAMPLE_TEXT = SAMPLE_BYTES // 16
#: The standard score that log-odds need, and the log-odds above 0; others count as 0. The grid that scores lie on.
LEAST_Z, LEAST_ODDS, GRID = 4.0, 1.0, 64
#: The prior's weight as a share of the counts, and its least pseudo-count.
PRIOR, LEAST_PRIOR = 0.1, 0.01
#: A word seen in fewer contexts than this is scored by its stem.
OWN = 5
STEMS = (6, 5, 4)
#: What a token with log-odds of 0 takes off a running segment, and the most that one adds or takes off.
DRIFT, MOST = 0.25, 8.0
THRESHOLD = 0.3
WORD = re.compile(r"\w+")


@dataclass
class Model:
    """tokens: log-odds of words and, under "stem~", of stems. scale and rate: of the extreme-value law. slope and base: of
    the calibration."""

    tokens: dict[str, float]
    scale: float = 1.0
    rate: float = 1.0
    slope: float = 0.0
    base: float = -20.0


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


class Scores(dict):
    """Scores of words seen so far; forgotten beyond a bound. A token takes off DRIFT at least unless its log-odds are above 0."""

    def __init__(self, tokens: dict[str, float]):
        super().__init__()
        self.tokens = tokens

    def __missing__(self, word: str) -> float:
        if len(self) > 400_000:
            self.clear()
        got = self.tokens.get(word)
        if got is None:
            got = next((s for n in STEMS if len(word) >= n and (s := self.tokens.get(word[:n] + "~")) is not None), 0.0)
        self[word] = got = min(got, MOST) if got > 0 else max(min(got, -DRIFT), -MOST)
        return got


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first, after last).

    Linear: each positive token joins a stack of candidates and takes over those that it extends. A candidate knows the
    last one before it that began lower, so those in between are passed over once."""
    x = np.array(scores, np.float64)
    after = np.cumsum(x)
    at = np.flatnonzero(x > 0)
    low: list[float] = []  # sums before a candidate and with it, where it begins and ends, and the last one that began lower
    high, first, last, lower = [], [], [], []
    for i, top, step in zip(at.tolist(), after[at].tolist(), x[at].tolist(), strict=True):
        bottom, begin, j = top - step, i, len(low) - 1
        while j >= 0 and low[j] >= bottom:
            j = lower[j]
        while j >= 0 and high[j] < top:
            bottom, begin, k = low[j], first[j], lower[j]
            del low[j:], high[j:], first[j:], last[j:], lower[j:]
            j = k
        low.append(bottom)
        high.append(top)
        first.append(begin)
        last.append(i + 1)
        lower.append(j)
    return [(h - b, i, j) for b, h, i, j in zip(low, high, first, last, strict=True)]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def weight(found: list[tuple[float, int, int]], n: int, model: Model) -> float:
    """The sum over segments of -ln of the count of such segments expected by chance in n words, where below 1."""
    return sum(max(0.0, model.scale * s - math.log(model.rate * n)) for s, _, _ in found)


def _sample(docs: DataFrame, labels: DataFrame, n: int, part: int, toxic: int | None) -> DataFrame:
    """Texts of n labelled rows and SAMPLE_BYTES at most, by hash, of SAMPLE_TEXT at most each; the bounds make the label side small enough to broadcast."""
    own = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)).isin([0, 1] if part else [2]))
    if toxic is not None:
        own = own.where(F.col("toxic") == toxic)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    held = cut(docs.select("doc_id", "text").join(F.broadcast(own.orderBy(*order).limit(n)), "doc_id").select("doc_id", "text", "toxic"))
    sizes = held.groupBy("doc_id").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.max(F.octet_length("text")), F.lit(0)).alias("longest")).where(F.col("longest") <= SAMPLE_TEXT)
    upto = F.sum("bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return held.join(F.broadcast(sizes.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("doc_id")), "doc_id", "left_semi").select("text", "toxic")


def _contexts(rows: DataFrame) -> DataFrame:
    """word, context, toxic. Copies of a passage give the same contexts, so they count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                found.update(zip(words, ["", *words], [*words[1:], ""], [toxic] * len(words), strict=False))
            if found:
                word, before, after, toxic = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(before), pa.array(after), pa.array(toxic, pa.int32())], ["word", "before", "after", "toxic"])

    held = rows.withColumn("toxic", F.col("toxic").cast("int")).mapInArrow(run, "word string, before string, after string, toxic int")
    return held.groupBy("word", F.xxhash64("before", "after").alias("context")).agg(F.max("toxic").alias("toxic"))


def _log_odds(counts: DataFrame, totals: tuple[int, int]) -> DataFrame:
    """counts: feature, hits (in toxic texts), misses."""
    n1, n0 = totals
    rate = (F.col("hits") + F.col("misses")) / F.lit(float(n1 + n0))
    prior1, prior0 = F.greatest(rate * PRIOR * n1, F.lit(LEAST_PRIOR)), F.greatest(rate * PRIOR * n0, F.lit(LEAST_PRIOR))
    odds = lambda y, n, a: F.log((y + a) / (F.lit(n * (1 + PRIOR) + 1.0) - y))
    delta = odds(F.col("hits"), n1, prior1) - odds(F.col("misses"), n0, prior0)
    z = delta / F.sqrt(1 / (F.col("hits") + prior1) + 1 / (F.col("misses") + prior0))
    telling = ((z >= LEAST_Z) & (delta >= LEAST_ODDS)) | (z <= -LEAST_Z)
    return counts.withColumn("odds", F.when(telling, F.round(delta * GRID) / GRID).otherwise(0.0))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id, toxic; held-out rows and null labels are left out here. Without labels of both classes, as in an
    empty table, the model scores every text alike."""
    labels = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = cut(labels)
    rows = _sample(docs, labels, FIT_TOXIC, 1, 1).unionAll(_sample(docs, labels, FIT_CLEAN, 1, 0))
    words = cut(_contexts(rows).groupBy("word").agg(F.sum("toxic").alias("hits"), F.sum(1 - F.col("toxic")).alias("misses")))
    n1, n0 = words.agg(F.coalesce(F.sum("hits"), F.lit(0)), F.coalesce(F.sum("misses"), F.lit(0))).first()
    if not n1 or not n0:
        return Model({})
    stems = words.select(F.explode(F.array(*[F.when(F.length("word") >= n, F.concat(F.substring("word", 1, n), F.lit("~"))) for n in STEMS])).alias("word"), "hits", "misses").where("word is not null")
    stems = _log_odds(stems.groupBy("word").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses")), (n1, n0)).where("odds > 0")
    own = _log_odds(words.where(F.col("hits") + F.col("misses") >= OWN), (n1, n0))
    # SAMPLE_BYTES bounds both
    tokens = {r["word"]: r["odds"] for r in stems.select("word", "odds").collect()}
    stemmed = lambda w: any(len(w) >= n and w[:n] + "~" in tokens for n in STEMS)
    tokens |= {r["word"]: r["odds"] for r in own.select("word", "odds").collect() if r["odds"] or stemmed(r["word"])}
    return calibrated(Model(tokens), cut(_sample(docs, labels, CALIBRATE, 0, None)))


def _scanned(rows: DataFrame, model: Model, schema: str, row: Callable[[int, list[float], list[tuple[float, int, int]]], list[tuple]]) -> DataFrame:
    """row(toxic, scores, segments) of each of rows(text, toxic)."""
    tokens = dict(model.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(tokens)
        for batch in blocks(batches):
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = [scores[w] for w in words_of(text)]
                out += row(toxic, got, segments(got))
            yield rows_of(schema, out)

    return rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, schema)


def calibrated(model: Model, rows: DataFrame) -> Model:
    """Fits scale and rate on the clean rows and the calibration on all; rows are a bounded sample. What is collected is a
    count for each of the grid's scores, and two numbers for each row."""

    def seen(toxic: int, got: list[float], found: list[tuple[float, int, int]]) -> list[tuple]:
        values, counts = np.unique(np.round(np.array(got) * GRID).astype(np.int64), return_counts=True)
        return [] if toxic else [("token", int(v), int(c), 0.0) for v, c in zip(values, counts, strict=True)] + [("segment", 0, 1, s) for s, _, _ in found]

    sums = _scanned(rows, model, "kind string, value long, n long, s double", seen).groupBy("kind", "value").agg(F.sum("n").alias("n"), F.min("s").alias("s")).collect()
    held = [(r["value"] / GRID, r["n"]) for r in sums if r["kind"] == "token"] + [(MOST, 1)]  # one more, as what wasn't seen isn't impossible
    value, count = (np.array(c, np.float64) for c in zip(*held, strict=True))
    n = float(count.sum())
    low, high = 1e-3, 50.0 / MOST
    for _ in range(60):  # the scale at which exp(scale * score) has mean 1 over clean tokens
        middle = (low + high) / 2
        low, high = (middle, high) if (count * np.exp(middle * value)).sum() < n else (low, middle)
    model.scale = low
    # the count of clean segments of the least score or more, so of all of them
    least, many = next(((r["s"], r["n"] + 1) for r in sums if r["kind"] == "segment"), (MOST, 1))
    model.rate = float(many * math.exp(min(700.0, model.scale * least)) / n)
    weighed = _scanned(rows, model, "x double, y double", lambda toxic, got, found: [(math.log1p(weight(found, max(1, len(got)), model)), float(toxic))]).collect()
    model.slope, model.base = logistic(np.array([r["x"] for r in weighed]), np.array([r["y"] for r in weighed]))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Slope and intercept by Newton steps, the slope under a ridge; one class only gives a constant."""
    if not len(y) or y.min() == y.max():
        return 0.0, 20.0 if len(y) and y.min() == 1 else -20.0
    a, b = 0.0, math.log(y.mean() / (1 - y.mean()))
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([(x * (y - p)).sum() - ridge * a, (y - p).sum()])
        hessian = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(hessian, gradient)
        size = max(1.0, float(np.abs(step).max()) / 2)
        a, b = a + step[0] / size, b + step[1] / size
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 0.0)), float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, score (0 to 1), n_passages, passages (array of first word, words, score and
    expected count by chance, those below 1 only). Null and empty texts get the score of a text without passages;
    repeated rows repeat; an empty table gives an empty one. Only doc_id and text are read; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # SAMPLE_BYTES bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        scores = Scores(model.tokens)
        for batch in blocks(batches):
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                got = [scores[w] for w in words]
                n = max(1, len(words))
                found = segments(got)
                x = model.slope * math.log1p(weight(found, n, model)) + model.base
                kept = [(first, last - first, s, e) for s, first, last in found if (e := model.rate * n * math.exp(-model.scale * s)) < 1]
                out.append((1 / (1 + math.exp(-max(-700.0, min(700.0, x)))), len(kept), [dict(zip(("first_word", "words", "score", "expected"), p, strict=True)) for p in kept]))
            piece = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.float64(), pa.int64(), piece), strict=True))], ["doc_id", "score", "n_passages", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_passages long, passages array<struct<first_word:long,words:long,score:double,expected:double>>")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns. Null and empty texts score like others
    without passages."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # SAMPLE_BYTES bounds it
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        scores = Scores(model.tokens)
        for batch in blocks(batches):
            stay = []
            for text in batch.column(place).to_pylist():
                words = words_of(text)
                x = model.slope * math.log1p(weight(segments([scores[w] for w in words]), max(1, len(words)), model)) + model.base
                stay.append(1 / (1 + math.exp(-max(-700.0, min(700.0, x)))) < threshold)
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)
