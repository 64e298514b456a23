"""Quality of whole texts: a Bradley-Terry ranking learned from preference pairs.

Every text has a score s = w x over a few shares counted in it (kinds of characters, repeated words, line and word
lengths). A labelled good text should beat a bad one: w minimises the logistic loss of s(good) - s(bad) over random
pairs of a bounded sample, by stochastic gradient descent. The threshold is a quantile of the scores of all labelled
rows that may be learned from: the share of bad labels, its place right to a millionth of the rows. Scores become probabilities by a logistic curve that has ``CUT`` at that threshold.

Null and empty texts have all shares 0 and a score like any other. Without labels of both kinds every score is ``CUT``.
Equal texts get equal scores; repeated rows are all kept; a document with several labels takes part with each; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.llm.shared import crc_mod, read
from lapsekit.llm.text_arrays import SPACES, Rolling, flat, parts, words

#: The sample's bound: labelled rows of each of the two labels that training takes.
PER_LABEL = 4000
PAIRS, EPOCHS, BATCH, RATE, DECAY = 40_000, 4, 64, 0.3, 1e-4
CUT = 0.3
_LETTER, _UPPER, _DIGIT, _WIDE, _SPACE, _LINE, _END, _PIPE, _MARK, _OTHER = range(10)
_KIND = np.full(256, _OTHER, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = _LETTER, _UPPER, _DIGIT, _WIDE
_KIND[32], _KIND[10] = _SPACE, _LINE
for _chars, _kind in ((".,;:'\"-()?", _END), ("|", _PIPE), ("!", _MARK)):
    _KIND[[ord(c) for c in _chars]] = _kind
N_FEATURES = 19


def features(column: pa.StringArray) -> np.ndarray:
    """Shares per text, as square roots so that rare kinds count."""
    data, starts, ends = flat(column)
    n = len(starts)
    size = np.maximum(ends - starts, 1)
    row = np.repeat(np.arange(n), ends - starts)
    kinds = np.bincount(row * 10 + _KIND[data], minlength=10 * n).reshape(n, 10) / size[:, None]
    a, b, at = words(data, starts, ends, SPACES)
    hashes, owner = Rolling(data).of(a, b), np.repeat(np.arange(n), np.diff(at))
    total = np.maximum(np.diff(at), 1)
    share = lambda hit: np.bincount(owner[hit], minlength=n) / total
    same = np.zeros(len(a), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    skip = np.zeros(len(a), bool)
    skip[2:] = (hashes[2:] == hashes[:-2]) & (owner[2:] == owner[:-2])
    distinct = np.array([len(np.unique(hashes[i:j])) for i, j in zip(at[:-1], at[1:], strict=True)]) / total
    last, first = _KIND[data[b - 1]] if len(a) else np.zeros(0, int), _KIND[data[a]] if len(a) else np.zeros(0, int)
    second = _KIND[data[np.minimum(a + 1, np.maximum(b - 1, 0))]] if len(a) else np.zeros(0, int)
    shout = (first == _UPPER) & (second == _UPPER)
    length = b - a
    mean = np.bincount(owner, weights=length, minlength=n) / total
    shares = [kinds, share(same)[:, None], share(skip)[:, None], distinct[:, None] / np.log2(total + 2)[:, None]]
    shares += [x[:, None] for x in (share(last == _OTHER), share(last == _MARK), share(shout), share(length == 1))]
    shares += [np.minimum(mean, 40)[:, None] / 40, np.log2(size)[:, None] / 32]
    return np.sqrt(np.concatenate(shares, axis=1)).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    slope: float = 1.0

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.log(CUT / (1 - CUT)) + self.slope * (self.rank(x.astype(np.float64)) - self.threshold)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(good: np.ndarray, bad: np.ndarray, bad_share: float, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    both = np.concatenate([good, bad]).astype(np.float64)
    model = Model(both.mean(axis=0), both.std(axis=0) + 1e-6, np.zeros(both.shape[1]))
    g, b = (np.clip((x - model.mean) / model.scale, -6, 6) for x in (good, bad))
    for epoch in range(EPOCHS):
        i, j = rng.integers(0, len(g), PAIRS), rng.integers(0, len(b), PAIRS)
        for at in range(0, PAIRS, BATCH):
            difference = g[i[at : at + BATCH]] - b[j[at : at + BATCH]]
            wrong = 1 / (1 + np.exp(np.clip(difference @ model.weights, -60, 60)))
            step = RATE / (1 + epoch)
            model.weights += step * ((wrong[:, None] * difference).mean(axis=0) - DECAY * model.weights)
    sg, sb = model.rank(good), model.rank(bad)
    # the quantile of all labelled scores, the two samples weighted by the labels' shares
    scores = np.concatenate([sg, sb])
    weight = np.concatenate([np.full(len(sg), (1 - bad_share) / len(sg)), np.full(len(sb), bad_share / len(sb))])
    order = np.argsort(scores)
    k = min(int(np.searchsorted(np.cumsum(weight[order]), bad_share)), len(scores) - 2)
    model.threshold = float((scores[order[k]] + scores[order[k + 1]]) / 2)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model | None:
    """``labels``: doc_id, quality. Takes rows that ``learn`` allows; None unless both labels occur."""
    rows = labels.filter(learn & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    sizes = {r.quality: r.n for r in rows.filter("quality IN (0, 1)").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    picked = [rows.filter(F.col("quality") == k).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(PER_LABEL) for k in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                x = pa.array(features(batch.column(1)).tolist(), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), x], ["quality", "x"])

    # two samples of PER_LABEL rows: a broadcast of a known bound
    met = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    found = met.select("quality", "text").mapInArrow(run, "quality int, x array<float>").collect()
    side = [np.array(sorted(r.x for r in found if r.quality == k), np.float64) for k in (0, 1)]
    if not all(len(s) for s in side):
        return None
    n = sum(sizes.values())
    model = train(side[1], side[0], sizes[0] / n)
    between = quantiles(docs, rows.filter("quality IN (0, 1)"), model, [sizes[0] / n, min(1.0, (sizes[0] + 1) / n)])
    if between:
        model.threshold = sum(between) / 2
    return model


def quantiles(docs: DataFrame, rows: DataFrame, model: Model, at: list[float]) -> list[float] | None:
    """Ranks at these shares of all labelled ``rows`` with a document. Only ids and ranks are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                value = model.rank(features(batch.column(1)).astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64())], ["doc_id", "rank"])

    ranked = docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, rank double")
    return ranked.join(rows.select("doc_id"), "doc_id").agg(F.percentile_approx("rank", at, 1_000_000)).first()[0]


def score(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """``keep`` columns with ``score`` and ``predicted``; ``docs`` needs ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, at):
                n = batch.num_rows
                value = model.score(features(batch.column(at))) if model else np.full(n, CUT)
                columns = [*batch.columns[:at], pa.array(value, pa.float64()), pa.array((value >= CUT).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "score", "predicted"])

    at = len(keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, f"{kinds}, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(5) == 0
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out)
    model = fit(docs, read(spark, sf_dir, "labels"), ~held_out)
    return score(docs, model, "doc_id", "held_out")
