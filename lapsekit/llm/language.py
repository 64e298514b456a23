"""Language of whole texts: averaged embeddings of hashed subwords under a linear softmax.

A text's subwords are its byte 3-grams and 4-grams after lower-casing A-Z, each hashed into one of ``BUCKETS`` rows of
an embedding. Their mean goes through a linear layer into a softmax. Both are trained together by stochastic gradient
descent on a bounded sample; a validation share of it sets the temperature of the scores and the least score that is
not rejected. Because the layers are linear up to the softmax, they fold into one table of (bucket, language) for
prediction.

A text is rejected if its calibrated score is below the level where validation texts were right too seldom, or if much of
it is byte pairs that the sample never shows: another script, or noise.

Texts that are null or hold no letter are ``und`` with score 0 and are rejected. Without any labelled row every
document is ``und``. Equal texts get equal results, repeated rows are all kept, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.llm.shared import crc_mod, quoted, read
from lapsekit.llm.text_arrays import LOWER, flat, parts

BUCKETS, WIDTH, EPOCHS, BATCH, RATE = 4096, 16, 12, 64, 0.5
#: Texts counted at once: a row of BUCKETS numbers each.
ROWS = 128
#: The sample's bound: documents of each language that training takes, and of all languages together (1.2 GB of counts on
#: the driver; with more languages each has fewer documents).
PER_LANGUAGE, ROWS_AT_MOST = 1500, 150_000
#: Scores are rejected where those below, too, were right less often than this in validation; none from REJECT_AT_MOST on.
RIGHT_AT_LEAST, REJECT_AT_MOST = 0.9, 0.9
#: Texts with at least this share of byte pairs that the sample lacks are in no language learned.
UNFAMILIAR = 0.2
_HAS_LETTER = r"\p{L}"


def counts(column: pa.StringArray) -> np.ndarray:
    """Mean bucket counts per text (rows sum to 1, or are 0 without a 3-gram)."""
    data, starts, ends = flat(column)
    n, size = len(starts), len(data)
    out = np.zeros(n * BUCKETS, np.float32)
    if size:
        low = np.concatenate([LOWER[data], np.zeros(3, np.uint8)]).astype(np.uint32)
        gram = low[:size] | (low[1 : size + 1] << 8) | (low[2 : size + 2] << 16)
        row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, ends - starts)
        left = np.repeat(ends, ends - starts) - np.arange(size)
        for length, keys in ((3, gram), (4, gram | (low[3:] << 24))):
            inside = left >= length
            bucket = (keys[inside] * np.uint32(2654435761 + 2 * length)) >> np.uint32(20)
            out += np.bincount(row[inside] + bucket, minlength=n * BUCKETS).astype(np.float32)
    out = out.reshape(n, BUCKETS)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def pairs(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring bytes as numbers, A-Z lower-cased, and the text that each is of."""
    data, starts, ends = flat(column)
    low = LOWER[data].astype(np.uint16)
    text = np.repeat(np.arange(len(starts)), ends - starts)
    inside = text[1:] == text[:-1]
    return (low[:-1] | (low[1:] << 8))[inside], text[1:][inside]


def unfamiliar(column: pa.StringArray, seen: np.ndarray) -> np.ndarray:
    """Share of each text's byte pairs that are not ``seen``."""
    pair, text = pairs(column)
    n = len(column)
    return np.bincount(text[~seen[pair]], minlength=n) / np.maximum(np.bincount(text, minlength=n), 1)


def reject_below(score: np.ndarray, right: np.ndarray) -> float:
    """The highest score, up to ``REJECT_AT_MOST``, such that the texts scoring less were right too seldom."""
    order = np.argsort(score, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    low = np.flatnonzero((share < RIGHT_AT_LEAST) & (score[order] < REJECT_AT_MOST))
    return float(np.nextafter(score[order][low[-1]], 2)) if len(low) else 0.0


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    seen: np.ndarray | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.table + self.bias

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = _softmax(self.logits(x) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """Fits on four fifths of the rows, calibrates on the rest (on all, if fewer than ten)."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = (order, order) if len(y) < 10 else (order[: len(y) // 5], order[len(y) // 5 :])
    embedding = rng.normal(0, 1, (x.shape[1], WIDTH)).astype(np.float32)
    layer = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(fit), BATCH):
            rows = rng.permutation(fit)[:BATCH] if at == 0 else fit[at : at + BATCH]
            mean = x[rows] @ embedding
            error = _softmax(mean @ layer + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = error @ layer.T
            layer -= rate * 20 * (mean.T @ error)
            bias -= rate * error.sum(axis=0)
            embedding -= rate * 2000 * (x[rows].T @ back)
        rng.shuffle(fit)
    model = Model(languages, embedding @ layer, bias)
    z, truth = model.logits(x[held]), y[held]
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    best, score = model.predict(x[held])
    model.reject_below = reject_below(score, best == truth)
    return model


def sample(df: DataFrame, learn: Column) -> DataFrame:
    """About ``PER_LANGUAGE`` labelled texts of each language, fewer where there are so many languages that they would be
    more than ``ROWS_AT_MOST`` in all. Rows are picked one by one, whether or not they are alike."""
    rows = df.filter(learn & F.col("lang").isNotNull() & F.regexp_like("text", F.lit(_HAS_LETTER))).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    each = min(PER_LANGUAGE, ROWS_AT_MOST // max(1, sizes.count()))
    place = F.xxhash64(F.lit(3), "doc_id", F.crc32(F.col("text").cast("binary")), F.monotonically_increasing_id())
    # a small row for each language; the model itself holds BUCKETS numbers for each
    picked = rows.withColumn("place", F.pmod(place, F.lit(1 << 30)) / (1 << 30)).join(F.broadcast(sizes), "lang")
    return picked.filter(F.col("place") * F.col("n") < each)


def fit(df: DataFrame, learn: Column) -> Model | None:
    """The model of the labelled rows that ``learn`` allows; None without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, 1, rows=ROWS):
                x = counts(batch.column(1)).astype(np.float16)
                seen = np.zeros(1 << 16, bool)
                seen[pairs(batch.column(1))[0]] = True
                marks = [np.packbits(seen).tobytes(), *[None] * (len(x) - 1)]
                columns = [batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "x", "seen"])

    rows = sample(df, learn).select("lang", "text").mapInArrow(run, "lang string, x binary, seen binary").collect()
    if not rows:
        return None
    seen = np.zeros(1 << 16, bool)
    for r in rows:
        if r.seen is not None:
            seen |= np.unpackbits(np.frombuffer(r.seen, np.uint8)).astype(bool)
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    languages = sorted({r.lang for r in rows})
    x = np.frombuffer(b"".join(r.x for r in rows), np.float16).reshape(len(rows), BUCKETS).astype(np.float32)
    model = train(x, np.array([languages.index(r.lang) for r in rows]), languages)
    model.seen = seen
    return model


def _predicted(df: DataFrame, model: Model | None, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns as k0, k1, .. with lang_pred, score and ``rejected``; ``df`` needs ``text``."""
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, batch_at, rows=ROWS):
                letters = np.array(batch.column(letter_at).to_pylist(), bool)
                if model is None:
                    lang, score = ["und"] * len(letters), np.zeros(len(letters))
                    rejected = np.ones(len(letters), bool)
                else:
                    best, score = model.predict(counts(batch.column(batch_at)))
                    lang = [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                    score = np.where(letters, score, 0.0).astype(np.float64)
                    rejected = ~letters | (score < model.reject_below)
                    rejected |= unfamiliar(batch.column(batch_at), model.seen) >= UNFAMILIAR
                columns = [batch.column(i) for i in range(len(keep))]
                columns += [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score", "rejected"])

    batch_at, letter_at = len(keep), len(keep) + 1
    letter = F.coalesce(F.regexp_like("text", F.lit(_HAS_LETTER)), F.lit(False)).alias("letter")
    kept = [F.col(quoted(c)).alias(n) for c, n in zip(keep, names, strict=True)]
    rows = df.select(*kept, F.col("text").alias("text"), letter)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")


def _named(found: DataFrame, keep: tuple[str, ...], *more: str) -> DataFrame:
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *more)


def predict(df: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """``keep`` columns with lang_pred, score and ``rejected``; ``df`` needs ``text``."""
    return _named(_predicted(df, model, keep), keep, "lang_pred", "score", "rejected")


def accepted(df: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``df`` that are not rejected, whatever its columns are called."""
    return _named(_predicted(df, model, tuple(df.columns)).filter("NOT rejected"), tuple(df.columns))


def identify(df: DataFrame, held_out: Column, *keep: str) -> DataFrame:
    """Learns from the rows that are not ``held_out`` and predicts all."""
    return predict(df, fit(df, ~held_out), *keep)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(4) == 2
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out)
    return identify(docs, F.col("held_out"), "doc_id", "held_out")
