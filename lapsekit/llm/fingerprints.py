"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: its lines, at sentence ends and after 16 words. Each digest (the k-th copy of a
paragraph has its own) goes into one cell of each of three tables; a cell holds a count, the XOR of digests and the
XOR of their check values. The difference of two sketches holds only digests that one side lacks, and peeling cells
with a single digest recovers them. Where the cells are too few, both sides are sketched again four times larger, very
long texts in parts by a hash of the digest.
Likeness is the Jaccard similarity that follows from the recovered digests, and 1 for two texts without paragraphs.

A null text is empty. Rows go by descending doc_id (null last), repeated ids by text; after the last comes the first,
a single row follows itself. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.llm.shared import documents, read
from lapsekit.llm.text_arrays import U64, mix

#: Cells of a fingerprint, a multiple of 3; a larger difference takes sketches of 4, 16, ... times as many.
CELLS = 30
PARAGRAPH_WORDS = 16
#: Digests of both sides that larger sketches take at once, about: memory stays bounded.
AT_ONCE = 1 << 20
_CUT = re.compile(r"\n+|(?<=[.!?])[ \t]+")
_CHECK = U64(0xA5A5F00DBEEF1234)
_LOW, _21, _42 = U64(0x1FFFFF), U64(21), U64(42)
LEAST = -(1 << 63)


def paragraphs(text: str) -> list[str]:
    out = []
    for part in _CUT.split(text):
        if len(part) > 8 * PARAGRAPH_WORDS and part.count(" ") >= PARAGRAPH_WORDS:
            words = part.split(" ")
            out += [" ".join(words[i : i + PARAGRAPH_WORDS]) for i in range(0, len(words), PARAGRAPH_WORDS)]
        elif part:
            out.append(part)
    return out


def digests(text: str) -> np.ndarray:
    """A distinct 64-bit digest for each paragraph."""
    raw = b"".join([hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8).digest() for p in paragraphs(text)])
    found = np.sort(np.frombuffer(raw, dtype="<u8").astype(np.uint64))
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    if new.all():
        return found
    at = np.arange(len(found))
    copy = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(copy > 0, mix(found + U64(0x9E37) * copy.astype(np.uint64)), found)


class Sketch:
    def __init__(self, cells: int):
        self.cells = cells
        self.counts = np.zeros(cells, np.int32)
        self.keys = np.zeros(cells, np.uint64)
        self.checks = np.zeros(cells, np.uint64)

    def put(self, found: np.ndarray, sign: np.ndarray | int) -> None:
        third, where = U64(self.cells // 3), mix(found + U64(self.cells))
        thrice = lambda x: np.concatenate((x, x, x))
        if third <= _LOW:  # three places from one hash
            places = where & _LOW, where >> _21 & _LOW, where >> _42
        else:
            places = mix(where + U64(1)), mix(where + U64(2)), mix(where + U64(3))
        at = np.concatenate([x % third + U64(k) * third for k, x in enumerate(places)])
        at = at.astype(np.int64)
        np.add.at(self.counts, at, sign if isinstance(sign, int) else thrice(sign))
        np.bitwise_xor.at(self.keys, at, thrice(found))
        np.bitwise_xor.at(self.checks, at, thrice(mix(found ^ _CHECK)))

    @classmethod
    def of(cls, found: np.ndarray, cells: int) -> Sketch:
        out = cls(cells)
        out.put(found, 1)
        return out

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(self.cells)
        out.counts, out.keys, out.checks = self.counts - other.counts, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The digests only the first side had, and those only the second had; None if cells stay full. Empties it."""
        ours, theirs = [], []
        while True:
            pure = np.flatnonzero((np.abs(self.counts) == 1) & (self.checks == mix(self.keys ^ _CHECK)))
            if not len(pure):
                break
            found, first = np.unique(self.keys[pure], return_index=True)
            sign = self.counts[pure][first]
            ours.append(found[sign > 0])
            theirs.append(found[sign < 0])
            self.put(found, -sign)
        if self.counts.any() or self.keys.any() or self.checks.any():
            return None
        none = [np.zeros(0, np.uint64)]
        return np.concatenate(none + ours), np.concatenate(none + theirs)

    def text(self, n: int) -> str:
        data = self.counts.astype("<i4").tobytes() + self.keys.astype("<u8").tobytes() + self.checks.astype("<u8").tobytes()
        return f"{n}.{base64.b64encode(data).decode()}"


def differing(a: np.ndarray, b: np.ndarray, first: Sketch | None = None, second: Sketch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Digests that only ``a`` has and those that only ``b`` has, by subtraction and peeling, larger on failure.

    A difference without an empty cell is far too large to peel; a larger sketch has room for all digests.
    """
    if first and second:
        rest = first.minus(second)
        if (rest.counts == 0).any() and (found := rest.peel()) is not None:
            return found
    n = 1 + (len(a) + len(b)) // AT_ONCE
    if n > 1:
        of = [mix(x ^ _CHECK) % U64(n) for x in (a, b)]
        parts = [_peeled(a[of[0] == k], b[of[1] == k], 4 * CELLS) for k in range(n)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    return _peeled(a, b, 4 * CELLS if first and second else CELLS)


def _peeled(a: np.ndarray, b: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of ``cells`` cells (of room for all digests, if more than ``CELLS``), then 4, 16, ... times as many."""
    while True:
        while CELLS < cells < 3 * (len(a) + len(b)):
            cells *= 4
        found = Sketch.of(a, cells).minus(Sketch.of(b, cells)).peel()
        if found is not None:
            return found
        cells *= 4


def likeness(a: np.ndarray, b: np.ndarray, first: Sketch | None = None, second: Sketch | None = None) -> float:
    if not len(a) and not len(b):
        return 1.0
    d = sum(map(len, differing(a, b, first, second)))
    return (len(a) + len(b) - d) / (len(a) + len(b) + d)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(df: DataFrame) -> tuple[DataFrame, int]:
    """Texts dealt into ranges of ids (``bucket``), and to each range, as ``tail``, the row that follows its last.

    The ranges come from the ids alone. What the driver learns is one largest id for each range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents(df).withColumn("key", F.coalesce("doc_id", F.lit(LEAST)))
    cuts = np.array(docs.approxQuantile("key", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else [], np.float64)
    cuts = np.unique(cuts.astype(np.int64))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="left").astype(np.int32))

    docs = docs.withColumn("bucket", range_of("key"))
    firsts = docs.groupBy("bucket").agg(F.max("key").alias("first")).orderBy("bucket").collect()
    # the row a range begins with also ends the range above it; the first of all ends the lowest
    above = {r.first: firsts[(i + 1) % len(firsts)].bucket for i, r in enumerate(firsts)}
    if not above:
        return docs.withColumn("tail", F.lit(False)), n
    pairs = F.create_map(*[F.lit(x) for pair in above.items() for x in pair]).cast("map<bigint,int>")
    tails = docs.filter(F.col("key").isin(list(above))).withColumn("bucket", pairs[F.col("key")])
    return docs.withColumn("tail", F.lit(False)).unionByName(tails.withColumn("tail", F.lit(True))), n


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_paragraphs long, only_before array<string>, only_after array<string>"
)


def fingerprints(df: DataFrame, report: bool = False) -> DataFrame:
    """Columns of ``SCHEMA``; with ``report``, the digests recovered between each text and its edited version."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, str]]:
        held = None
        for batch in batches:
            for doc_id, text, bucket, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[2] == bucket:
                    yield held[0], held[1], text
                held = None if tail else (doc_id, text, bucket)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known: tuple[str | None, np.ndarray, Sketch] = (None, np.zeros(0, np.uint64), Sketch(CELLS))

        def sketched(text: str) -> tuple[str, np.ndarray, Sketch]:
            found = digests(text)
            return text, found, Sketch.of(found, CELLS)

        for doc_id, text, following in pairs(batches):
            mine = known if known[0] == text else sketched(text)
            known = sketched(following)
            change = edited(text, following)
            other = sketched(change)
            before, after = differing(mine[1], other[1], mine[2], other[2])
            total, d = len(mine[1]) + len(other[1]), len(before) + len(after)
            names = lambda x: [f"{v:016x}" for v in x.tolist()] if report else None
            yield {
                "doc_id": doc_id,
                "n_chars": len(text),
                "edited_sha256": hashlib.sha256(change.encode("utf-8", "surrogatepass")).hexdigest(),
                "fingerprint": mine[2].text(len(mine[1])),
                "edited_fingerprint": other[2].text(len(other[1])),
                "near_edited": (total - d) / (total + d) if total else 1.0,
                "near_next": likeness(mine[1], known[1], mine[2], known[2]),
                "n_paragraphs": len(mine[1]),
                "only_before": names(before),
                "only_after": names(after),
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in rows(batches):
            held.append(row)
            if len(held) == 1000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in SCHEMA.split(", ")])
    docs, n = in_order(df)
    placed = docs.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "tail", F.desc("key"), "text")
    return placed.select("doc_id", "text", "bucket", "tail").mapInArrow(run, SCHEMA)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents")).drop("n_paragraphs", "only_before", "only_after")
