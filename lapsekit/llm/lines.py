"""Removal of lines that occur again, exactly or nearly, by MinHash.

Lines are compared without the white space at their ends. A line's shingles are its runs of ``K`` characters (a
shorter line is one). ``BANDS`` bands of ``ROWS`` minima each find candidates: with 10 bands of 4, lines of similarity
0.8 meet with probability 0.995, of 0.85 with 0.9994. Candidates are verified by the exact Jaccard similarity of their
shingles. Of each connected component one line stays: that of the smallest doc_id, and there the first.

Blank lines always stay. Null texts are empty. Rows with equal id and text count as one document and all get its
result; a null doc_id is the smallest. Empty tables give no rows. ``dedup_lines`` keeps extra columns under any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.llm.lists import linked, one_row_each, shared_lists
from lapsekit.llm.shared import Work, quoted, read
from lapsekit.llm.text_arrays import U64, mix, parts

K, BANDS, ROWS, SIMILARITY = 7, 10, 4, 0.8
_LEAST_ID = -(1 << 63)
_SEEDS = np.random.default_rng(77).integers(1, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32)
_STEP = np.uint32(0x01000193)
#: Characters of lines compared at once, but for a longer pair.
CHARACTERS = 1 << 20
#: Above all code points; stands behind lines that are shorter than a shingle.
_NO_CHARACTER = 0x110000
_ODD = U64(0x9E3779B97F4A7C15)
#: Bits for the number of a line or pair, of which there are fewer at once, before a shingle's name.
ROOM = U64(12)
_NAME = (U64(1) << (U64(64) - ROOM)) - U64(1)
#: Cells of a line's outline. Lines of far more shingles fill it; their pairs are all compared.
CELLS = 1 << 12
#: Pairs for each list row that outlines judge in less time than a round of pivots takes.
CHEAP = 16
#: Characters hashed at once, which stay in a core's cache, but for a longer line; and lines.
HASHED, LINES = 1 << 17, 1_000


def shingles(line: str) -> set[str]:
    return {line[i : i + K] for i in range(len(line) - K + 1)} or {line}


@lru_cache(maxsize=4_000)
def _names(line: str) -> np.ndarray:
    """Shingles as numbers; the same within a process."""
    return np.sort(np.array([hash(x) for x in shingles(line)], np.int64))


def similar(a: str, b: str) -> bool:
    both = np.concatenate((_names(a), _names(b)))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared >= SIMILARITY * (len(both) - shared)


def _sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of all lines, one after the other, as sorted names of ``64 - ROOM`` bits; where each line's begin (one
    more)."""
    lengths = np.array([len(x) for x in lines])
    sizes = np.maximum(lengths, K)
    ends = np.cumsum(sizes)
    padded = "".join(x if len(x) >= K else x.ljust(K) for x in lines)
    chars = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    for i in np.flatnonzero(lengths < K).tolist():
        chars[ends[i] - K + lengths[i] : ends[i]] = _NO_CHARACTER
    h = chars[: len(chars) - K + 1].copy()
    for j in range(1, K):
        h *= _ODD
        h += chars[j : len(h) + j]
    h = mix(h * _ODD)
    inside = np.ones(len(chars), bool)
    for j in range(1, K):
        inside[ends - j] = False
    h = h[inside[: len(h)]] >> ROOM
    h |= np.repeat(np.arange(len(lines), dtype=np.uint64) << (U64(64) - ROOM), sizes - K + 1)
    h.sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    h = h[new]
    return h & _NAME, np.searchsorted(h >> (U64(64) - ROOM), np.arange(len(lines) + 1).astype(np.uint64))


def _rows(starts: np.ndarray, n: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets ``of`` some lines, and for each place which of these lines it is of."""
    which = np.repeat(np.arange(len(of)), n[of])
    return np.arange(len(which)) + (starts[of] - (np.cumsum(n[of]) - n[of]))[which], which


def _judged(lines: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    used, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    names, starts = _sets([lines[i] for i in used.tolist()])
    n = np.diff(starts)
    x, y = at[: len(x)], at[len(x) :]
    out = np.minimum(n[x], n[y]) >= SIMILARITY * np.maximum(n[x], n[y]) - 1e-9
    x, y = x[out], y[out]
    keys = []
    for side in (x, y):
        place, pair = _rows(starts, n, side)
        keys.append(names[place] | (pair.astype(np.uint64) << (U64(64) - ROOM)))
    both = np.concatenate(keys)
    both.sort()
    twice = both[1:][both[1:] == both[:-1]] >> (U64(64) - ROOM)
    shared = np.bincount(twice.astype(np.int64), minlength=len(x))
    out[out] = shared >= SIMILARITY * (n[x] + n[y] - shared) - 1e-9
    return out


def _pieces(sizes: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """First and last (one more) of runs of some ``most`` in sum, at least one each and ``rows`` at most."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = int(np.searchsorted(ends, ends[first] - sizes[first] + most, side="right"))
        last = max(first + 1, min(last, first + rows))
        yield first, last
        first = last


class Judge:
    """``similar`` for pairs of these lines by their places, exactly; shingles have 52-bit names.

    Outlines, made once for each line in a pair, rule out most pairs: a cell marked in one line alone is a shingle that
    the other lacks. What they leave is compared whole.
    """

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.lengths = np.array([len(x) for x in lines], np.int64)
        self.windows = np.maximum(self.lengths - K + 1, 1)
        self.outlines = np.zeros((len(lines), CELLS // 64), np.uint64)
        self.known = np.zeros(len(lines), bool)

    def outline(self, places: np.ndarray) -> None:
        places = np.unique(places)
        places = places[~self.known[places]]
        for first, last in _pieces(self.lengths[places], HASHED, LINES):
            some = places[first:last]
            h, n = _hashes([self.lines[i] for i in some.tolist()])
            marks = np.zeros((len(some), CELLS), np.uint8)
            marks[np.repeat(np.arange(len(some)), n), h & np.uint32(CELLS - 1)] = 1
            self.outlines[some] = np.packbits(marks, axis=1).view(np.uint64)
        self.known[places] = True

    def possible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p, q = self.outlines[x], self.outlines[y]
        both = p & q
        a, b = (np.bitwise_count(z ^ both).sum(axis=1, dtype=np.int64) for z in (p, q))
        shared = np.minimum(self.windows[x] - a, self.windows[y] - b)  # at most
        return shared >= SIMILARITY * (shared + a + b) - 1e-9

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = np.asarray(x, np.int64), np.asarray(y, np.int64)
        out = np.zeros(len(x), bool)
        self.outline(np.concatenate((x, y)))
        for first in range(0, len(x), LINES):
            out[first : first + LINES] = self.possible(x[first : first + LINES], y[first : first + LINES])
        left = np.flatnonzero(out)
        x, y = x[left], y[left]
        for first, last in _pieces(self.lengths[x] + self.lengths[y], CHARACTERS, 1 << int(ROOM) - 1):
            out[left[first:last]] = _judged(self.lines, x[first:last], y[first:last])
        return out


def all_similar(lines: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``similar`` for the pairs of lines at these places, in pieces of some ``CHARACTERS``."""
    return Judge(lines)(x, y)


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of all lines, with repeats, and how many each line has."""
    padded = [x if len(x) >= K else x.ljust(K, "\0") for x in lines]
    sizes = np.array([len(x) for x in padded])
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    n = len(chars) - K + 1
    h = chars[:n].copy()
    for j in range(1, K):
        h *= _STEP
        h ^= chars[j : n + j]
        h += np.uint32(j * 0x9E3779B1 & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    ends = np.cumsum(sizes)
    inside = np.ones(len(chars), bool)
    for j in range(1, K):
        inside[ends - j] = False
    return h[inside[:n]], sizes - K + 1


def bands(lines: list[str]) -> np.ndarray:
    """A row of ``BANDS`` names for each line."""
    out = np.zeros((len(lines), BANDS), np.uint64)
    for first, last in _pieces(np.array([len(x) for x in lines]), HASHED, LINES):
        h, n = _hashes(lines[first:last])
        offsets = np.cumsum(n) - n
        mixed = np.empty_like(h)
        for band in range(BANDS):
            name = np.full(len(n), band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                np.bitwise_xor(h, _SEEDS[0, k], out=mixed)
                np.multiply(mixed, _SEEDS[1, k] | np.uint32(1), out=mixed)
                name = mix(name + np.minimum.reduceat(mixed, offsets))
            out[first:last, band] = name
    return out


def line_name(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def occurrences(docs: DataFrame) -> DataFrame:
    """A row for each line that is not blank: member, doc, th, line; ``bands`` with its first in a part of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["member", "doc", "th", "line", "bands"]
        for whole in batches:
            for batch in parts(whole, 2, 1 << 19):
                doc, th = (c.to_numpy() for c in batch.columns[:2])
                held, at, members, first = [], [], [], []
                seen: set[bytes] = set()
                new: list[str] = []
                for text in batch.column(2).to_pylist():
                    before = len(at)
                    for i, line in enumerate(text.split("\n")):
                        line = line.strip()
                        if line:
                            name = line_name(line)
                            at.append(i)
                            members.append(name)
                            first.append(name not in seen)
                            if first[-1]:
                                seen.add(name)
                                new.append(line)
                    held.append(len(at) - before)
                if new:
                    found = bands(new).view(np.int64)
                    offsets = np.concatenate([[0], np.cumsum(np.where(first, BANDS, 0))]).astype(np.int32)
                    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1)))
                    columns = [np.frombuffer(b"".join(members), "<i8"), np.repeat(doc, held), np.repeat(th, held), np.array(at, np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), listed], names)

    return docs.select("doc", "th", "text").mapInArrow(run, "member long, doc long, th long, line int, bands array<long>")


def verifier(docs: DataFrame, groups: DataFrame, lists: DataFrame, work: Work):
    """Checks pairs of lines on their texts, fetched once, each from one place where it occurs; and those texts."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lines = [], []
            for text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = text.split("\n")
                nodes += [x["member"] for x in wanted]
                lines += [own[x["line"]].strip() for x in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lines, pa.string())], ["node", "text"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.concat_arrays([batch.column(2), batch.column(3)]).dictionary_encode()
            at, n = both.indices.to_numpy(), batch.num_rows
            ok = pa.array(all_similar(both.dictionary.to_pylist(), at[:n], at[n:]), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["x", "y"])

    wanted = lists.select("member").distinct().join(groups, "member")
    wanted = wanted.groupBy("first.doc", "first.th").agg(F.collect_list(F.struct("member", "first.line")).alias("wanted"))
    found = docs.join(work.keep(wanted, "wanted"), ["doc", "th"]).select("text", "wanted").mapInArrow(fetch, "node long, text string")
    found = one_row_each(found, work, "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        a = found.select(F.col("node").alias("x"), F.col("text").alias("a"))
        b = found.select(F.col("node").alias("y"), F.col("text").alias("b"))
        return pairs.select("x", "y").join(a, "x").join(b, "y").select("x", "y", "a", "b").mapInArrow(check, "x long, y long")

    return verify, found


def repeats(docs: DataFrame, work: Work) -> DataFrame:
    """Per document with any: doc, th and ``lines``, the numbers of the lines to remove. ``docs``: doc, th, text."""
    found = work.keep(occurrences(docs), "lines")
    tokens = found.filter(F.size("bands") > 0)
    lists = shared_lists(tokens.select(F.explode("bands").alias("token"), "member"), work)
    groups = found.groupBy("member").agg(F.count("*").alias("n"), F.min(F.struct("doc", "line", "th")).alias("first"))
    groups = work.keep(groups, "groups")
    verify, texts = verifier(docs, groups, lists, work)
    labels = linked(lists, work, verify, texts=texts, similar=Judge, cheap=CHEAP)
    # a line that comes once and is like no other is a class of its own
    classes = groups.join(labels.withColumnRenamed("node", "member"), "member", "left").filter("n > 1 OR label IS NOT NULL")
    classes = classes.select("member", "n", "first", F.coalesce("label", "member").alias("label"))
    kept = classes.groupBy("label").agg(F.min("first").alias("keep"), F.sum("n").alias("total")).filter("total > 1")
    kept = work.keep(kept.select("label", "keep"), "kept", free=False)  # for plain shuffles: a class of very many lines is split
    classes = work.keep(classes.join(kept, "label").select("member", "keep"), "classes")
    # plain shuffles on both sides: a line of very many documents is split
    gone = found.select("member", "doc", "th", "line").join(classes, "member")
    gone = gone.filter(F.struct("doc", "line", "th") != F.col("keep")).groupBy("doc", "th").agg(F.collect_set("line").alias("lines"))
    gone = work.keep(gone, "gone")
    work.drop("lines", "lists")
    return gone


def judged_lines(df: DataFrame, work: Work) -> DataFrame:
    """``whole``, a struct of all columns of ``df`` (doc_id and text among them), with the text that stays as ``kept``, and
    n_lines, n_removed."""
    text = F.coalesce("whole.text", F.lit(""))
    docs = df.select(F.struct("*").alias("whole"), F.coalesce("doc_id", F.lit(_LEAST_ID)).alias("doc")).withColumn("th", F.xxhash64(text))
    gone = repeats(docs.select("doc", "th", text.alias("text")), work)
    # a row a document at most in ``gone``, so texts need no sort to meet it; they are split once, not for each line that stays
    found = docs.join(gone.hint("shuffle_hash"), ["doc", "th"], "left").select("whole", "lines", F.split(text, "\n", -1).alias("split"))
    left = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "lines")
    kept = F.transform(left, lambda i: F.element_at("split", i + 1))
    return found.select(
        "whole",
        F.size("split").cast("long").alias("n_lines"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("lines").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept"),
    )


def dedup_lines(df: DataFrame, work: Work) -> DataFrame:
    """``df`` with the text that stays, and n_chars after it where ``df`` has that. No other column changes, whatever it is
    called."""
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return judged_lines(df, work).select(*[new[c].alias(c) if c in new else F.col(f"whole.{quoted(c)}").alias(c) for c in df.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), Work(spark, "op8"))
    return out.select("whole.doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
