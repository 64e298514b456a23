"""Removal of every byte covered by a long string that starts anywhere else, by grouping hashes at content-chosen anchors.

Prefix doubling ranks all positions by growing prefixes and drops positions whose rank is unique. This is another
method: positions are thinned by content first, and three groupings by 64-bit rolling hashes stand for the ranks.

* Each start of a ``length``-byte string belongs to an anchor, the place of the least hash of 8 bytes among its first
  ``WINDOW``. Equal strings have anchors at equal distances. About one byte in fifty is an anchor.
* Round 1 groups anchors by their first ``length - WINDOW + 1`` bytes, which every string of the anchor shares. Unique
  anchors drop out: none of their strings occurs again.
* Round 2 groups by the whole block, all strings of an anchor at once. Where all blocks of a round-1 rank
  are equal, or two blocks are, all their strings repeat.
* Round 3 groups the single strings of one block of each kind that is left.

A string found equal in round 3 agrees in two 64-bit names, those of rounds 1 and 3; its distance from the anchor is not compared.

Null texts are empty. Repeated rows are documents like others, so long ones vanish together. Empty tables give no
rows; extra columns are ignored. Very long texts are ranked in overlapping parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.llm.shared import Work, documents, read
from lapsekit.llm.text_arrays import PART, U64, Rolling, flat, mix, parts

LENGTH, WINDOW, GRAM = 200, 100, 8
#: Strings of round-1 ranks with more blocks than this are counted one by one; the others' blocks meet in one task.
LARGE = 2000
_ODD = U64(0xD6E8FEB86659FD93)
_HIGH = U64(0xFFFFFFFF00000000)
_LEAST_ID = -(1 << 63)


def keyed(df: DataFrame) -> DataFrame:
    """Documents under a key that tells rows with equal ids apart: (id, hash of the text)."""
    docs = documents(df)
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LEAST_ID)).alias("doc"), F.xxhash64("text").alias("th"))


def segments(column: pa.StringArray, overlap: int = LENGTH, part: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, and for each piece of a text in them: row, start, end, how many starts it has, its place in the text."""
    data, starts, ends = flat(column)
    if len(data) <= 4 * part:
        yield data, np.arange(len(starts)), starts, ends, ends - starts, np.zeros(len(starts), np.int64)
        return
    for row, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        for at in range(a, b, part):
            end = min(b, at + part + overlap)
            one = lambda x: np.array([x], np.int64)
            yield data[at:end], one(row), one(0), one(end - at), one(min(part, b - at)), one(at - a)


def blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_starts: np.ndarray, length: int, window: int):
    """Per block: piece, first string's start (in ``data``), number of strings, anchor's distance, core and block name."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = np.ndarray((n - GRAM + 1,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    least = ((grams * _ODD) & _HIGH) | np.arange(n - GRAM + 1, dtype=np.uint64)
    width = 1
    while width < window:  # least over ``window`` places from each
        step = min(width, window - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    valid = np.zeros(n + 1, np.int64)
    fits = np.minimum(ends - starts - length + 1, n_starts)
    has = fits > 0
    np.add.at(valid, starts[has], 1)
    np.add.at(valid, starts[has] + fits[has], -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(at):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = (least[at] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    a, b, p = at[first], at[last], anchor[first]
    names = Rolling(data)
    core = names.of(p, p + length - window + 1)
    whole = mix(names.of(a, b + length) ^ mix((p - a).astype(np.uint64)))
    piece = np.searchsorted(starts, a, side="right") - 1
    while len(piece) and (short := ends[piece] <= a).any():  # empty pieces share a start
        piece[short] -= 1
    return piece, a, b - a + 1, p - a, core, whole


def anchors(docs: DataFrame, length: int, window: int, part: int = PART) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, 2, part):
                doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for data, rows, starts, ends, n_starts, base in segments(batch.column(2), length, part):
                    piece, a, n, before, core, name = blocks(data, starts, ends, n_starts, length, window)
                    row = rows[piece]
                    columns = [core.view(np.int64), name.view(np.int64), doc[row], th[row], a - starts[piece] + base[piece]]
                    columns = [pa.array(c) for c in columns] + [pa.array(n.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["core", "block", "doc", "th", "at", "n"])

    return docs.select("doc", "th", "text").mapInArrow(run, "core long, block long, doc long, th long, at long, n int")


def strings(texts: DataFrame, length: int) -> DataFrame:
    """Names of the single strings of the listed blocks of each text, a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "large", "doc", "th", "open", "at", "names"]
        for batch in batches:
            held, size = [], 0
            for row in batch.select(["doc", "th", "text", "blocks"]).to_pylist():
                text = row["text"].encode("utf-8", "surrogatepass")
                for x in row["blocks"]:
                    part = text[x["at"] : x["at"] + x["n"] + length - 1]
                    held.append((row["doc"], row["th"], x, part))
                    size += len(part)
                    if size > PART:
                        yield pa.RecordBatch.from_arrays(named(held), names)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays(named(held), names)

    def named(held: list[tuple]) -> list[pa.Array]:
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
        rolling = Rolling(np.frombuffer(b"".join(x[3] for x in held), np.uint8))
        out, base = [], 0
        for doc, th, x, part in held:
            at = np.arange(x["n"])
            found = rolling.of(base + at, base + at + length)
            base += len(part)
            out.append((x["core"], x["large"], doc, th, x["open"], x["at"], found.view(np.int64)))
        return [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]

    return texts.mapInArrow(run, "core long, large boolean, doc long, th long, open boolean, at long, names array<long>")


_RANGES = "doc long, th long, start long, end long"


def runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Byte ranges of sorted strings (doc, th, begin), those that follow each other as one."""
    held: list[np.ndarray] | None = None  # the last range, which the next batch may go on with
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, th, begin = (c.to_numpy() for c in batch.columns)
        new = np.ones(len(begin), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (begin[1:] > begin[:-1] + 1)
        first = np.flatnonzero(new)
        end = begin[np.concatenate([first[1:], [len(begin)]]) - 1] + length
        found = [doc[first], th[first], begin[first], end]
        if held is not None:
            if held[0][0] == doc[0] and held[1][0] == th[0] and begin[0] <= held[3][0] - length + 1:
                found[2] = np.concatenate([held[2], found[2][1:]])
            else:
                found = [np.concatenate(x) for x in zip(held, found, strict=True)]
        held = [x[-1:] for x in found]
        if len(found[0]) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in found], ["doc", "th", "start", "end"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["doc", "th", "start", "end"])


def repeated_in_large(named: DataFrame, work: Work, length: int) -> DataFrame:
    """``repeated`` for ranks of any number of blocks: no task holds the blocks of a rank or the places of a string."""
    single = named.select("core", "doc", "th", "open", "at", F.posexplode("names").alias("start", "name"))
    # partial counts: a string gives each reducer one row from a task, however often it occurs
    again = work.keep(single.groupBy("core", "name").agg(F.count("*").alias("n")).filter("n > 1").select("core", "name"), "again")
    # Plain shuffles: adaptive execution splits a string that many blocks hold.
    found = single.filter("open").join(again, ["core", "name"]).select("doc", "th", (F.col("at") + F.col("start")).alias("begin"))
    placed = found.repartition("doc", "th").sortWithinPartitions("doc", "th", "begin")
    return placed.mapInArrow(lambda batches: runs(batches, length), _RANGES)


def repeated(named: DataFrame, length: int) -> DataFrame:
    """Byte ranges of strings, in open blocks, that another block of the same rank has, too; at most LARGE blocks a rank."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows in pieces that end where core changes."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            core = batch.column(0).to_numpy()
            new = np.flatnonzero(core[1:] != core[:-1]) + 1
            if held and held[-1].column(0)[-1].as_py() != core[0]:
                yield pa.Table.from_batches(held)
                held = []
            cut = int(new[-1]) if len(new) else 0
            if cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            core, doc, th, is_open, at, names = (c.combine_chunks() for c in table.columns)
            core, doc, th, at = (c.to_numpy() for c in (core, doc, th, at))
            is_open = is_open.to_numpy(zero_copy_only=False)
            sizes = np.diff(names.offsets.to_numpy())
            owner = np.repeat(np.arange(len(core)), sizes)
            key, name = core[owner], names.flatten().to_numpy()
            start = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.lexsort((name, key))
            same = (name[order][1:] == name[order][:-1]) & (key[order][1:] == key[order][:-1])
            again = np.zeros(len(order), bool)
            again[order[1:]] = same
            again[order[:-1]] |= same
            hit = np.flatnonzero(again & is_open[owner])
            if not len(hit):
                continue
            block, begin = owner[hit], at[owner[hit]] + start[hit]
            new = np.ones(len(begin), bool)
            new[1:] = (block[1:] != block[:-1]) | (begin[1:] != begin[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(begin)]]) - 1
            columns = [doc[block[first]], th[block[first]], begin[first], begin[last] + length]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "th", "start", "end"])

    placed = named.select("core", "doc", "th", "open", "at", "names").repartition("core").sortWithinPartitions("core")
    return placed.mapInArrow(run, _RANGES)


def ranges_to_remove(docs: DataFrame, work: Work, length: int = LENGTH, window: int = WINDOW, part: int = PART) -> DataFrame:
    """Per document with any: doc, th and ``ranges``, byte ranges to remove (start, end), unsorted."""
    found = work.keep(anchors(docs, length, window, part), "anchors")
    ranks = found.groupBy("core").agg(F.count("*").alias("n_core"), F.min("block").alias("least"), F.max("block").alias("most"))
    ranks = ranks.filter("n_core > 1").select("core", "n_core", (F.col("least") != F.col("most")).alias("mixed"))
    ranks = work.keep(ranks, "ranks")
    # Plain shuffles on both sides: adaptive execution splits a rank that many positions share.
    left = work.keep(found.join(ranks, "core"), "left")
    work.drop("anchors", "ranks")
    mixed = left.filter("mixed")
    kinds = mixed.groupBy("core", "block").agg(
        F.count("*").alias("m"), F.min(F.struct("doc", "th", "at", "n")).alias("one"), F.min("n_core").alias("n_core")
    )
    kinds = work.keep(kinds, "kinds")
    listed = kinds.select(
        "one.doc", "one.th",
        F.struct("core", "one.at", "one.n", (F.col("m") == 1).alias("open"), (F.col("n_core") > LARGE).alias("large")).alias("x"),
    )
    listed = work.keep(listed.groupBy("doc", "th").agg(F.collect_list("x").alias("blocks")), "listed")
    # Of a row that occurs twice all blocks have m > 1: naming its strings twice opens none.
    texts = docs.select("doc", "th", "text").join(listed, ["doc", "th"])
    named = work.keep(strings(texts, length), "strings")
    whole = left.filter("NOT mixed").select("doc", "th", "at", "n")
    equal = mixed.join(kinds.filter("m > 1").select("core", "block"), ["core", "block"]).select("doc", "th", "at", "n")
    ranges = whole.unionByName(equal).select("doc", "th", F.col("at").alias("start"), (F.col("at") + F.col("n") + length - 1).alias("end"))
    ranges = ranges.unionByName(repeated(named.filter("NOT large"), length))
    ranges = ranges.unionByName(repeated_in_large(named.filter("large"), work, length))
    out = work.keep(ranges.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")
    work.drop("left", "kinds", "listed", "strings", "again")
    return out


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of sorted, joined ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove(docs: DataFrame, ranges: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the remaining bytes on demand."""
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                rows = []
                for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    spans, at, kept = merged(found), 0, []
                    for a, b in spans:
                        kept.append(data[at:a])
                        at = b
                    rest = b"".join([*kept, data[at:]])
                    digest = hashlib.sha256(rest).hexdigest()
                    rows.append((doc_id, len(data), len(data) - len(rest), len(spans), digest, rest if with_bytes else None))
                names = [x.split()[0] for x in kinds.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    joined = docs.join(ranges, ["doc", "th"], "left").select("doc_id", "text", "ranges")
    out = joined.mapInArrow(run, kinds)
    return out if with_bytes else out.drop("kept")


def remove_repeats(
    df: DataFrame, work: Work, length: int = LENGTH, window: int = WINDOW, with_bytes: bool = False, part: int = PART
) -> DataFrame:
    docs = keyed(df)
    return remove(docs, ranges_to_remove(docs, work, length, window, part), with_bytes)


def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), Work(spark, "op5"))
