"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become pieces of at most ``size`` ids; only longer documents are cut. Full pieces are sequences of their
own. The others are dealt by a hash of their row into blocks of some thousand pieces. Several islands evolve packings
of each block: a child takes over whole well-filled bins of the other parent, bins that now hold a piece twice are
dissolved, and the displaced pieces, after exchanges that fill open bins further, go by best fit where they fit most
tightly. A block that best fit cannot bring to its lower bound gets more generations for as long as they help. Between
epochs the best packing of each island moves to the next island through a shuffle. The best packing of any island is
the block's. The emptiest bins of all blocks are packed once more, in blocks of their own, until one block is left.

Null texts are empty and yield one piece with the end id alone. Repeated rows are all packed. An empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.llm.shared import Work, documents, read
from lapsekit.llm.tokens import Encoder

PIECES = "uid long, doc_id long, piece int, start long, length int, ids_crc32 long"
#: Pieces of a block, and its islands; generations end after PATIENCE without a better packing.
BLOCK, ISLANDS, EPOCHS, GENERATIONS, PATIENCE, POPULATION = 4000, 3, 2, 60, 15, 4
#: A bin this full is taken over whole by a child.
WELL_FILLED = 0.995
#: Share of the open bins that a child dissolves at random.
MUTATED = 0.05


def pieces(df: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Rows of ``PIECES``; ``uid`` is unique, and stable once the table is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, uid = Encoder.of(tokenizer), TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, rows = whole.slice(at, 1000), []
                ids = encoder.encode(batch.column(1).to_pylist())
                for doc_id, data in zip(batch.column(0).to_pylist(), ids, strict=True):
                    data = memoryview(data + end)
                    for k, a in enumerate(range(0, len(data), 4 * size)):
                        part = data[a : a + 4 * size]
                        rows.append((uid, doc_id, k, a // 4, len(part) // 4, zlib.crc32(part)))
                        uid += 1
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return documents(df).mapInArrow(run, PIECES)


class Bins:
    """Open bins found by the space they have left; best fit in a few steps."""

    def __init__(self, size: int):
        self.size, self.bins, self.by_space, self.spaces = size, [], {}, 0

    def add(self, items: list[int], space: int) -> None:
        self.bins.append(items)
        self._open(len(self.bins) - 1, space)

    def _open(self, at: int, space: int) -> None:
        if space:
            self.by_space.setdefault(space, []).append(at)
            self.spaces |= 1 << space

    def best_fit(self, item: int, length: int) -> None:
        fitting = self.spaces >> length
        if not fitting:
            self.add([item], self.size - length)
            return
        space = length + (fitting & -fitting).bit_length() - 1
        row = self.by_space[space]
        at = row.pop()
        if not row:
            self.spaces &= ~(1 << space)
        self.bins[at].append(item)
        self._open(at, space - length)


def best_fit(lengths: list[int], order: list[int], size: int) -> list[list[int]]:
    bins = Bins(size)
    for item in order:
        bins.best_fit(item, lengths[item])
    return bins.bins


def exchange(opened: list[tuple[int, list[int]]], displaced: list[int], lengths: list[int]) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """Swaps a piece of an open bin for the longer displaced one that fills the bin most; what is left is shorter."""
    pool = sorted(displaced, key=lambda i: lengths[i])
    keys = [lengths[i] for i in pool]
    out = []
    for space, items in opened:
        items = list(items)
        while space:
            gain, at, k = 0, 0, 0
            for place, item in enumerate(items):
                n = bisect_right(keys, lengths[item] + space) - 1
                if n >= 0 and keys[n] - lengths[item] > gain:
                    gain, at, k = keys[n] - lengths[item], place, n
            if not gain:
                break
            items[at], back = pool[k], items[at]
            del pool[k], keys[k]
            n = bisect_right(keys, lengths[back])
            pool.insert(n, back)
            keys.insert(n, lengths[back])
            space -= gain
        out.append((space, items))
    return out, pool[::-1]


def crossover(first: list[list[int]], second: list[list[int]], lengths: list[int], size: int, rng) -> list[list[int]]:
    """``first`` with a random share of the well-filled bins of ``second``; what they displace is placed by best fit.

    As a mutation, some random open bins and the emptiest ones are dissolved, too.
    """
    full = [b for b in second if sum(lengths[i] for i in b) >= WELL_FILLED * size]
    taken = [b for b in full if rng.random() < 0.5] or full[:1]
    inside = {i for b in taken for i in b}
    child, displaced = Bins(size), []
    for b in taken:
        child.add(list(b), size - sum(lengths[i] for i in b))
    loose = []
    for b in first:
        if inside.isdisjoint(b):
            loose.append((size - sum(lengths[i] for i in b), b))
        else:
            displaced += [i for i in b if i not in inside]
    loose.sort(key=lambda x: -x[0])
    opened = []
    for k, (space, b) in enumerate(loose):
        if space and (k < max(2, len(loose) // 50) or rng.random() < MUTATED):
            displaced += b
        elif space:
            opened.append((space, b))
        else:
            child.add(list(b), 0)
    opened, displaced = exchange(opened, displaced, lengths)
    for space, b in opened:
        child.add(b, space)
    for i in displaced:  # longest first
        child.best_fit(i, lengths[i])
    return child.bins


def cost(bins: list[list[int]], lengths: list[int], size: int) -> tuple[int, float]:
    """Fewest bins first; of equal ones the less even, whose emptiest bins dissolve sooner."""
    return len(bins), -sum((sum(lengths[i] for i in b) / size) ** 2 for b in bins)


def evolve(lengths: list[int], population: list[list[list[int]]], size: int, seed: int) -> list[list[list[int]]]:
    """The population, best first, after its generations; none once a packing is at the lower bound."""
    rng = np.random.default_rng(seed)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    least = -(-sum(lengths) // size)
    valued = [(cost(bins, lengths, size), bins) for bins in population]
    while len(valued) < POPULATION and all(value[0] > least for value, _ in valued):
        noise = rng.normal(0, size / 40 * len(valued), len(order))
        bins = best_fit(lengths, sorted(order, key=lambda i: noise[i] - lengths[i]), size)
        valued.append((cost(bins, lengths, size), bins))
    valued.sort(key=lambda x: x[0])
    stale = 0
    for _ in range(GENERATIONS):
        if valued[0][0][0] <= least or stale >= PATIENCE:
            break
        best = valued[0][0]
        a, b = rng.choice(len(valued), 2, replace=False) if len(valued) > 1 else (0, 0)
        bins = crossover(valued[a][1], valued[b][1], lengths, size, rng)
        valued[-1] = (cost(bins, lengths, size), bins)  # the best ones stay
        valued.sort(key=lambda x: x[0])
        stale = 0 if valued[0][0] < best else stale + 1
    return [bins for _, bins in valued]


def _pack(bins: list[list[int]], n: int) -> bytes:
    of = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        of[b] = k
    return of.tobytes()


def _unpack(data: bytes) -> list[list[int]]:
    of = np.frombuffer(data, np.int32)
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]


def _evolved(states: DataFrame, size: int, epoch: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                n = len(row["lengths"])
                population = [_unpack(x) for x in row["population"] or ()]
                seed = (row["block"] * ISLANDS + row["island"]) * EPOCHS + epoch
                population = evolve(row["lengths"], population, size, seed & (2**63 - 1))
                best = cost(population[0], row["lengths"], size)
                packed = [_pack(b, n) for b in population]
                rows.append(row | {"population": packed, "n_bins": best[0], "unevenness": best[1]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema(
        [("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int32()))]
        + [("population", pa.list_(pa.binary())), ("n_bins", pa.int32()), ("unevenness", pa.float64())]
    )
    kinds = "block long, island int, lengths array<int>, population array<binary>, n_bins int, unevenness double"
    return states.select("block", "island", "lengths", "population").mapInArrow(run, kinds)


def _places(rest: DataFrame, blocks: int, level: int, work: Work, size: int) -> DataFrame:
    """Written rows uid, length, sequence_id, offset, loose: in its block's emptiest bin."""
    rest = rest.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block"))
    # Dealt by a hash of unique numbers, so that a block holds about BLOCK pieces whatever the documents are.
    grouped = rest.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items"))
    grouped = work.keep(grouped.select("block", "items.uid", F.col("items.length").alias("lengths")), f"blocks{level}", free=not level)
    state = grouped.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths")
    state = state.withColumn("population", F.array().cast("array<binary>")).repartition("block", "island")
    for epoch in range(EPOCHS):
        state = work.keep(_evolved(state, size, epoch), f"epoch{level}-{epoch}", free=not level)
        if epoch + 1 < EPOCHS:
            elite = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("population")[0].alias("elite"))
            state = state.join(elite, ["block", "island"])
            kept = F.slice("population", 1, POPULATION - 1)
            state = state.withColumn("population", F.concat(F.array("elite"), kept)).drop("elite", "n_bins", "unevenness")
    best = state.groupBy("block").agg(F.min(F.struct("n_bins", "unevenness", "island")).alias("best"))
    best = best.select("block", "best.island")
    winner = state.join(best, ["block", "island"]).select("block", F.col("population")[0].alias("packing"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                of = np.frombuffer(row["packing"], np.int32)
                lengths = np.array(row["lengths"], dtype=np.int64)
                order = np.argsort(of, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                first = np.concatenate([[True], np.diff(of[order]) > 0])
                offset = np.empty(len(of), np.int64)
                offset[order] = before - before[first][np.cumsum(first) - 1]
                number = (level << 56) + ((row["block"] + 1) << 32) + of.astype(np.int64)
                loose = of == np.argmin(np.bincount(of, lengths))
                columns = [pa.array(row["uid"], pa.int64()), pa.array(lengths.astype(np.int32)), pa.array(number)]
                columns += [pa.array(offset), pa.array(loose)]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "length", "sequence_id", "offset", "loose"])

    places = grouped.join(winner, "block").select("uid", "lengths", "block", "packing")
    places = places.mapInArrow(placed, "uid long, length int, sequence_id long, offset long, loose boolean")
    return work.keep(places, f"places{level}", free=not level)


def packed(parts: DataFrame, work: Work, size: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to written rows of ``PIECES``."""
    full = parts.filter(F.col("length") == size)
    rest = parts.filter(F.col("length") < size)
    blocks, level = max(1, round(rest.count() / BLOCK)), 0
    done = _places(rest, blocks, level, work, size)
    while blocks > 1:
        # The emptiest bins, one a block, meet the others' in new blocks. They stay as they are if that saves none.
        loose = done.filter("loose")
        level, bins, fewer = level + 1, blocks, max(1, round(loose.count() / BLOCK))
        if fewer >= blocks:
            break
        again = _places(loose, fewer, level, work, size)
        if again.select("sequence_id").distinct().count() >= bins:
            break
        done, blocks = done.filter("NOT loose").unionByName(again), fewer
    places = done.select("uid", "sequence_id", "offset")
    # full pieces: numbers below zero, apart from those of blocks
    alone = full.withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    return rest.join(places, "uid").unionByName(alone).drop("uid")


def pack_documents(df: DataFrame, tokenizer: str, work: Work, end_id: int = 0, size: int = 2048) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(work.keep(pieces(df, tokenizer, end_id, size), "pieces"), work, size)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    work = Work(spark, "op4")
    out = pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), work)
    return out.withColumn("length", F.col("length").cast("long"))
