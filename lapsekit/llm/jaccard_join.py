"""N-gram Jaccard self-join of documents, size-aware: subsets of small sets, inverted lists for large ones.

A document's set holds hashes of its distinct word 5-grams (a shorter text is one gram). Rows with equal sets are one
member. Two members link when 100 * shared >= 80 * united.

* Small sets list all their subsets of the size that any link needs: a set of m and a smaller one share at least
  ceil(0.8 m) grams, so both list their subsets of that size under m.
* Large sets enter inverted lists with their rarest grams only. In one order of all grams, linked sets share a gram
  among their first n - ceil(0.8 n) + 1. The order goes by how often a gram's cell of a table of fixed size occurs in
  the whole corpus, then by hash, so grams that many documents share come last.
* The boundary between the two is the set size at which listing subsets starts to cost more rows and comparisons than
  the lists do, summed over the small sets that are there.

Sets at the boundary enter both, so no link is lost. Candidates are verified on whole sets. Components come from
``lists.linked``.

Null texts and texts without words have an empty set and link with nothing. Repeated rows belong to one member and so
to one component. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.llm.lists import linked, one_row_each, shared_lists
from lapsekit.llm.shared import Work, documents, read
from lapsekit.llm.text_arrays import LOWER, SPACES, U64, Rolling, flat, mix, parts, words

SHINGLE = 5
#: Share of the union, as a fraction of whole numbers.
SHARED, UNITED = 80, 100
#: The table of gram counts has 2**CELL_BITS cells, whatever the corpus; it is sent to every task as one byte a cell.
CELL_BITS, CHUNKS = 22, 64
CELLS = 1 << CELL_BITS
#: Sets above this size are never small: their subsets are too many.
SMALL_AT_MOST = 12


def least_shared(n: int) -> int:
    """Grams that a set of n shares with any linked one, at least."""
    return -(-SHARED * n // UNITED)


def prefix_length(n: int) -> int:
    return n - least_shared(n) + 1


def grams(column: pa.StringArray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams (with repeats), and where each text's begin (one more)."""
    data, starts, ends = flat(column)
    data = LOWER[data]
    a, b, at = words(data, starts, ends, SPACES)
    word = Rolling(data).of(a, b)
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out = np.zeros(int(count.sum()), np.uint64)
    offsets = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(at[:-1] - offsets[:-1], count) + np.arange(len(out))
    width = np.repeat(np.minimum(n, size), count)
    for k in range(size):
        here = width > k
        out = np.where(here, mix(out + U64(0x9E3779B97F4A7C15) + word[np.minimum(first + k, max(len(word) - 1, 0))]), out) if len(word) else out
    return mix(out ^ width.astype(np.uint64)), offsets


def sets(column: pa.StringArray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each text."""
    found, offsets = grams(column, size)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        x = np.sort(found[a:b])
        if b - a > 1:
            new = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=new[1:])
            x = x[new]
        out.append(x)
    return out


def set_names(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and two 64-bit names of sets."""
    n = np.array([len(x) for x in each], np.int64)
    both = np.concatenate(each) if each else np.zeros(0, np.uint64)
    full = np.flatnonzero(n)
    at = (np.cumsum(n) - n)[full]
    names = []
    for salt in (0x1234567, 0x89ABCDEF):
        name = np.zeros(len(each), np.uint64)
        if len(full):
            name[full] = np.add.reduceat(mix(both ^ U64(salt)), at)
        names.append(mix(name + n.astype(np.uint64)).view(np.int64))
    return n, names[0], names[1]


def _cells(each: list[np.ndarray]) -> np.ndarray:
    return np.bincount((np.concatenate(each) >> U64(64 - CELL_BITS)).astype(np.int64), minlength=CELLS).astype(np.uint32)


def members(docs: DataFrame, work: Work, size: int) -> tuple[DataFrame, DataFrame]:
    """Per document row: doc_id, n, member, check, and the grams of small sets; and the table of gram counts in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, waiting, held = np.zeros(CELLS, np.uint32), [], 0
        names = ["doc_id", "n", "member", "check", "small", "chunk", "counts"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        for whole in batches:
            for batch in parts(whole):
                each = sets(batch.column(1), size)
                n, name, check = set_names(each)
                waiting += each
                held += int(n.sum())
                if held > 2_000_000:
                    cells += _cells(waiting)
                    waiting, held = [], 0
                small = [x.view(np.int64) if 0 < len(x) <= SMALL_AT_MOST else None for x in each]
                columns = [batch.column(0), n.astype(np.int32), name, check, small, [None] * len(n), [None] * len(n)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        if held:
            cells += _cells(waiting)
        part = TaskContext.get().partitionId()
        for k, x in enumerate(np.split(cells, CHUNKS)):
            if x.any():
                row = [[None], [part], [None], [None], [None], [k], [x.astype("<u4").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names)

    kinds = "doc_id long, n int, member long, check long, small array<long>, chunk int, counts binary"
    found = work.keep(docs.mapInArrow(run, kinds), "members")
    return found.filter("chunk IS NULL").drop("chunk", "counts"), found.filter("chunk IS NOT NULL").select("chunk", "n", "counts")


def rarity(counts: DataFrame) -> np.ndarray:
    """One byte a cell: the bit length of the cell's count over all documents."""

    def added(key, pdf):
        total = sum(np.frombuffer(x, "<u4" if len(x) == 4 * CELLS // CHUNKS else "<i8").astype(np.int64) for x in pdf["counts"])
        return pdf.iloc[:1].assign(counts=[total.astype("<i8").tobytes()])

    # in two steps, so that no task holds a row of every task before it
    some = counts.withColumn("n", F.pmod("n", F.lit(256))).groupBy("chunk", "n").applyInPandas(added, "chunk int, n int, counts binary")
    rows = some.groupBy("chunk").applyInPandas(added, "chunk int, n int, counts binary").collect()
    out = np.zeros((CHUNKS, CELLS // CHUNKS), np.uint8)
    for r in rows:
        out[r.chunk] = np.ceil(np.log2(np.frombuffer(r.counts, "<i8") + 1)).astype(np.uint8)
    return out.reshape(-1)


def subset_rows(n: int) -> int:
    """Subsets that a small set of n lists."""
    return sum(math.comb(n, least_shared(m)) for m in range(n, n * UNITED // SHARED + 1) if least_shared(m) <= n)


def boundary(found: DataFrame) -> int:
    """The largest set size that lists subsets: least total cost over the small sets, 0 if lists are cheaper for all.

    A list costs a row for each gram of a prefix and half a comparison for each other small set with that gram.
    """
    small = found.filter("small IS NOT NULL").dropDuplicates(["member"]).select("n", "small")
    rows = small.select("n", F.explode(F.slice("small", 1, F.col("n") - F.ceil(F.col("n") * SHARED / UNITED).cast("int") + 1)).alias("gram"))
    per = rows.groupBy("gram").agg(F.count("*").alias("df"))
    cost = rows.join(per, "gram").groupBy("n").agg(F.sum(1 + F.col("df") / 2).alias("cost"))
    lists = {r.n: float(r.cost) for r in cost.collect()}
    sizes = {r.n: r.k for r in small.groupBy("n").agg(F.count("*").alias("k")).collect()}
    total = lambda b: sum(subset_rows(n) * k if n <= b else lists.get(n, 0.0) for n, k in sizes.items())
    return min(range(SMALL_AT_MOST + 1), key=total)


def subsets(x: np.ndarray) -> np.ndarray:
    """Names of the subsets that a small set lists."""
    out, n = [], len(x)
    for m in range(n, n * UNITED // SHARED + 1):
        c = least_shared(m)
        if c <= n:
            picked = np.array(list(combinations(x.tolist(), c)), np.uint64)
            name = np.full(len(picked), m * 1000 + c, np.uint64)
            for k in range(c):
                name = mix(name + picked[:, k])
            out.append(name)
    return np.concatenate(out)


def listed_tokens(docs: DataFrame, ranks: np.ndarray, small_at_most: int, size: int) -> DataFrame:
    """Per document row: doc_id, member, n, ``grams`` (its tokens in inverted lists), ``subsets`` and ``outline``."""
    table = docs.sparkSession.sparkContext.broadcast(ranks)
    both_from = least_shared(small_at_most + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = table.value
        for whole in batches:
            for batch in parts(whole):
                each = sets(batch.column(1), size)
                n, name, _ = set_names(each)
                in_lists, in_subsets = [], []
                for x in each:
                    prefix = None
                    if len(x) > small_at_most or len(x) >= max(both_from, 1):
                        first = rank[(x >> U64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64)
                        key = (first << U64(58)) | (x >> U64(6))
                        k = prefix_length(len(x))
                        prefix = np.sort(np.partition(key, k - 1)[:k] if k < len(key) else key).view(np.int64)  # a gram's index is its place
                    in_lists.append(prefix)
                    in_subsets.append(subsets(x).view(np.int64) if 0 < len(x) <= small_at_most else None)
                columns = [batch.column(0), pa.array(name), pa.array(n.astype(np.int32))]
                columns += [pa.array(c, pa.list_(pa.int64())) for c in (in_lists, in_subsets)]
                columns.append(pa.array([outline(x) for x in each], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "member", "n", "grams", "subsets", "outline"])

    return docs.mapInArrow(run, "doc_id long, member long, n int, grams array<long>, subsets array<long>, outline binary")


#: Bits of a set's outline for each of its grams, and at most: a coarser outline rules out less, never a link.
OUTLINE, OUTLINE_AT_MOST = 6, 4096


def outline(x: np.ndarray) -> bytes:
    """A set's size and a bit for the cell of each gram, in a table that grows with the set (a power of two of bits)."""
    bits = min(1 << max(6, (OUTLINE * len(x)).bit_length()), OUTLINE_AT_MOST)
    marks = np.zeros(bits, np.uint8)
    marks[(x & U64(bits - 1)).astype(np.int64)] = 1
    return len(x).to_bytes(4, "little") + np.packbits(marks, bitorder="little").tobytes()


def promising(outlines: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether pairs may be linked by their outlines. A cell marked in one set alone is a gram the other lacks, so the
    grams shared are at most a set's size less its cells that the other does not mark."""
    marks: dict[int, tuple[int, np.ndarray]] = {}
    for k in np.unique(np.concatenate([x, y])).tolist():
        marks[k] = int.from_bytes(outlines[k][:4], "little"), np.frombuffer(outlines[k], np.uint64, offset=4)
    out = np.zeros(len(x), bool)
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        (n, p), (m, q) = marks[a], marks[b]
        while len(p) > len(q):  # fold the finer table
            p = p[: len(p) // 2] | p[len(p) // 2 :]
        while len(q) > len(p):
            q = q[: len(q) // 2] | q[len(q) // 2 :]
        shared = min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))
        out[k] = UNITED * shared >= SHARED * (n + m - shared)
    return out


def verifier(docs: DataFrame, groups: DataFrame, work: Work, size: int):
    """Checks pairs on the whole sets of their members, which are made for the members of the pairs at hand alone."""

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                each = sets(batch.column(1), size)
                _, name, _ = set_names(each)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array([x.tobytes() for x in each], pa.binary())], ["node", "grams"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ok = np.zeros(len(x), bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok[i] = UNITED * shared >= SHARED * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]), pa.array(y[ok])], ["x", "y"])

    calls: list[str] = []

    def verify(pairs: DataFrame) -> DataFrame:
        if calls:
            work.drop(calls[-1])
        calls.append(f"sets{len(calls)}")
        nodes = pairs.select(F.explode(F.array("x", "y")).alias("member")).distinct()
        wanted = nodes.join(groups, "member").select(F.col("least").alias("_id")).distinct()
        wanted = work.keep(wanted, f"wanted-{calls[-1]}", free=False)
        found = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("doc_id", "text")
        found = one_row_each(found.mapInArrow(whole_sets, "node long, grams binary"), work, calls[-1])
        first = found.select(F.col("node").alias("x"), F.col("grams").alias("gx"))
        second = found.select(F.col("node").alias("y"), F.col("grams").alias("gy"))
        met = pairs.select("x", "y").join(first, "x").join(second, "y").select("x", "y", "gx", "gy")
        return met.mapInArrow(check, "x long, y long")

    return verify


def similar_documents(df: DataFrame, work: Work, size: int = SHINGLE) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, and ``member``, which names its set (0 for the empty one)."""
    docs = documents(df)
    found, counts = members(docs, work, size)
    small_at_most = boundary(found)
    ranks = rarity(counts)
    groups = found.filter("n > 0").groupBy("member", "check").agg(F.min("doc_id").alias("least"))
    groups = work.keep(groups, "groups")
    tokens = work.keep(listed_tokens(docs, ranks, small_at_most, size), "tokens")
    # one row of each member lists tokens
    one = tokens.filter("n > 0").join(groups.select("member", "least"), "member")
    one = one.filter(F.col("doc_id").eqNullSafe(F.col("least"))).select("member", "n", "grams", "subsets", "outline")
    one = work.keep(one, "one")
    work.drop("tokens")
    each = lambda c, kind: one.filter(F.col(c).isNotNull()).select(
        F.posexplode(c).alias("place", "token"), "member", F.col("n").alias("size"), F.lit(kind).alias("kind")
    )
    listed = each("grams", 0)
    if small_at_most:
        listed = listed.unionByName(each("subsets", 1))
    lists = shared_lists(listed, work)
    outlines = one_row_each(one.select(F.col("member").alias("node"), F.col("outline").alias("text")), work, "outlines")
    work.drop("one")
    verify = verifier(docs, groups, work, size)
    labels = linked(lists, work, verify, SHARED / UNITED, SHARED / (SHARED + UNITED), outlines, lambda texts: partial(promising, texts), exact=False)
    classes = groups.join(labels.withColumnRenamed("node", "member"), "member", "left")
    classes = classes.select("member", "check", "least", F.coalesce("label", "member").alias("label"))
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = work.keep(classes.join(least, "label").select("member", "check", "component_id"), "classes")
    rows = found.filter("n > 0").join(classes, ["member", "check"])
    rows = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "member")
    empty = found.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.unionByName(empty.withColumn("member", F.lit(0).cast("long")))


def one_of_each(df: DataFrame, work: Work, size: int = SHINGLE) -> DataFrame:
    """``df`` with one row of each component, that of the smallest doc_id (null last), of those any one. Rows without
    words all stay. Rows go by a written key of their own, whether or not ids repeat."""
    rows = work.keep(df.select(F.struct("*").alias("whole"), F.monotonically_increasing_id().alias("row")), "rows")
    # under their keys all rows have distinct, non-null ids
    found = similar_documents(rows.select(F.col("row").alias("doc_id"), F.col("whole.text").alias("text")), work, size)
    found = work.keep(found.filter("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id"), "found")
    ids = rows.select("row", F.struct(F.col("whole.doc_id").isNull().alias("last"), F.col("whole.doc_id").alias("id"), "row").alias("place"))
    stays = found.join(ids, "row").groupBy("component_id").agg(F.min("place")["row"].alias("row")).select("row")
    gone = work.keep(found.select("row").join(stays, "row", "left_anti"), "gone")
    return rows.join(gone, "row", "left_anti").select("whole.*")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read(spark, sf_dir, "documents"), Work(spark, "op1")).drop("member")


#: The same rows in DuckDB SQL, for unique doc_ids.
OP1_SQL = f"""WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, w[i:i + {SHINGLE - 1}] AS gram FROM
  (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - {SHINGLE - 1}))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b
  ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y
  WHERE {UNITED} * c >= {SHARED} * (sx.n + sy.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least_reached, doc_id)) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, min(y) AS least_reached FROM reach GROUP BY x) USING (doc_id)"""
