"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. A window is ``span`` consecutive
words of a benchmark item. A text keeps, of every ``span - k + 1`` consecutive k-grams, the one with the least hash;
so each stretch of ``span`` words keeps at least one k-gram, and equal stretches keep equal ones. Kept k-grams of both
sides meet in a join. Each carries the words around it, and a hit is extended over them to the windows that agree.
Items of fewer words than ``span`` are one window each; their lengths are looked up as a whole.

Null and empty texts have no words and no hits. Repeated document rows each get their own result, repeated items
count once by item_id; items with a null item_id are left out of n_items and the digest but still hit. A table
without items leaves everything clean. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.llm.shared import Work, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: every ASCII character but digits and lower-case letters.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SPAN, K = 10, 5
#: Enough for the place of any word in a text.
PLACE_BITS = 30
#: Fingerprints of a benchmark that are sent to every task at most (each about 200 bytes); more are joined by shuffle.
BROADCAST_ROWS = 200_000


def word_hashes(text: Column) -> Column:
    """A 64-bit hash for each word."""
    words = F.split(F.translate(text, UPPER, LOWER), BETWEEN)
    words = F.filter(words, lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def kept_grams(df: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """Explodes ``w`` into the kept k-grams: ``gram``, ``at`` (from 1), ``around`` and ``first``, the place of its
    first word. ``around`` holds the words that any window over the k-gram can hold."""
    n, width = F.size("w"), span - k + 1
    # a k-gram's hash above its place: the least of them is the least hash, the first of equal ones
    grams = F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda i: F.shiftleft(F.xxhash64(F.slice("w", i, k)), PLACE_BITS).bitwiseOR(i)
    )
    df = df.filter(n >= span).withColumn("grams", grams)
    least = F.transform(F.sequence(F.lit(1), F.size("grams") - width + 1), lambda i: F.array_min(F.slice("grams", i, width)))
    places = F.transform(F.array_distinct(least), lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))
    df = df.withColumn("places", places).drop("grams")
    picks = F.transform(
        "places",
        lambda i: F.struct(
            F.xxhash64(F.slice("w", i, k)).alias("gram"),
            i.alias("at"),
            F.greatest(i - (span - k), F.lit(1)).alias("first"),
            F.slice("w", F.greatest(i - (span - k), F.lit(1)), 2 * span - k - F.greatest(span - k + 1 - i, F.lit(0))).alias("around"),
        ),
    )
    others = [c for c in df.columns if c not in ("w", "places")]
    return df.select(*others, F.inline(picks))


def hits(docs: DataFrame, items: DataFrame, work: Work, span: int = SPAN, k: int = K) -> DataFrame:
    """Windows found: uid, item_id, ``start`` (the place of its first word) and ``words``. Both inputs have ``w``."""
    theirs = kept_grams(items.select("item_id", "w"), span, k)
    theirs = theirs.groupBy("gram", "at", "first", "around").agg(F.collect_set("item_id").alias("items"))
    theirs = theirs.select("gram", F.col("at").alias("at2"), F.col("first").alias("first2"), F.col("around").alias("around2"), "items")
    theirs = work.keep(theirs, "benchmark_grams")
    few = theirs.count() <= BROADCAST_ROWS
    mine = kept_grams(docs.select("uid", "w"), span, k)
    met = mine.join(F.broadcast(theirs) if few else theirs, "gram")
    # Windows by their distance before the k-gram: both sides must have the words, and the same ones.
    back = F.sequence(F.lit(0), F.lit(span - k))
    agreeing = F.filter(
        back,
        lambda d: (F.col("at") - d >= F.col("first"))
        & (F.col("at2") - d >= F.col("first2"))
        & (F.size(_window(d, "", span)) == span)
        & (_window(d, "", span) == _window(d, "2", span)),
    )
    found = met.select("uid", "items", "at", F.explode(agreeing).alias("d"))
    return found.select("uid", "items", (F.col("at") - F.col("d")).alias("start"), F.lit(span).alias("words"))


def _window(d: Column, side: str, span: int) -> Column:
    start = F.col(f"at{side}") - d - F.col(f"first{side}") + 1
    return F.slice(f"around{side}", F.greatest(start, F.lit(1)), span)


def short_hits(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame | None:
    """Hits of items with fewer words than ``span``; None if there are none. At most ``span - 1`` lengths occur."""
    short = items.filter((F.size("w") > 0) & (F.size("w") < span)).groupBy("w").agg(F.collect_set("item_id").alias("items"))
    lengths = [r[0] for r in short.select(F.size("w")).distinct().collect()]
    if not lengths:
        return None
    wanted = short.select(F.xxhash64("w").alias("gram"), F.col("w").alias("window"), "items")
    few = wanted.count() <= BROADCAST_ROWS
    windows = [_windows_of(m) for m in sorted(lengths)]
    mine = docs.select("uid", F.inline(F.concat(*windows))).withColumn("gram", F.xxhash64("window"))
    met = mine.join(F.broadcast(wanted) if few else wanted, ["gram", "window"])
    return met.select("uid", "items", "start", "words")


def _windows_of(m: int) -> Column:
    """All stretches of ``m`` words with their places."""
    starts = F.when(F.size("w") >= m, F.sequence(F.lit(1), F.size("w") - m + 1))
    part = F.transform(starts, lambda i: F.struct(F.slice("w", i, m).alias("window"), i.alias("start"), F.lit(m).alias("words")))
    return F.coalesce(part, F.array().cast("array<struct<window:array<bigint>,start:int,words:int>>"))


def _found(docs: DataFrame, benchmark: DataFrame, work: Work, span: int, k: int, uid: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents under ``uid`` (that column, or a new key), with their hashed words ``w``; and all windows found in them."""
    items = benchmark.select("item_id", word_hashes(F.coalesce("text", F.lit(""))).alias("w"))
    items = work.keep(items, "items")
    rows = work.keep(
        docs.select(
            "doc_id",
            word_hashes(F.coalesce("text", F.lit(""))).alias("w"),
            (F.col(uid) if uid else F.monotonically_increasing_id()).alias("uid"),
        ),
        "words",
    )
    found = hits(rows, items, work, span, k)
    short = short_hits(rows, items, span)
    return rows, found if short is None else found.unionByName(short)


def clean(docs: DataFrame, benchmark: DataFrame, work: Work, span: int = SPAN, k: int = K) -> DataFrame:
    """``docs`` without the rows that hold a window. Rows go by a written key of their own, whether or not ids repeat."""
    keyed = work.keep(docs.select(F.struct("*").alias("whole"), F.monotonically_increasing_id().alias("row")), "rows")
    plain = keyed.select(F.col("whole.doc_id").alias("doc_id"), F.col("whole.text").alias("text"), "row")
    _, found = _found(plain, benchmark, work, span, k, "row")
    gone = work.keep(found.select(F.col("uid").alias("row")).distinct(), "gone")
    return keyed.join(gone, "row", "left_anti").select("whole.*")


def contamination(docs: DataFrame, benchmark: DataFrame, work: Work, span: int = SPAN, k: int = K) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, found = _found(docs, benchmark, work, span, k)
    places = F.array_distinct(F.flatten(F.transform("windows", lambda x: F.sequence(x.start, x.start + x.words - 1))))
    per = found.groupBy("uid").agg(
        F.collect_set(F.struct("start", "words")).alias("windows"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    per = per.select("uid", F.size(places).cast("long").alias("n_hit"), "items")
    out = rows.select("uid", "doc_id", F.size("w").cast("long").alias("n_words")).join(per, "uid", "left")
    names = F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<bigint>")), lambda i: i.cast("string")))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), Work(spark, "op10"))


#: The same rows in DuckDB SQL.
OP10_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS uid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wanted AS (SELECT DISTINCT item_id, w[i:i + {SPAN - 1}] AS part FROM
  (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - {SPAN - 1}))) AS i FROM items WHERE len(w) > 0)),
windows AS (SELECT uid, i, m, w[i:i + m - 1] AS part FROM
  (SELECT uid, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM docs, (SELECT DISTINCT len(part) AS m FROM wanted))),
hits AS (SELECT uid, i, m, item_id FROM windows JOIN wanted USING (part)),
places AS (SELECT uid, count(DISTINCT place) AS n_hit FROM (SELECT uid, unnest(generate_series(i, i + m - 1)) AS place FROM hits) GROUP BY uid),
found AS (SELECT uid, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM
  (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN places USING (uid) LEFT JOIN found USING (uid)"""
