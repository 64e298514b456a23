"""Merkle manifest of a data set: a content-addressed DAG of digests, and proofs by descent from its root.

H is the SHA-256 in lower-case hex of its inputs' concatenation, digests as hex text. A row's leaf is H of doc_id,
source, lang, n_chars and text, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and its value. Within a lang
the leaves stand in the order of doc_id; while there are several nodes, every ``WIDTH`` in a row (the last run may be
shorter, even one) become their H. The node left is the lang's subroot. Subroots, in the order of lang, give the root
the same way.

* **Records.** Every run is stored under its digest: digest -> children. Equal runs are one record.
* **Ranks.** Rows are placed by a range shuffle and numbered inside it; sums over the parts give the rank within the
  lang. No task sees a lang whole. The digits of a rank in base ``WIDTH`` are the way from the subroot to the leaf.
* **Descent.** Requests start at the root and join the records by digest, digit by digit. Those that still share their
  digits travel as one row; it becomes a row for each child, with the children not chosen added to its path. The
  requests of one run part only in the last step, where paths are reversed and folded, so no path is ever shuffled leaf by leaf.

Nulls: a null doc_id comes before all others, a null lang before all others. Ties: rows of one doc_id go by their leaf;
wholly equal rows are leaves each, with equal columns but for the proof. A row with a null doc_id is never tampered
with. Empty and long texts need no special care. An empty table gives no rows and has no root. Extra columns are
ignored; none of the input's names is used beside names of this module.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.llm.shared import Work, read

#: Children of a node.
WIDTH = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """How a value enters its leaf."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return sha256(F.concat(*(field(text if c == "text" else F.col(c)) for c in FIELDS)))


def ranked(rows: DataFrame, tree: list[str], order: list[str], work: Work, name: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0) in the order within each value of ``tree``, nulls first, and its ``size``. They
    are written once placed, so that ranks hold when a task runs again. Rows equal in all of it stay in one task."""
    placed = rows.repartitionByRange(*tree, *order).sortWithinPartitions(*tree, *order)
    placed = work.keep(placed.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), name)
    runs = placed.groupBy(*tree, "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    # a row for each part of a tree, and a sum over earlier parts
    runs = runs.selectExpr(
        *(f"{c} AS _{c}" for c in tree), "part AS _part", "first",
        f"coalesce(sum(n) OVER (PARTITION BY {', '.join(tree)} ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base",
        f"sum(n) OVER (PARTITION BY {', '.join(tree)}) AS size",
    )
    met = F.col("part") == F.col("_part")
    for c in tree:
        met &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    rank = (F.col("base") + F.col("place") - F.col("first")).alias("rank")
    return placed.join(runs, met).select(*rows.columns, rank, "size")


def grown(nodes: DataFrame, work: Work, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """From ``nodes`` (tree, rank, size, digest), ``size`` being that of the tree: the roots (tree, depth, digest), and
    the records (digest, children) of each level, lowest first."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    here = nodes.select("tree", "rank", F.col("size").alias("left"), "digest")
    roots, records = [], []
    while True:
        roots.append(here.filter("left = 1").select("tree", F.lit(len(records)).alias("depth"), "digest"))
        if largest <= 1:
            break
        largest = -(-largest // WIDTH)
        runs = here.filter("left > 1").groupBy("tree", F.expr(f"rank div {WIDTH}").alias("rank"), "left").agg(
            F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("run")  # WIDTH at most
        )
        runs = runs.select("tree", "rank", F.ceil(F.col("left") / WIDTH).alias("left"), F.col("run.digest").alias("children"))
        here = work.keep(runs.withColumn("digest", sha256(F.array_join("children", ""))), f"{name}-{len(records)}", free=False)
        records.append(here.groupBy("digest").agg(F.first("children").alias("children")))
    return work.keep(reduce(DataFrame.unionByName, roots), f"{name}-roots", free=False), records


def chosen(children: Column, at: Column) -> Column:
    """A step of a path: the digests left of a child and those right of it, as text. ``at`` counts from 0."""
    left = F.array_join(F.slice(children, 1, at), "")
    return F.struct(left.alias("left"), F.array_join(F.slice(children, at + 2, WIDTH), "").alias("right"))


def one_down(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """The rows of ``frontier`` (digest, rank, path and others) replaced by one for each child."""
    others = [c for c in frontier.columns if c not in ("digest", "rank", "path")]
    met = frontier.join(records, "digest").select(*others, "rank", "path", "children", F.posexplode("children").alias("at", "child"))
    path = F.concat("path", F.array(chosen(F.col("children"), F.col("at"))))
    return met.select(*others, F.col("child").alias("digest"), (F.col("rank") * WIDTH + F.col("at")).alias("rank"), path.alias("path"))


def folded(digest: Column, path: Column) -> Column:
    """The root to which a path from a leaf upwards leads."""
    return F.aggregate(path, digest, lambda have, step: sha256(F.concat(step["left"], have, step["right"])))


def proof(path: Column) -> Column:
    return sha256(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def proofs(df: DataFrame, work: Work, tampered: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Where ``tampered`` (a column over
    doc_id) holds, the folded leaf is that of the row with A-Z of its text in lower case."""
    touched = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = df.select(
        "doc_id",
        F.col("lang").alias("tree"),
        leaf(F.col("text")).alias("digest"),
        F.when(touched, leaf(F.translate("text", UPPER, LOWER))).alias("altered"),
        F.monotonically_increasing_id().alias("salt"),  # lets the range shuffle split wholly equal rows
    )
    leaves = work.keep(leaves, "leaves")
    leaves = work.keep(ranked(leaves, ["tree"], ["doc_id", "digest", "salt"], work, "placed"), "ranked")

    subroots, records = grown(leaves, work, "tree")
    subroots = ranked(subroots.withColumn("all", F.lit(0)), ["all"], ["tree"], work, "subroots-placed")
    subroots = work.keep(subroots, "subroots", free=False)
    tops, above = grown(subroots.withColumn("tree", F.col("all")), work, "top")

    none = F.array().cast("array<struct<left:string,right:string>>")
    frontier = tops.select(F.col("digest").alias("root"), "digest", F.lit(0).cast("long").alias("rank"), none.alias("path"))
    for level in reversed(above):
        frontier = one_down(frontier, level)
    starts = frontier.select("root", "rank", "path").join(subroots, "rank")
    starts = starts.select("root", "tree", "depth", "digest", F.col("digest").alias("subroot"), F.lit(0).cast("long").alias("rank"), "path")
    starts = work.keep(starts, "descent", free=False)

    frontier = starts.filter(F.col("depth") == len(records))
    for depth in range(len(records), 1, -1):
        frontier = work.keep(one_down(frontier, records[depth - 1]), f"descent{depth - 1}", free=False)
        frontier = frontier.unionByName(starts.filter(F.col("depth") == depth - 1))
    runs = frontier.join(records[0], "digest") if records else frontier.withColumn("children", F.lit(None).cast("array<string>"))
    if records:  # langs of one row: their leaf is the subroot
        runs = runs.unionByName(starts.filter("depth = 0").withColumn("children", F.lit(None).cast("array<string>")))

    requests = leaves.groupBy(F.col("tree").alias("of"), F.expr(f"rank div {WIDTH}").alias("run")).agg(
        F.collect_list(F.struct(F.expr(f"cast(rank % {WIDTH} as int)").alias("at"), "doc_id", "digest", "altered")).alias("asked")
    )
    met = requests.join(runs.drop("digest"), F.col("of").eqNullSafe(F.col("tree")) & (F.col("run") == F.col("rank")))
    met = met.select("root", "subroot", "path", "children", F.inline("asked"))
    last = F.when(F.col("children").isNotNull(), F.array(chosen(F.col("children"), F.col("at")))).otherwise(none)
    met = met.withColumn("path", F.reverse(F.concat("path", last)))
    return met.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        proof(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("altered", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return proofs(read(spark, sf_dir, "documents"), Work(spark, "op12"), tampered)
