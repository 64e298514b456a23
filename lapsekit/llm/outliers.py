"""Quality rules: base rules on counts of a text, then robust multivariate outliers per language and source, in DataFrame
functions alone.

A text that no base rule rejects is a vector of transformed counts (``VECTOR``). Per group the minimum-covariance-
determinant estimate is sought by concentration steps: of the rows, the share ``CORE`` nearest to the last estimate gives
the next mean and covariance, from two starts (medians with quartile distances, and the moments of all rows), until the
determinants stand still; per group the start with the least determinant stays. Rows within the distance ``INNER`` of it
give the reweighted estimate, and rows farther than ``OUTER`` from that are rejected (squared Mahalanobis distances).

* A step is one partial aggregate: rows count in bins of their distance, so the nearest ones are whole bins, and a group
  of any size, a third of all rows too, arrives as some hundred rows. All rows take part in every step.
* ``FLOORS`` are added to the variances: most texts have no symbols and no repeats, and a spread of zero would reject
  the first one that has any.
* Groups are (lang, source), null being a value of its own. The rows of a language's groups under ``LEAST_ROWS`` rows
  are one group; those of languages where that is too small are one group as well; if it is too small, its rows are kept.

Null and empty texts have no words, so the base rules reject them. Repeated rows count and are judged each; ties at a
bin's edge go the same way. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.llm.shared import Work, read

#: What stands between words, as characters and as a pattern.
SPACE = " \t\n\x0b\x0c\r"
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Fewer words fail, as do texts with more than this share of their words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: The statistics that make a vector, and what is added to the variance of each (as a deviation).
VECTOR = {
    "v0": "ln(1D + n_words)",
    "v1": "ln(CAST(word_chars AS DOUBLE) / n_words)",
    "v2": "sqrt(CAST(n_symbols AS DOUBLE) / word_chars)",
    "v3": "sqrt(CAST(n_dup_lines AS DOUBLE) / n_words)",
    "v4": "sqrt(CAST(n_repeat_words AS DOUBLE) / n_words)",
}
FLOORS = (0.1, 0.03, 0.05, 0.05, 0.1)
P = len(VECTOR)
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]
#: Share of a group's rows that an estimate rests on.
CORE = 0.75
#: Makes the variances of the nearest CORE of normal rows those of all (for two coordinates; for more it is smaller).
CONSISTENT = 1.86
#: Quantiles 0.975 and 0.9999 of the chi-squared distribution with five degrees of freedom.
INNER, OUTER = 12.833, 25.745
#: Rows that a group's estimate needs.
LEAST_ROWS = 50
#: Steps at most, and the change of a determinant's logarithm that counts as none.
STEPS, STILL = 8, 1e-3
#: Bins for each doubling of a distance; and of a coordinate's unit, for its quartiles.
BINS, PLACES = 8, 64


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeat_words(w: Column) -> Column:
    """Words of ``w``, an array of hashes that stands in a column, in windows of ``WINDOW`` that occur twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(w[i + k] for k in range(WINDOW))))
    return F.when(F.size(w) > WINDOW, windows).otherwise(F.array().cast("array<bigint>"))


def statistics(df: DataFrame) -> DataFrame:
    """``df``'s doc_id, lang and source with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, SPACE) != "")
    rows = df.select(
        "doc_id",
        "lang",
        "source",
        F.transform(words, lambda w: F.xxhash64(w)).alias("w"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
        F.length(without(text, SPACE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
    )
    rows = rows.withColumn("windows", repeat_words(F.col("w")))
    some = F.size("windows") > F.size(F.array_distinct("windows"))
    # windows in the order of their hashes, each with its place: equal ones become neighbours
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(some, placed))
    n = F.size("placed")
    equal = F.zip_with(
        F.slice("placed", 1, n - 1), F.slice("placed", 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
    )
    rows = rows.withColumn("found", F.when(n > 1, F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull())))))
    covered = F.array_distinct(F.flatten(F.transform("found", lambda i: F.array(*(i + k for k in range(WINDOW))))))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("found").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def grouped(base: DataFrame) -> DataFrame:
    """``base`` with its vector and its ``group``, null where too few rows are alike. Rows that base rules reject go."""
    value = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    rows = base.filter("NOT base_failed").withColumns({"tongue": value("lang"), **{k: F.expr(v) for k, v in VECTOR.items()}})
    rows = rows.withColumn("cell", F.concat("tongue", value("source")))
    cells = rows.groupBy("cell", "tongue").agg(F.count("*").alias("n"))
    small = cells.filter(F.col("n") < LEAST_ROWS)
    tongues = small.groupBy("tongue").agg(F.sum("n").alias("in_tongue"))
    rest = tongues.filter(F.col("in_tongue") < LEAST_ROWS).agg(F.sum("in_tongue")).first()[0] or 0
    named = cells.join(tongues, "tongue", "left").select(
        "cell",
        F.when(F.col("n") >= LEAST_ROWS, F.col("cell"))
        .when(F.col("in_tongue") >= LEAST_ROWS, F.concat("tongue", F.lit("*")))
        .when(F.lit(rest >= LEAST_ROWS), "*")
        .alias("group"),
    )
    return rows.join(named, "cell").select("doc_id", "group", *VECTOR)


def moments(by: list[str], rows: DataFrame) -> DataFrame:
    """Per ``by``: n, and the sums of coordinates and of their products."""
    sums = [f"sum(v{i}) AS t{i}" for i in range(P)] + [f"sum(v{i} * v{j}) AS q{i}{j}" for i, j in LOWER]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *map(F.expr, sums))


def estimate(sums: DataFrame, factor: float, *names: str) -> DataFrame:
    """From ``moments``: the ``names``, ``m``, ``w`` and ``logdet`` of ``factored``."""
    product = lambda i, j: f"{factor}D * (q{i}{j} / n - t{i} / n * t{j} / n)"
    each = [f"t{i} / n AS m{i}" for i in range(P)]
    each += [f"{product(i, j)} AS s{i}{j}" if i != j else f"greatest({product(i, i)}, 0D) + {FLOORS[i] ** 2}D AS s{i}{i}" for i, j in LOWER]
    return factored(sums.selectExpr(*names, *each), *names)


def factored(rows: DataFrame, *names: str) -> DataFrame:
    """``names``; means m0.. as an array ``m``; of covariances s00, s10, .. the inverse Cholesky factor, its lower
    triangle as ``w``, and ``logdet``. Each expression names earlier ones of the same list."""
    minus = lambda first, terms: " - ".join([first, *terms])
    steps = []
    for j in range(P):
        left = minus(f"s{j}{j}", [f"l{j}{k} * l{j}{k}" for k in range(j)])
        steps.append(f"sqrt(greatest({left}, {FLOORS[j] ** 2 / 16}D)) AS l{j}{j}")
        for i in range(j + 1, P):
            steps.append(f"({minus(f's{i}{j}', [f'l{i}{k} * l{j}{k}' for k in range(j)])}) / l{j}{j} AS l{i}{j}")
    for i, j in LOWER:
        steps.append(f"1 / l{i}{i} AS w{i}{i}" if i == j else f"({minus('0D', [f'l{i}{k} * w{k}{j}' for k in range(j, i)])}) / l{i}{i} AS w{i}{j}")
    arrays = [f"array({', '.join(f'm{i}' for i in range(P))}) AS m", f"array({', '.join(f'w{i}{j}' for i, j in LOWER)}) AS w"]
    logdet = f"2 * ({' + '.join(f'ln(l{i}{i})' for i in range(P))}) AS logdet"
    return rows.selectExpr("*", *steps).selectExpr(*names, *arrays, logdet)


def distance() -> Column:
    """Squared Mahalanobis distance of v0.. from ``m`` under ``w``."""
    along = [" + ".join(f"w[{i * (i + 1) // 2 + j}] * (v{j} - m[{j}])" for j in range(i + 1)) for i in range(P)]
    return F.expr(" + ".join(f"pow({x}, 2)" for x in along))


def first_estimates(rows: DataFrame) -> DataFrame:
    """Per group and start: group, start, m, w, logdet."""
    each = rows.select("group", F.posexplode(F.array(*(F.round(F.col(f"v{i}") * PLACES) for i in range(P)))).alias("at", "bin"))
    counts = each.groupBy("group", "at", "bin").agg(F.count("*").alias("n"))
    counts = counts.selectExpr(
        "group", "at", f"bin / {PLACES}D AS v",
        "sum(n) OVER (PARTITION BY group, at ORDER BY bin) AS upto", "sum(n) OVER (PARTITION BY group, at) AS total",
    )
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("v")))
    per = counts.groupBy("group", "at").agg(quartile(0.25).alias("a"), quartile(0.5).alias("m"), quartile(0.75).alias("b"))
    middle = per.groupBy("group", F.lit(0).alias("start")).agg(
        *(F.expr(f"max(CASE WHEN at = {i} THEN m END) AS m{i}") for i in range(P)),
        *(F.expr(f"max(CASE WHEN at = {i} THEN pow((b - a) / 1.349D, 2) END) + {FLOORS[i] ** 2}D AS s{i}{i}") for i in range(P)),
    )
    middle = middle.selectExpr("*", *(f"0D AS s{i}{j}" for i, j in LOWER if i != j))
    everything = estimate(moments(["group"], rows), 1.0, "group")
    return factored(middle, "group", "start").unionByName(everything.withColumn("start", F.lit(1)))


def concentrated(rows: DataFrame, last: DataFrame) -> DataFrame:
    """A step: the estimate of the nearest CORE of each group's rows, by whole bins of their distance."""
    near = rows.join(last.select("group", "start", "m", "w"), "group")
    near = near.withColumn("bin", F.floor(F.log2(distance() + 1e-6) * BINS).cast("int"))
    bins = moments(["group", "start", "bin"], near)
    sums = [c for c in bins.columns if c[0] in "tq" and c[1:].isdigit()]
    bins = bins.selectExpr(
        "*", "sum(n) OVER (PARTITION BY group, start ORDER BY bin) - n AS nearer", "sum(n) OVER (PARTITION BY group, start) AS total"
    )
    core = bins.filter(F.col("nearer") < F.ceil(CORE * F.col("total"))).groupBy("group", "start")
    core = core.agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums))
    return estimate(core, CONSISTENT, "group", "start")


def robust_estimates(rows: DataFrame, work: Work) -> DataFrame:
    """Per group: the reweighted estimate (group, m, w)."""
    here = work.keep(first_estimates(rows), "estimates0", free=False)
    for k in range(1, STEPS + 1):
        new = work.keep(concentrated(rows, here), f"estimates{k}", free=False)
        if k > 1:  # the first step goes from all rows to the core
            was = here.select("group", "start", F.col("logdet").alias("was"))
            moved = new.join(was, ["group", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
            if (moved or 0.0) <= STILL:
                here = new
                break
        here = new
    best = here.groupBy("group").agg(F.min_by(F.struct("m", "w"), F.struct("logdet", "start")).alias("best")).select("group", "best.*")
    inside = rows.join(best, "group").filter(distance() <= INNER)
    return work.keep(estimate(moments(["group"], inside), 1.0, "group"), "robust", free=False)


def judged(df: DataFrame, work: Work) -> DataFrame:
    """Per row of ``df``: doc_id, the statistics, base_failed, ``distance`` (null without an estimate) and kept."""
    base = work.keep(statistics(df).withColumn("row", F.monotonically_increasing_id()), "statistics")
    rows = work.keep(grouped(base.drop("doc_id").withColumnRenamed("row", "doc_id")), "vectors")
    found = rows.filter("group IS NOT NULL")
    found = found.join(robust_estimates(found, work), "group").select(F.col("doc_id").alias("row"), distance().alias("distance"))
    out = base.join(found, "row", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= OUTER, F.lit(True))
    return out.select("doc_id", *NAMES, "base_failed", "distance", kept.alias("kept"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents"), Work(spark, "op13")).drop("distance")
