"""From documents to packed training sequences: language, lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and gives all that its decisions leave. All but the last return the columns of
``documents``; extra columns pass through, columns of their own never clash with them.

* Null texts have no language, so the first stage drops them, as it drops texts without a letter, texts whose
  calibrated score is where validation texts were right too seldom, and texts of byte pairs that the sample lacks.
* Lines found elsewhere go; a document that loses all stays with an empty text. n_chars follows the text.
* Of documents joined by links of similarity 0.8, the one with the smallest doc_id (null last) stays, one row even
  where ids repeat. Documents without words all stay.
* Rows with a window of the benchmark go, others of the same doc_id stay.
* An empty table passes through every stage as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.llm import decontaminate, jaccard_join, language, lines, packing
from lapsekit.llm.shared import Work, read, ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and drops those it rejects."""
    ship(spark)
    model = language.fit(docs, F.lit(True))
    return language.accepted(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of all equal or nearly equal lines."""
    return lines.dedup_lines(docs, Work(spark, "pipeline-lines"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of the Jaccard join."""
    return jaccard_join.one_of_each(docs, Work(spark, "pipeline-documents"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), Work(spark, "pipeline-benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left, placed in sequences of at most 2048 ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), Work(spark, "pipeline-packing"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near copies", dedup_documents),
    ("benchmark", drop_contaminated),
    ("packing", pack),
]

#: Trained scores, MinHash and a genetic algorithm have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    work = Work(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            work.drop(STAGES[k - 1][0].replace(" ", "-"))
    return docs
