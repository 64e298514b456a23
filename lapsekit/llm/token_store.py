"""Token ids as Parquet files in document order, written and read back.

Files hold one row per document: metadata columns and the ids as a list column. Ids are dictionary encoded, sorted
numbers delta encoded; row groups and pages are small enough that their statistics and page indexes let a reader
fetch some documents, or the metadata alone, without the other ids.

Null texts count as empty and still get the end id. Rows with equal doc_id are all kept, in text order; a null doc_id
comes first. Extra input columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapsekit.llm.shared import Work, documents
from lapsekit.llm.tokens import Encoder

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, tokens array<int>"
#: Parquet settings: row groups of 16 MB, pages of 64 KB and 500 rows at most, page version 2 for delta encoding.
LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "500",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def encoded(df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """A row of ids for each document, placed and sorted by doc_id. ``part`` numbers the files in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<i4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 3000):
                batch = whole.slice(at, 3000)
                ids = [x + end for x in encoder.encode(batch.column(1).to_pylist())]
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(sizes)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                columns = [batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(start + ends - sizes)]
                columns += [pa.array(sizes), pa.ListArray.from_arrays(offsets, values)]
                start += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "start_in_part", "n_tokens", "tokens"])

    placed = documents(df).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return placed.mapInArrow(run, SCHEMA)


def write_tokens(df: DataFrame, tokenizer: str, end_id: int, work: Work, name: str = "tokens") -> DataFrame:
    """Writes the files and reads them back: columns of ``SCHEMA``. Column selection and filters reach the files."""
    return work.keep(encoded(df, tokenizer, end_id), name, **LAYOUT)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
        sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        columns = [*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def token_digests(stored: DataFrame) -> DataFrame:
    """Per document, from the ids in the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` adds the ids of earlier files, one sum per file, to the place inside the file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    files = files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = stored.select("doc_id", "part", "start_in_part", "tokens").mapInArrow(
        _digests, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"
    )
    # one row a file: far below any limit of a broadcast
    return rows.join(F.broadcast(files), "part").select(
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lapsekit.llm.shared import read

    work = Work(spark, "op9")
    stored = write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, work)
    return token_digests(stored)
