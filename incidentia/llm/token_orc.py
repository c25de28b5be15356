"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Rows are dealt out by ranges of the id, so files, stripes and row groups each cover a narrow range:
a reader skips those that cannot hold the ids it looks for, and several tasks read one file by its
stripes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentia.llm.common import Work, id_type, starts
from incidentia.llm.tokens import encoder

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Bytes of a stripe before compression, rows of an index entry, and the filters' error rate.
STRIPE_BYTES = 64 << 20
INDEX_ROWS = 1000
BLOOM_ERROR = 0.01


def write_token_orc(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
) -> None:
    """Writes (doc_id, row, ids) in ascending id; ``row`` is the row's place in the input.

    Null texts count as empty: the end id alone. Null ids come first; repeated ids are ordered by
    ``row``. An empty table gives files without rows.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type(docs, id_col)),
            T.StructField("row", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                found = [ids + end for ids in tokens.encode(part.column(2).to_pylist())]
                edges = np.cumsum([0, *(len(ids) // 4 for ids in found)], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(found), "<u4").view("<i4"))
                lists = pa.ListArray.from_arrays(pa.array(edges), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), lists], schema.fieldNames()
                )

    (
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.col(text_col).alias("text"),
        )
        .repartitionByRange("doc_id", "row")
        .sortWithinPartitions("doc_id", "row")
        .mapInArrow(encode, schema)
        .write.format("orc")
        # Run lengths leave little to compress: 16-bit ids are packed into their bits.
        .option("compression", "snappy")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_ERROR))
        .save(path)
    )


def read_token_orc(spark: SparkSession, path: str, ids: list | None = None) -> DataFrame:
    """The rows with their file; ``ids`` reach the files as a filter on statistics and Bloom bits."""
    table = spark.read.orc(path).withColumn("file", F.col("_metadata.file_name"))
    return table if ids is None else table.filter(F.col("doc_id").isin(ids))


def token_index(files: DataFrame, work: Work) -> DataFrame:
    """Per document of ``read_token_orc``: file, doc_id, start, n_tokens, ids_crc32."""
    schema = T.StructType(
        [
            T.StructField("file", T.StringType()),
            T.StructField("doc_id", id_type(files, "doc_id")),
            T.StructField("row", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            edges = lists.offsets.to_numpy()
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            counts = np.diff(edges).astype(np.int64)
            columns = [*batch.columns[:3], pa.array(counts), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    measured = files.select("file", "doc_id", "row", "ids").mapInArrow(measure, schema)
    return starts(
        work.table(measured, "measured"), "file", ["doc_id", "row"], "n_tokens", "start"
    ).select("file", "doc_id", "start", "n_tokens", "ids_crc32")
