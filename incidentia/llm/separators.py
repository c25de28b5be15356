"""Token counts by a scan for end-of-document ids in flat token files without an index.

A file holds 16-bit little-endian ids and nothing else. Blocks of a file are searched at once as
arrays. Each block reports its separators; a prefix scan over blocks and files then tells each
document where the separator before it was, however many blocks it spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentia.llm.common import Work, batches_of
from incidentia.llm.tokens import encoder

VOCABULARY = "word_bpe_49k.json"
#: The separator. Vocabulary ids are written plus one, so no text contains it.
SEPARATOR = 0
#: Ids of a block.
BLOCK = 1 << 19
#: Documents of a file that one task writes; it goes on with the next. A file is read as one value.
FILE_DOCS = 5_000
#: Texts that cross to Python at a time, and files.
TEXT_BATCH, FILE_BATCH = 1_000, 1


def write_flat_tokens(
    docs: DataFrame, path: str, text_col: str = "text", vocabulary: str = VOCABULARY
) -> None:
    """Writes the documents of each partition to files of ``FILE_DOCS``, a separator after each document.

    Spark's text writer puts the bytes of a row and then the line separator, which is here the
    two bytes of the separating id: its commit makes each file appear whole or not at all. Null and
    empty texts leave a separator alone. An id that does not fit 16 bits is an error.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary, True)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                found = tokens.encode(batch.column(0).slice(at, 250).to_pylist())
                shifted = [flat_ids(np.frombuffer(x, "<u4")) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(shifted, pa.binary())], ["ids"])

    ids = docs.select(F.col(text_col).alias("text")).mapInArrow(encode, "ids binary")
    writer = ids.select(F.col("ids").cast("string").alias("value")).write
    with batches_of(docs.sparkSession, TEXT_BATCH):
        writer.option("lineSep", "\0\0").option("maxRecordsPerFile", FILE_DOCS).text(path)


def place_in_part(file: Column, file_doc: Column) -> Column:
    """Of a document of ``write_flat_tokens``, by its file and number there: its number in its partition."""
    # The name's last part: the run's id before it may have parts that begin with a c as well.
    return F.regexp_extract(file, r"-c(\d+)(\.[^-]*)?$", 1).cast("long") * FILE_DOCS + file_doc


def flat_ids(ids: np.ndarray) -> bytes:
    """Ids plus one in 16 bits."""
    if ids.size and ids.max() >= 0xFFFF:
        raise ValueError(f"id {ids.max()} does not fit a flat file of 16-bit ids")
    return (ids + 1).astype("<u2").tobytes()


def scan_separators(
    spark: SparkSession, path: str, work: Work, separator: int = SEPARATOR, block: int = BLOCK
) -> DataFrame:
    """Per document: file, file_doc (its number in the file), start, n_tokens, over all files.

    Files count in the order of their names, as one stream: a document may span blocks and files.
    Ids after the last separator are a document only if there are any. ``n_tokens`` leaves out the
    separator; ``start`` counts all ids before the document, separators included.
    """
    schema = T.StructType(
        [
            T.StructField("file", T.StringType()),
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.LongType()),
            T.StructField("ends", T.ArrayType(T.LongType(), False)),
        ]
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                stream = np.frombuffer(content.as_buffer(), "<u2")
                rows = []
                for number, at in enumerate(range(0, len(stream), block)):
                    part = stream[at : at + block]
                    rows.append((number, len(part), np.flatnonzero(part == separator)))
                numbers, sizes, found = zip(*rows) if rows else ((), (), ())
                columns = [
                    pa.array([name.as_py()] * len(rows), pa.string()),
                    pa.array(numbers, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(found, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    )
    with batches_of(spark, FILE_BATCH):
        blocks = work.table(files.mapInArrow(search, schema), "blocks")
    return _stitched(blocks, block)


def _stitched(blocks: DataFrame, block: int) -> DataFrame:
    """The prefix scan: over the blocks of each file, then over the files."""
    last = F.when(F.size("ends") > 0, F.col("block") * block + F.element_at("ends", -1) + 1)
    per_file = blocks.select("file", "ids", "ends", last.alias("last"))
    per_file = per_file.groupBy("file").agg(
        F.sum("ids").alias("ids"), F.max("last").alias("last")
    )
    by_name = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_file.withColumn("base", F.coalesce(F.sum("ids").over(by_name), F.lit(0)))
    placed = placed.select(
        F.col("file").alias("_file"),
        "base",
        # Where the document that is open at the file's start began.
        F.coalesce(F.max(F.col("base") + F.col("last")).over(by_name), F.lit(0)).alias("from"),
        (F.lead("file").over(Window.orderBy("file"))).isNull().alias("final"),
        (F.col("base") + F.col("ids")).alias("end"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block_from = F.coalesce(F.col("base") + F.max("last").over(before), F.col("from"))
    counted = blocks.withColumn("last", last).join(placed, F.col("file") == F.col("_file"))
    counted = counted.select(
        "file",
        F.coalesce(F.sum(F.size("ends").cast("long")).over(before), F.lit(0)).alias("docs"),
        block_from.alias("from"),
        F.transform("ends", lambda e: F.col("base") + F.col("block") * block + e).alias("ends"),
        (F.col("final") & _closing(block)).alias("closing"),
        "end",
    )
    ends = F.when(
        F.col("closing") & (F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.col("from")) < F.col("end")),
        F.concat("ends", F.array("end")),
    ).otherwise(F.col("ends"))
    froms = F.concat(F.array("from"), F.transform("ends", lambda e: e + 1))
    docs = counted.select(
        "file", "docs", F.posexplode(F.arrays_zip(ends.alias("end"), froms.alias("start")))
    )
    return docs.filter("col.end IS NOT NULL").select(
        "file",
        (F.col("docs") + F.col("pos")).alias("file_doc"),
        F.col("col.start").alias("start"),
        (F.col("col.end") - F.col("col.start")).alias("n_tokens"),
    )


def _closing(block: int) -> Column:
    """Whether a block is the last of its file."""
    return F.col("base") + F.col("block") * block + F.col("ids") == F.col("end")
