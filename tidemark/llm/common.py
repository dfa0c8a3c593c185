"""Helpers shared by the training-data operators: inputs, bounded Arrow batches, shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark puts into one Arrow batch for the Python side, at most.
BATCH_ROWS = 1000
#: Bytes of text that an operator turns into Python objects at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for long texts; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session without that setting (tests, local mode) gets a folder of its own here.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again: later steps neither
    recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str | None:
    """The path of a file URI, or None for a remote store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI; also remote stores that pyarrow can open."""
    from pyarrow import fs

    at = local_path(uri)
    return (fs.LocalFileSystem(), at) if at is not None else fs.FileSystem.from_uri(uri)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``limit`` bytes of ``column``, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a table, under these names and with null texts as empty ones."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list, list[str]], dict]], schema: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Runs ``make()(ids, texts)`` over slices of the texts; it returns columns by name.

    ``make`` is called once a task, on the executor, and holds what a task needs.
    """
    bounded_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in slices(batches, "text", limit):
            got = step(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return texts_of(docs, id_col, text_col).mapInArrow(run, schema)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; ``TIDEMARK_TOKENIZERS`` names another folder."""
    folder = os.environ.get("TIDEMARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
