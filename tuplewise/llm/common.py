"""What the operators of this subpackage share: table access, durable intermediates, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text handled at once inside one Arrow batch; bounds the memory of a Python worker.
BLOCK_CHARS = 1_000_000
#: Rows of an Arrow batch, where the session has Spark's default: texts are long, and a batch is held by both the JVM and Python.
BATCH_ROWS = 2_000


#: Python workers stand beside each other in an executor's memory: what one frees has to go back.
WORKER = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "OMP_NUM_THREADS": "1"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package even where only the driver's path has it, and bound their batches and memory."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    for name, value in WORKER.items():
        env.setdefault(name, value)
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Set here only where it is unset and Spark is a single process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tuplewise-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_path() named."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jpath, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again, so that lost executors cost no recomputation."""
    return durable_at(df, name)[0]


def durable_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Scratch:
    """Intermediates that are deleted together, once what was made of them is written."""

    def __init__(self) -> None:
        self.held: list[tuple[SparkSession, str]] = []

    def durable(self, df: DataFrame, name: str) -> DataFrame:
        out, path = durable_at(df, name)
        self.held.append((df.sparkSession, path))
        return out

    def drop(self) -> None:
        for spark, path in self.held:
            drop_path(spark, path)
        self.held = []


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of neighbouring texts of about `limit` characters, nulls as empty; a longer text is a run of its own."""
    at, size, out = 0, 0, []
    for i, text in enumerate(texts):
        text = text or ""
        if out and size + len(text) > limit:
            yield at, out
            at, size, out = i, 0, []
        out.append(text)
        size += len(text)
    if out:
        yield at, out


def give_back() -> None:
    """Return memory that a task no longer needs; the worker process lives on, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_texts(df: DataFrame, keep: list[str], text_col: str, schema: str, make: Callable[[], Callable[[list[str | None]], dict[str, list]]]) -> DataFrame:
    """Keep `keep`, add what make()'s function finds for each text.

    make() runs once a task and returns a function from a list of texts (None: null) to a column of
    values for each field of `schema`. Only the kept columns and the text reach Python.
    """
    spark = df.sparkSession
    ship_package(spark)
    added = T.StructType.fromDDL(schema)
    # plain names on the way through Python: kept columns may have any
    out = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)] + list(added))
    text_name = fresh("t", [f.name for f in out])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(len(keep))
            # slices of rows, so that one large batch never becomes one large list of Python strings
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = done = 0
            while start < batch.num_rows:
                stop = min(batch.num_rows, int(np.searchsorted(ends, done + 4 * BLOCK_CHARS)) + 1)
                done = int(ends[stop - 1])
                part = texts.slice(start, stop - start).to_numpy(zero_copy_only=False).tolist()
                found = work(part)
                columns = [c if c.type == f.type else c.cast(f.type) for c, f in ((batch.column(i).slice(start, stop - start), arrow.field(i)) for i in range(len(keep)))]
                columns += [pa.array(found[f.name], type=arrow.field(f.name).type) for f in added]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                start = stop
        give_back()

    named = [c.alias(f"k{i}") for i, c in enumerate(quoted(keep))]
    return df.select(*named, F.col(text_col).cast("string").alias(text_name)).mapInArrow(run, out).toDF(*keep, *added.names)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of `columns` has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(columns: list[str]) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the id as text: what the folds are made of."""
    return F.crc32(doc_id.cast("string"))
