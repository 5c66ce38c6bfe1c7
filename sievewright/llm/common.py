"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 16 << 20
#: Characters of a plan's text. The driver keeps the texts of up to 1,000 plans that ran, and makes one anew whenever a plan
#: changes while it runs.
PLAN_CHARS = 4 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir, or a fresh local one on a local master (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Long texts: hand fewer rows, and fewer bytes, at a time to Python workers than Spark's default. This holds for the
    session, so the registered queries and the pipeline call it; the operators don't."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.maxPlanStringLength", PLAN_CHARS)


#: Paths of the tables that each settled() under way has written.
_scratch: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage is cut, columns stay prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return spark.read.schema(schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns, written. The tables that make() wrote on the way are deleted then: nothing but its result may
    read them."""
    _scratch.append([])
    try:
        df = make()
    finally:
        own = _scratch.pop()
    out = written(df, name)
    spark = out.sparkSession
    for path in own:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    collected(spark)
    return out


def collected(spark: SparkSession) -> None:
    """Has the driver's JVM collect what no plan refers to any more: Spark deletes the shuffles of such plans only then, and
    the code made for them is unloaded."""
    spark._jvm.System.gc()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which its worker hands back the memory that it no longer uses: Spark keeps workers for the
    stages to come, and an executor has several."""

    @functools.wraps(run)
    def one(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(it)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return one


def text_rows(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def batches(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into slices of about most_bytes of text, one row at least, so that per-word arrays stay small."""
    sizes = [len(t) if t is not None else 0 for t in map(lambda v: v.as_buffer() if v.is_valid else None, batch.column(column).cast(pa.binary()))]
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield batch.slice(begin)


def fresh(name: str, docs: DataFrame) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remainder(column: Column | str, divisor: int) -> Column:
    """crc32 of the value as text, modulo divisor; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit("")).cast("binary")) % divisor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
